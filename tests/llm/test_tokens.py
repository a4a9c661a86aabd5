"""Token output and token counts against the library on whole texts."""
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from labelscope.llm import token_counts, token_output

WORD, BYTE = (public_tokenizers.path(f"{x}.json") for x in ("word_bpe_49k", "byte_bpe_50k"))


@pytest.mark.parametrize("params", [{}, {"block_tokens": 300, "shard_tokens": 2000}])
def test_files_hold_the_ids_of_whole_texts(spark, docs, tmp_path, params):
    tokenizer = Tokenizer.from_file(WORD)
    path = f"file://{tmp_path}/tokens"
    token_output.write_tokens(docs, path, WORD, 2, **params)
    rows = sorted(token_output.read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = Counter()
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want[r.doc_id, ids.tobytes()] += 1
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    got = {r.start: r.ids_crc32 for r in token_output.digest(token_output.read_tokens(spark, path)).collect()}
    assert all(got[r.start] == zlib.crc32(bytes(r.ids)) for r in rows)


def test_no_rows(no_docs):
    assert token_output.tokenized(no_docs, WORD).count() == 0
    assert token_counts.count_tokens(no_docs, BYTE).count() == 0


def test_code_lengths_are_optimal_and_limited():
    import heapq
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 700):
        counts = (rng.pareto(1, n) * 10 + 1).astype(np.int64)
        bits = token_output.code_lengths(counts, 30)
        heap = [int(c) for c in counts]
        heapq.heapify(heap)
        cost = 0 if n > 1 else heap[0]
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        assert int((counts * bits).sum()) == cost
        short = token_output.code_lengths(counts, 10)
        assert short.max() <= 10 and (2.0 ** -short).sum() <= 1 + 1e-12
    with pytest.raises(ValueError):
        token_output.code_lengths(np.ones(9, np.int64), 3)


def test_pack_and_decode_round_trip():
    rng = np.random.default_rng(2)
    ids = np.unique(rng.integers(0, 5000, 900))
    bits = token_output.code_lengths(rng.integers(1, 10 ** 6, len(ids)), 18)
    length, code = np.zeros(5000, np.int64), np.zeros(5000, np.uint64)
    length[ids], code[ids] = bits, token_output.canonical(ids, bits)
    sizes = rng.integers(1, 700, 40)
    x = rng.choice(ids, sizes.sum())
    data, begin, offset = token_output.pack(x, sizes, code, length)
    stop = np.cumsum(sizes)
    marks = np.concatenate([offset[a:b:token_output.EVERY].astype(np.uint64) + np.uint64(8 * s)
                            for a, b, s in zip(stop - sizes, stop, begin)])
    assert (token_output.decode(data.tobytes(), marks, sizes, token_output.decoder(ids, bits)) == x).all()


def awkward():
    rnd = random.Random(3)
    parts = ["a", " ", "\n", "\t", "'s", "é", "1", "!", "  ", "<|endoftext|>", " ", "\x01", "\x1c", "Hello", " world"]
    prose = " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 9))) for _ in range(9000))
    return ["", "  a  b\n\n c <|endoftext|> d <|endoftext|>\n\n", prose, prose[:30000] + "a" * 3000 + prose[:9000], "é" * 30000,
            " " * 5000, "x \n" * 5000, "don't I'll \t   y\x1c z" * 50] + [
            "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3000))) for _ in range(80)]


@pytest.mark.parametrize("chunk,overlap", [(20_000, 400), (300, 20), (50, 7)])
def test_spliced_counts_are_those_of_the_whole_text(chunk, overlap):
    tokenizer = Tokenizer.from_file(BYTE)
    texts = awkward() if chunk > 50 else awkward()[8:]
    got = token_counts.counts(tokenizer, f"{BYTE}{chunk}", texts, chunk, overlap)
    assert got == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_query(docs):
    tokenizer = Tokenizer.from_file(BYTE)
    want = Counter()
    for r in docs.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 1024] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTE).collect())
    assert got == want
