"""Pieces that share a hash, and buckets and shards that follow the data."""
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from labelscope.llm import text_kernel, token_output

WORD = public_tokenizers.path("word_bpe_49k.json")


def spans_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, *text_kernel.word_spans(data, np.array([0, len(data)]))


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_distinct_spans_when_hashes_collide(bits, monkeypatch):
    rnd = random.Random(bits)
    words = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 5))) for _ in range(2000)]
    whole = text_kernel.span_hashes
    monkeypatch.setattr(text_kernel, "span_hashes", lambda *a, **k: whole(*a, **k) if bits == 64
                        else whole(*a, **k) >> np.uint64(64 - bits) if bits else whole(*a, **k) * np.uint64(0))
    data, first, last = spans_of(" ".join(words))
    h, check, one, back = text_kernel.distinct_spans(data, first, last)
    assert len(h) == len(set(words)) and (h[1:] >= h[:-1]).all() and [words[i] for i in one[back]] == words


def test_merged_pieces_stay_apart_when_hashes_collide():
    def part(rows):
        h, check, n, text = zip(*rows)
        return (np.array(h, np.uint64), np.array(check, np.uint32), np.array(n), np.array([len(t) for t in text]),
                np.frombuffer("".join(text).encode(), np.uint8))
    h, check, n, size, data = token_output.merge_pieces([part([(5, 1, 2, "ab"), (5, 9, 1, "xyz"), (7, 1, 1, "q")]), part([(5, 1, 4, "ab"), (5, 9, 3, "xyz")])])
    assert list(zip(h, check, n, size)) == [(5, 1, 6, 2), (5, 9, 4, 3), (7, 1, 1, 1)] and bytes(data) == b"abxyzq"


@pytest.mark.parametrize("bits", [0, 3, 12, 24])
def test_bucket_runs(bits):
    h = np.sort(np.random.default_rng(bits).integers(0, 1 << 64, 500, dtype=np.uint64))
    if bits == 0:
        assert token_output.bucket_runs(h[:0], 3) == []
        return
    got = token_output.bucket_runs(h, bits)
    assert [b for b, s, e in got for _ in range(s, e)] == [int(x) >> (64 - bits) for x in h]


@pytest.mark.parametrize("weak", [False, True])
def test_files_when_pieces_share_a_hash_or_buckets_are_many(spark, docs, tmp_path, weak, monkeypatch):
    """``weak``: a dictionary in which other pieces stand under the hashes of half the pieces."""
    path = str(tmp_path / "tokens")
    if weak:
        merge = token_output.merge_pieces
        def broken(parts):
            h, check, n, size, data = merge(parts)
            return h, check ^ (np.arange(len(h)) % 2).astype(np.uint32), n, size, data
        monkeypatch.setattr(token_output, "merge_pieces", broken)
    token_output.write_tokens(docs, path, WORD, 2, bucket_bytes=100, shard_tokens=500)
    got = token_output.digest(token_output.read_tokens(spark, path)).collect()
    tokenizer = Tokenizer.from_file(WORD)
    want = sorted(zlib.crc32(np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in docs.collect())
    assert sorted(r.ids_crc32 for r in got) == want
    assert spark.read.parquet(f"{path}/shards").count() > 16
