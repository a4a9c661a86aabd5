"""Token counts of whole texts; huge documents by overlapping chunks.

The file's split (byte-level BPE) puts white space only at the front of a
pre-token and looks ahead no further than white space reaches, so every place
where a non-white character is followed by white space is a border between
pre-tokens, whatever stands around it.  Such a place is a *stable boundary*.

Documents of at most ``chunk`` characters are cut at all their stable
boundaries and each distinct piece is encoded once per worker.  A longer
document is encoded in chunks that overlap by ``overlap`` characters, with
offsets; two neighbours are spliced at a stable boundary inside the overlap at
which both encodings start a token, counting the left one's tokens before it
and the right one's from it on.  When an overlap holds no such place the left
chunk is encoded again with twice the overlap, at most to the end of the text.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted one by one; an empty table gives an empty result; extra columns
are ignored; special strings in a text are tokens as the library has them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm import encoding

UNSAFE = re.compile(r"[\s\u180e][ \n]|\x01")  # white space before a blank or line end: not every cut below is stable
STABLE = re.compile(r"(?<=[^\s\u180e])(?=[ \t\n\r])")
SLAB_CHARS = 2_000_000


def spliced_count(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """Tokens of ``text`` from overlapping chunks spliced at stable boundaries."""
    def starts(a: int, b: int) -> list[int]:
        return [a + s for s, _ in tokenizer.encode(text[a:b], add_special_tokens=False).offsets]

    n, begin, counted = len(text), 0, 0  # tokens before `begin` are counted; begin is a stable boundary or 0
    left_end = min(n, chunk + overlap)
    left = starts(0, left_end)
    while left_end < n:
        right_begin, wide = left_end - overlap, overlap
        right_end = min(n, right_begin + chunk + overlap)
        right = starts(right_begin, right_end)
        while True:
            # a token may be cut at the end of the left chunk: its last pre-token does not count as agreed
            agreed = set(left) & set(right)
            places = [m.start() for m in STABLE.finditer(text, right_begin + 1, left_end - 1)]
            splice = next((p for p in places if p in agreed and p > begin), None)
            if splice is not None or left_end >= n:
                break
            wide *= 2
            left_end = min(n, right_begin + wide)
            left = starts(begin, left_end)
            if left_end > right_end:
                right_end = min(n, left_end + chunk)
                right = starts(right_begin, right_end)
        if splice is None:
            break
        counted += sum(begin <= s < splice for s in left)
        begin, left, left_end = splice, [s for s in right if s >= splice], right_end
    return counted + sum(s >= begin for s in left)


def counts(tokenizer, path: str, texts: list[str], chunk: int, overlap: int) -> list[int]:
    """Token count of each text."""
    pieces, out = [], [0] * len(texts)
    for k, t in enumerate(texts):
        if len(t) > chunk:
            out[k] = spliced_count(tokenizer, t, chunk, overlap)
            pieces.append([])
        elif not t:
            pieces.append([])
        elif UNSAFE.search(t):
            cuts = [0, *(m.start() for m in STABLE.finditer(t)), len(t)]
            pieces.append([t[a:b] for a, b in zip(cuts, cuts[1:])])
        else:
            pieces.append(t.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01"))
    def encode(missing: list[str]) -> list[int]:
        # a full stop or comma after a letter a-z ends its piece: a pre-token of its own, and one token
        stems = [p[:-1] if len(p) > 2 and p[-1] in ".," and "a" <= p[-2] <= "z" else p for p in missing]
        each = list({s for s in stems if s not in known})
        new = dict(zip(each, map(len, tokenizer.encode_batch_fast(each, add_special_tokens=False))))
        return [(known[s] if s in known else new[s]) + (len(s) < len(p)) for s, p in zip(stems, missing)]

    known = encoding.worker_store().get(("token_counts", path), {})
    memo = encoding.remembered(("token_counts", path), pieces, encode)
    return [n or sum(map(memo.__getitem__, p)) for n, p in zip(out, pieces)]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, chunk: int = 20_000, overlap: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of rows (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding.load(path)
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()
            texts, held, out = [], 0, []
            for k, t in enumerate(batch["text"]):
                texts.append(t.as_py() or "")
                held += size[k]
                if held > SLAB_CHARS:
                    out += counts(tokenizer, path, texts, chunk, overlap)
                    texts, held = [], 0
            out += counts(tokenizer, path, texts, chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(size, pa.int64()), pa.array(out, pa.int64()),
                 pa.array([n > limit for n in out], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return docs.select("doc_id", F.col("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
