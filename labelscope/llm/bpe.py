"""Byte-level BPE by contiguous rank arrays: encoding and decoding of whole texts.

The vocabulary, merges and added tokens are read from a tokenizers ``.json``
file (byte-level split by its own pattern, no normalizer); nothing of that
library encodes or decodes here.

Words.  A text is cut at added tokens and then at the borders of the file's
split, found for a whole slab at once from the class of every character
(letter, number, white space, other).  The class of a character outside ASCII
is asked of the library's split once, so both know the same Unicode.

Merging.  Each distinct word of a slab is merged once.  Words of similar length
form the rows of three matrices that stay contiguous: the boundaries of the
word's parts, the parts' ids, and the rank of every two neighbours.  Each round
scans the ranks of all rows for the first minimum, deletes that boundary,
moves what is right of it one place to the left, and refreshes the ranks on
both sides; rows without a mergeable pair are finished.  Words longer than
``SHORT`` bytes, where scanning would be quadratic, keep the ranks in a heap
and the parts in a linked list instead; they give the same ids.

Decoding joins the bytes of the ids; what is not UTF-8 becomes U+FFFD.

A text longer than a slab is cut where white space follows another character:
no word holds such a place and none looks past it.  So memory follows the slab,
except for a single longer word.  Nothing is shuffled.

Defined results: null and empty texts have no ids; the strings of added tokens
inside texts are these tokens, as the library has it by default; repeated rows
and rows without ``doc_id`` are encoded one by one; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from labelscope.llm.scratch import worker_store

SLAB = 1 << 22
SHORT = 256
WIDTHS = (*range(2, 13), 16, 24, 32, 64, 128, SHORT)
ROWS = 1 << 14
NEVER = np.iinfo(np.int32).max
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """The tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        split, model = file["pre_tokenizer"] or {}, file["model"]
        plain = file["normalizer"] is None and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"]
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        byte_of = byte_characters()
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip")) or any(re.search(r"\s", t) for t in added):
            raise ValueError(f"{path} has added tokens that take in or hold white space")
        vocabulary = model["vocab"] | added
        size = max(vocabulary.values()) + 1
        spelled = [b""] * size
        for token, i in vocabulary.items():
            whole = all(c in byte_of for c in token)
            spelled[i] = bytes(byte_of[c] for c in token) if whole else token.encode()
        self.spelled = pa.array(spelled, pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in range(size)], pa.large_binary())
        self.sizes = np.array([len(s) for s in spelled], np.int64)
        self.byte_id = np.array([vocabulary[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        order = np.argsort(key)
        self.pair, self.pair_rank = key[order], order.astype(np.int32)
        self.added = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.added_id, self.path = added, path
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of joining ``left`` and ``right``; NEVER if they are no pair."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], NEVER)

    def classify(self, points: np.ndarray) -> np.ndarray:
        """Class of every code point, new ones as the library's split sees them beside a letter, a number and a sign."""
        out = self.classes[points]
        if (out == UNKNOWN).any():
            from tokenizers.pre_tokenizers import ByteLevel
            split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
            for p in np.unique(points[out == UNKNOWN]):
                beside = (len(split(c + chr(p))) == 1 for c in "a1!")
                self.classes[p] = next((k for k, one in zip((LETTER, NUMBER, OTHER), beside) if one), SPACE)
            out = self.classes[points]
        return out

    def word_starts(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether a word starts at each code point; ``starts`` are those of independent texts."""
        n = len(points)
        kind = self.classify(points)
        first = np.zeros(n + 1, bool)
        first[starts] = first[n] = True
        change = first[:n].copy()
        change[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        ends = np.append(change[1:], True)           # last character of a run
        last = space & ends & ~first[1:]             # last white space before another character of the same text
        begin = change | last
        blank = np.flatnonzero(last & (points == 32))
        begin[blank + 1] = False                     # a blank goes with the word after it
        quote = np.flatnonzero((points == 39) & begin & ends & ~first[1:])
        quote = quote[kind[quote + 1] == LETTER]     # a sign of its own before a letter: 's 't 'm 'd 're 've 'll
        one = points[quote + 1]
        after = np.append(points, 0)[np.minimum(quote + 2, n)]
        after[first[np.minimum(quote + 2, n)]] = 0
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.isin(one * 128 + np.where(after < 128, after, 0), [ord(a) * 128 + ord(b) for a, b in ("re", "ve", "ll")])
        short = quote[single | double]
        begin[short + 1] = False
        stop = short + np.where(single, 2, 3)[single | double]
        begin[stop[stop < n]] = True
        return begin

    def merge_rows(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, boundaries) of words of 2 to ``width`` bytes: a row each, boundaries closed by the word's size, then -1."""
        column = np.arange(width + 1)
        edge = np.where(column <= size[:, None], column, -1).astype(np.int16)
        inside = column < size[:, None]
        part = np.where(inside, self.byte_id[data[np.minimum(start[:, None] + column, len(data) - 1)]], -1).astype(np.int32)
        rank = np.where(inside[:, 1:], self.ranks(part[:, :-1], part[:, 1:]), NEVER)  # rank[:, i]: parts i and i + 1
        out_part, out_edge = part.copy(), edge.copy()
        row = np.arange(len(size))
        while len(row):
            here = np.arange(len(row))
            at = rank.argmin(1)
            best = rank[here, at]
            live = best < NEVER
            if not live.all():
                done = ~live
                out_part[row[done], :part.shape[1]], out_edge[row[done], :edge.shape[1]] = part[done], edge[done]
                out_part[row[done], part.shape[1]:], out_edge[row[done], edge.shape[1]:] = -1, -1
                row, part, edge, rank, at, best = row[live], part[live], edge[live], rank[live], at[live], best[live]
                here = np.arange(len(row))
                if not len(row):
                    break
            # delete boundary at + 1: what is right of it moves one place to the left
            moved = column[:part.shape[1] - 1] > at[:, None]
            part = np.where(moved, part[:, 1:], part[:, :-1])
            edge = np.where(moved, edge[:, 1:], edge[:, :-1])
            rank = np.where(moved[:, :-1], rank[:, 1:], rank[:, :-1]) if rank.shape[1] > 1 else np.full((len(row), 1), NEVER, np.int32)
            part[here, at] = self.merged[best]
            # refresh the neighbours
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.ranks(part[left, at[left] - 1], part[left, at[left]])
            if part.shape[1] > 1:
                follow = part[here, np.minimum(at + 1, part.shape[1] - 1)]
                fresh = np.where((follow >= 0) & (at + 1 < part.shape[1]), self.ranks(part[here, at], np.maximum(follow, 0)), NEVER)
                inner = np.flatnonzero(at < rank.shape[1])
                rank[inner, at[inner]] = fresh[inner]
        return out_part, out_edge

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of a word of any length, by a heap of ranks over a linked list of parts."""
        part = self.byte_id[np.frombuffer(word, np.uint8)]
        rank = self.ranks(part[:-1], part[1:])
        part, n = part.tolist(), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i, r in enumerate(rank.tolist()) if r < NEVER]
        heapq.heapify(heap)
        table = worker_store().setdefault(("bpe pairs", self.path), {}) or worker_store()["bpe pairs", self.path]
        if not table:
            table.update(zip(self.pair.tolist(), self.pair_rank.tolist()))
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if part[i] == a else n
            if j >= n or part[j] != b:
                continue  # one of them has been merged meanwhile
            part[i], part[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (new := table.get(part[x] << 32 | part[y])) is not None:
                    heapq.heappush(heap, (new, x, part[x], part[y]))
        return [p for p in part if p >= 0]

    def merge_words(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the distinct words one after another, index of each word's first, with the end)."""
        offset = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
        size = np.diff(offset)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (word, place in it, id)
        one = np.flatnonzero(size == 1)
        found.append((one, np.zeros(len(one), np.int64), self.byte_id[data[offset[one]]]))
        low = 2
        for width in WIDTHS:
            rows = np.flatnonzero((size >= low) & (size <= width))
            low = width + 1
            step = max(64, ROWS * 8 // width)
            for s in range(0, len(rows), step):
                some = rows[s:s + step]
                part, _ = self.merge_rows(data, offset[some], size[some], width)
                row, place = np.nonzero(part >= 0)
                found.append((some[row], place, part[row, place]))
        for k in np.flatnonzero(size > SHORT):
            ids = np.array(self.merge_long(data[offset[k]:offset[k + 1]].tobytes()), np.int32)
            found.append((np.full(len(ids), k), np.arange(len(ids)), ids))
        word = np.concatenate([f[0] for f in found])
        count = np.bincount(word, minlength=len(words))
        first = np.concatenate([[0], np.cumsum(count)])
        ids = np.empty(len(word), np.int32)
        ids[first[word] + np.concatenate([f[1] for f in found])] = np.concatenate([f[2] for f in found])
        return ids, first

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, index of each text's first, with the end)."""
        pieces, owner, special = [], [], []
        for k, t in enumerate(texts):
            at = 0
            for m in self.added.finditer(t) if self.added and self.added.search(t) else ():
                pieces += [t[at:m.start()], m[0]]
                special += [-1, self.added_id[m[0]]]
                owner += [k, k]
                at = m.end()
            pieces.append(t[at:])
            special.append(-1)
            owner.append(k)
        joined = "".join(pieces)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        length = np.array([len(p) for p in pieces])
        start = np.concatenate([[0], np.cumsum(length)])
        data = np.frombuffer(joined.encode(), np.uint8)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = self.word_starts(points, start[:-1][length > 0])
        special, owner = np.array(special), np.array(owner)
        for p in np.flatnonzero(special >= 0):
            begin[start[p] + 1:start[p + 1]] = False  # an added token is one word
        word = np.flatnonzero(begin)
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte of every code point
        offset = np.append(place[word], len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(word), [None, pa.py_buffer(offset), pa.py_buffer(data)]).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        ids, first = self.merge_words(coded.dictionary)
        if (special >= 0).any():  # their words get rows of their own behind the others
            which = np.searchsorted(word, start[:-1][special >= 0])
            code[which] = len(first) - 1 + np.arange(len(which))
            ids = np.concatenate([ids, special[special >= 0].astype(np.int32)])
            first = np.concatenate([first, first[-1] + 1 + np.arange(len(which))])
        size = np.diff(first)[code]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.arange(total[-1]) + np.repeat(first[code] - total[:-1], size)]
        text_start = start[np.searchsorted(owner, np.arange(len(texts) + 1))]
        return flat, total[np.searchsorted(word, text_start)]

    def spell(self, ids: np.ndarray, table: pa.LargeBinaryArray) -> tuple[memoryview, np.ndarray]:
        """(the table's bytes of the ids one after another, offset of each id's bytes, with the end)."""
        out = table.take(pa.array(ids))
        return memoryview(out.buffers()[2] or b""), np.frombuffer(out.buffers()[1], np.int64)[:len(ids) + 1]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids as decode(ids, skip_special_tokens=False) has it; an id that the file lacks has none."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.spelled))]
        return bytes(self.spell(ids, self.spelled)[0]).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """The tables of ``path``, once per Python worker."""
    store = worker_store()
    if ("bpe", path) not in store:
        store["bpe", path] = Codec(path)
    return store["bpe", path]


def cut(text: str, slab: int) -> list[str]:
    """A text in parts of about ``slab`` characters, cut where a blank or line end follows another character."""
    out, at = [], 0
    stable = re.compile(r"(?<=[^\s\x1c-\x1f\x85\u180e])(?=[ \n])")
    while len(text) - at > slab:
        place = stable.search(text, at + slab)
        if place is None:
            break
        out.append(text[at:place.start()])
        at = place.start()
    return [*out, text[at:]]


def groups(column: pa.Array, slab: int) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, their texts or parts of texts in order) of about ``slab`` bytes each; null texts are empty."""
    size = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    rows, texts, held = [], [], 0
    for row, t in enumerate(column):
        for part in cut(t.as_py() or "", slab) if size[row] > slab else [t.as_py() or ""]:
            rows.append(row), texts.append(part)
            held += len(part) if size[row] > slab else size[row]
            if held >= slab:
                yield rows, texts
                rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def encode(docs: DataFrame, path: str, slab: int = SLAB) -> DataFrame:
    """(doc_id, ids) of rows (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(path)
        for batch in batches:
            held, last = [], None  # ids of the last row so far: its text may go on in the next group

            def rows_of(rows: list[int], ids: list[np.ndarray]) -> pa.RecordBatch:
                offset = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
                return pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(rows, pa.int64())).cast(pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))], ["doc_id", "ids"])
            for rows, texts in groups(batch["text"], slab):
                flat, at = tables.encode(texts)
                out_rows, out_ids = [], []
                for k, row in enumerate(rows):
                    if last is not None and row != last:
                        out_rows.append(last), out_ids.append(np.concatenate(held))
                        held = []
                    held.append(flat[at[k]:at[k + 1]])
                    last = row
                if out_rows:
                    yield rows_of(out_rows, out_ids)
            if last is not None:
                yield rows_of([last], [np.concatenate(held)])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids are none, and an id that the file lacks has no text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(path)
        for batch in batches:
            texts = [tables.decode([i for i in ids.as_py() or [] if i is not None]) for ids in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, slab: int = SLAB) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again, in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(path)
        for batch in batches:
            n = batch.num_rows
            tokens, hashes = np.zeros(n, np.int64), [None] * n
            for rows, texts in groups(batch["text"], slab):
                flat, at = tables.encode(texts)
                said, said_at = tables.spell(flat, tables.decimal)
                read, read_at = tables.spell(flat, tables.spelled)
                for k, row in enumerate(rows):
                    a, b = at[k], at[k + 1]
                    ids_hash, text_hash = hashes[row] = hashes[row] or (hashlib.sha256(), hashlib.sha256())
                    if b > a:
                        if tokens[row]:
                            ids_hash.update(b",")
                        ids_hash.update(said[said_at[a]:said_at[b] - 1])
                        text_hash.update(str(read[read_at[a]:read_at[b]], "utf-8", "replace").encode())
                    tokens[row] += b - a
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(tokens), pa.array([h[0].hexdigest() for h in hashes], pa.string()),
                 pa.array([h[1].hexdigest() for h in hashes], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
