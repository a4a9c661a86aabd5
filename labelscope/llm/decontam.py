"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as code points, lower-cased one by one, with every run of
white space as one blank.  A benchmark item of n characters has windows of
``m = min(window, n)`` characters starting at 0, stride, 2 stride, ... and at
n - m.  A document leaks an item when some stretch of it is within
``e = floor(rate * m)`` edits of a window (fewer if the lemma would lose its
bound: at least one shared q-gram must be left).

Lemma: such a stretch shares at least ``T = m + 1 - q * (e + 1)`` q-grams with
the window, all on at most e + 1 neighbouring diagonals (document position
minus item position).  So the diagonals are cut into bands of ``2 * (e + 1)``
that overlap by half, the distinct item positions that hit are counted per
document, window and band, and only regions with T or more are verified, by an
edit-distance alignment confined to the band.  The filter loses nothing.

The benchmark is cut into blocks of about ``block_chars`` characters.  Tasks
write each block's index as array files into the shared folder, workers
memory-map them, and one scan of the documents folds and hashes each text once
and looks it up in all blocks; documents are never shuffled or joined.

Defined results: null and empty texts leak nothing; items shorter than ``q``
(after normalisation), null item ids and null item texts are never found; equal
benchmark rows count once; repeated documents are reported or dropped one by
one; empty tables give empty results; documents of any length are scanned
whole.  Extra columns pass through :func:`filter_documents`.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm import text_kernel as tk
from labelscope.llm.scratch import Buckets, save, scratch_path, shared_file_path, worker_store

BITS = 22
HITS = 1 << 16  # shared q-grams whose windows are looked at together
#: Windows of the usual 13 words; a stride of no more than the edits plus one leaves no passage between two starts.
SHORT = {"window": 64, "stride": 4}
SEPARATOR = np.uint32(0x110000)  # no code point


def _folding() -> np.ndarray:
    """Code point -> its lower case (where that is one code point), white space -> blank."""
    store = worker_store()
    if "folding" not in store:
        table = np.arange(0x110001, dtype=np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000:
                x = chr(c)
                if x.isspace():
                    table[c] = 32
                elif len(y := x.lower()) == 1:
                    table[c] = ord(y)
        store["folding"] = table
    return store["folding"]


def normalise(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document starts -> folded code points, each document closed by SEPARATOR, and starts in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[starts]
    x = np.insert(_folding()[points], before[1:], SEPARATOR)
    blank = x == 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    x = x[keep]
    ends = np.flatnonzero(x == SEPARATOR)
    return x, np.concatenate([[0], ends + 1])


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q code points from each position on."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, done, x = None, 0, x.astype(np.uint64)
    power, size = x, 1  # power: hash of `size` points; built by doubling
    rest = q
    while rest:
        if rest & 1:
            part = power[done:done + n]
            h = part.copy() if h is None else h * np.uint64(tk.ODD) + part
            done += size
        rest >>= 1
        if rest:
            power = power[:-size] * np.uint64(tk.M1 + 2 * size) + power[size:]
            power ^= power >> np.uint64(29)
            size *= 2
    return tk.mix(h)


class Index:
    """q-grams, windows and normalised texts of one block of benchmark items, as arrays."""

    COLUMNS = ("ids", "gram", "first", "owner", "place", "win", "win_of", "win_key", "least", "flag", "points", "text_of")

    def __init__(self, items: list[tuple[int, str]], q: int, window: int, stride: int, rate: float):
        hashes, owner, place, texts, least = [], [], [], [], []
        win = []  # item, start, length, edits, shared q-grams needed
        for k, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").strip().encode(), np.uint8)
            x, _ = normalise(raw, np.array([0, len(raw)]))
            x = x[:-1]
            texts.append(x)
            least.append(1 << 30)
            if len(x) < q:
                continue
            h = gram_hashes(x, q)
            hashes.append(h), owner.append(np.full(len(h), k)), place.append(np.arange(len(h)))
            m = min(window, len(x))
            e = max(0, min(int(rate * m), (m - q) // q))
            least[k] = m + 1 - q * (e + 1)
            for a in sorted({*range(0, len(x) - m + 1, stride), len(x) - m}):
                win.append((k, a, m, e, least[k]))
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        self.ids, self.least = np.array([i for i, _ in items], np.int64), np.array(least, np.int64)
        h = join(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.gram, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.owner, self.place = join(owner, np.int64)[order], join(place, np.int64)[order]
        self.win = np.array(win, np.int64).reshape(-1, 5)
        self.win_of = np.searchsorted(self.win[:, 0], np.arange(len(items) + 1))
        self.win_key = self.win[:, 0] << 32 | self.win[:, 1]
        self.flag = np.zeros(1 << BITS, bool)
        self.flag[(self.gram >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.points, self.text_of = join(texts, np.uint32), np.cumsum([0, *map(len, texts)])

    def write(self, files: str, block: int) -> None:
        for name in self.COLUMNS:
            save(f"{files}/items-{block:05d}.{name}", getattr(self, name))

    @classmethod
    def mapped(cls, buckets: Buckets, block: int) -> Index | None:
        """The block's index over memory-mapped arrays; None if the block has no item."""
        index, parts = cls.__new__(cls), buckets.part(block)
        if parts is None:
            return None
        index.__dict__.update(zip(cls.COLUMNS, parts))
        return index


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated row number, running number inside it) for ``counts`` copies of each row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _count_groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row of a (rows, columns) key, and the group sizes."""
    _, group, n = np.unique(key, axis=0, return_inverse=True, return_counts=True) if key.shape[1] > 1 else np.unique(
        key[:, 0], return_inverse=True, return_counts=True)
    return group.ravel(), n


def banded_edits(x: np.ndarray, at: np.ndarray, stop: np.ndarray, pattern: np.ndarray, width: int) -> np.ndarray:
    """Least edits between each pattern row and any stretch of ``x`` on the
    ``width`` diagonals from ``at`` (document position of the pattern's start);
    positions outside [floor, ``stop``) never match.  ``x`` must be readable at
    every index used, so indices are clipped and marked unequal."""
    n, m = pattern.shape
    lane = np.arange(width)
    cost = np.zeros((n, width), np.int32)  # row 0: a free start on any diagonal
    for r in range(m):
        p = at[:, None] + lane + r  # document position meeting pattern[r] on each diagonal
        ok = (p >= stop[:, :1]) & (p < stop[:, 1:])
        same = ok & (x[np.clip(p, 0, len(x) - 1)] == pattern[:, r:r + 1])
        step = cost + ~same
        skip = np.full_like(cost, m + 1)
        skip[:, :-1] = cost[:, 1:] + 1  # pattern character without a partner
        step = np.minimum(step, skip)
        cost = (np.minimum.accumulate(step - lane, axis=1) + lane).astype(np.int32)  # document characters without one
    return cost.min(axis=1)


def find_leaks(index: Index, x: np.ndarray, ds: np.ndarray, h: np.ndarray, q: int) -> list[tuple[int, int, int, int]]:
    """(document, item number, windows found, least edits) of one slab of texts:
    its code points, the documents' starts in them and the q-grams' hashes."""
    at = np.flatnonzero(index.flag[(h >> np.uint64(64 - BITS)).astype(np.int64)])
    if not len(at) or not len(index.gram):
        return []
    g = np.searchsorted(index.gram, h[at])
    g = np.minimum(g, len(index.gram) - 1)
    hit = index.gram[g] == h[at]
    at, g = at[hit], g[hit]
    row, k = _spread(index.first[g + 1] - index.first[g])
    posting = index.first[g][row] + k
    at, item, j = at[row], index.owner[posting], index.place[posting]
    doc = np.searchsorted(ds, at, "right") - 1
    # a pair of document and item needs as many hits as a window does
    group, n = _count_groups((doc * len(index.ids) + item)[:, None])
    ok = n[group] >= index.least[item]
    doc, item, j, at = doc[ok], item[ok], j[ok], at[ok]
    if not len(doc):
        return []
    # so does each of the two bands that hold a hit's diagonal; all windows of an item allow as many edits
    half = index.win[index.win_of[item], 3] + 1
    cell = (at - j) // half
    key = np.stack([np.tile(doc, 2), np.tile(item, 2), np.concatenate([cell, cell - 1]), np.tile(j, 2)], axis=1)
    key = key[np.lexsort(key.T[::-1])]
    key = key[_changes(key)]  # an item position counts once
    begin = np.flatnonzero(_changes(key[:, :3]))
    n = np.diff(np.append(begin, len(key)))
    ok = n >= index.least[key[begin, 1]]
    begin, n = begin[ok], n[ok]
    found: dict[tuple[int, int], list] = {}  # windows, least edits
    part = (np.cumsum(n) - n) // HITS  # bands are verified by parts: a band holds no more hits than its item has positions
    for p in np.unique(part):
        of_part = part == p
        row, k = _spread(n[of_part])
        _verify(index, x, ds, q, key[begin[of_part][row] + k], found)
    return [(d, i, len(wins), c) for (d, i), (wins, c) in sorted(found.items())]


def _changes(key: np.ndarray) -> np.ndarray:
    """Whether a row of a sorted key differs from the one before."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]).any(axis=1)
    return new


def _verify(index: Index, x: np.ndarray, ds: np.ndarray, q: int, key: np.ndarray, found: dict) -> None:
    """Align the windows of the (document, item, band, item position) rows of
    whole bands that share enough q-grams, and note those within their edits."""
    item, j = key[:, 1], key[:, 3]
    m = index.win[index.win_of[item], 2]
    low = np.searchsorted(index.win_key, item << 32 | np.maximum(j + q - m, 0))
    high = np.searchsorted(index.win_key, item << 32 | j, "right")  # the windows that hold the q-gram
    row, k = _spread(high - low)
    region = np.stack([key[row, 0], low[row] + k, key[row, 2]], axis=1)
    region = region[np.lexsort(region.T[::-1])]
    begin = np.flatnonzero(_changes(region))
    shared = np.diff(np.append(begin, len(region)))
    region = region[begin]
    region = region[shared >= index.win[region[:, 1], 4]]
    for m, e in np.unique(index.win[region[:, 1], 2:4], axis=0):
        part = region[(index.win[region[:, 1], 2] == m) & (index.win[region[:, 1], 3] == e)]
        for s in range(0, len(part), 4096):
            r = part[s:s + 4096]
            start = index.win[r[:, 1], 1]
            texts = index.points[(index.text_of[index.win[r[:, 1], 0]] + start)[:, None] + np.arange(m)]
            origin = r[:, 2] * (e + 1) + start - e
            cost = banded_edits(x, origin, np.stack([ds[r[:, 0]], ds[r[:, 0] + 1] - 1], axis=1), texts, 2 * (e + 1) + 2 * e)
            for (d, w, _), c in zip(r[cost <= e].tolist(), cost[cost <= e].tolist()):
                seen = found.setdefault((d, int(index.win[w, 0])), [set(), c])
                seen[0].add(w)
                seen[1] = min(seen[1], c)


def write_index(benchmark: DataFrame, q: int, window: int, stride: int, rate: float, block_chars: int) -> tuple[str, int]:
    """(folder, number of blocks) of the benchmark's index files, written by the tasks."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    files = shared_file_path(scratch_path(spark, "benchmark"))
    os.makedirs(files, exist_ok=True)

    def build(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        rows = sorted(zip(table["item_id"].to_pylist(), table["text"].to_pylist()))
        Index(rows, q, window, stride, rate).write(files, block)
        return pa.table({"block": pa.array([block], pa.int32())})
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")
    items.withColumn("block", block).groupBy("block").applyInArrow(build, "block int").count()
    return files, n


def slab_leaks(buckets: Buckets, blocks: int, q: int, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item id, windows found, least edits) of one slab of texts, folded and hashed once for all blocks."""
    x, ds = normalise(data, starts)
    h = gram_hashes(x, q)
    for block in range(blocks):
        index = Index.mapped(buckets, block)
        if index is not None:
            for d, i, n, c in find_leaks(index, x, ds, h, q):
                yield d, int(index.ids[i]), n, c


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = 12, window: int = 100, stride: int = 25, rate: float = 0.05,
          block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, n_windows, least_edits): a row for each row of ``docs`` and item it leaks."""
    files, blocks = write_index(benchmark, q, window, stride, rate, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(files, "items", Index.COLUMNS)
        for batch in batches:
            for row, data, starts in tk.text_slabs(batch["text"]):
                got = list(slab_leaks(buckets, blocks, q, data, starts))
                if got:
                    d, i, n, c = zip(*got)
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].take(pa.array([row + k for k in d])).cast(pa.int64()), pa.array(i, pa.int64()),
                         pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["doc_id", "item_id", "n_windows", "least_edits"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, n_windows long, least_edits long")


def filter_documents(docs: DataFrame, benchmark: DataFrame, q: int = 12, window: int = 100, stride: int = 25,
                     rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    files, blocks = write_index(benchmark, q, window, stride, rate, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(files, "items", Index.COLUMNS)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, data, starts in tk.text_slabs(batch["text"]):
                for d, *_ in slab_leaks(buckets, blocks, q, data, starts):
                    keep[row + d] = False
            yield batch.filter(pa.array(keep))
    return docs.mapInArrow(run, docs.schema)
