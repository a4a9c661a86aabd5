"""Word and n-gram hashes of whole Arrow batches with numpy.

A batch's UTF-8 bytes are hashed in one pass: every byte stands for a random
64-bit value (where asked, A-Z those of a-z), words are the runs between the bytes
0x20 and 0x09-0x0D, and a word's hash is the polynomial of its bytes taken
from running sums.  Work goes in slabs of about ``SLAB`` bytes, cut between
documents, so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from labelscope.llm.scratch import worker_store

SLAB = 1 << 20
STEP = 1 << 14
M1, M2, ODD = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(M2)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, white space flags, powers and inverse powers, for ``n`` bytes at least."""
    store = worker_store()
    got = store.get("byte_tables")
    if got is None or len(got[2]) < n:
        value = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        size = max(n, SLAB * 2)
        base = np.uint64(6364136223846793005)
        inverse = np.uint64(pow(6364136223846793005, -1, 1 << 64))
        power = np.full(size, base, np.uint64)
        power[0] = 1
        back = np.full(size, inverse, np.uint64)
        back[0] = 1
        got = store["byte_tables"] = (value, space, np.multiply.accumulate(power), np.multiply.accumulate(back))
    return got


def text_slabs(column: pa.Array, slab: int = SLAB) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, document starts) of successive groups of whole documents; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + slab, "right")) - 1)
        b = min(b, n)
        yield a, data[offsets[a]:offsets[b]], (offsets[a:b + 1] - offsets[a])
        a = b


def word_spans(data: np.ndarray, starts: np.ndarray, split_stops: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(first, last byte) of every word.  ``split_stops``: a full stop or comma
    between a letter a-z and the word's end is a word of its own."""
    n = len(data)
    inside = ~_tables(n + 1)[1][data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    inner = starts[(starts > 0) & (starts < n)]
    begins[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    if split_stops:
        stop = np.flatnonzero(ends & ((data == 46) | (data == 44)) & ~begins)
        stop = stop[(data[stop - 1] >= 97) & (data[stop - 1] <= 122)]
        begins[stop] = True
        ends[stop - 1] = True
    return np.flatnonzero(begins), np.flatnonzero(ends)


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hash of the bytes of every span; ``fold``: A-Z as a-z."""
    n = len(data)
    value, _, power, back = _tables(n + 1)
    if fold:
        value = value.copy()
        value[65:91] = value[97:123]
    total, carry = np.empty(n, np.uint64), np.uint64(0)
    for s in range(0, n, STEP):  # in pieces that stay in the processor's cache
        part = total[s:s + STEP]
        np.cumsum(value[data[s:s + STEP]] * power[s:s + len(part)], out=part)
        part += carry
        carry = part[-1]
    h = total[last]
    nz = first > 0
    h[nz] -= total[first[nz] - 1]
    h *= back[first]
    return mix(h + (last - first + 1).astype(np.uint64) * np.uint64(ODD))


def span_ends(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A number for the size and the first and last 8 bytes of every span."""
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size = last - first + 1
    mask = np.uint64((1 << 64) - 1) >> (64 - 8 * np.minimum(size, 8)).astype(np.uint64)
    head, tail = eight[first] & mask, eight[np.maximum(last - 7, first)] & mask
    return (head * np.uint64(ODD)) ^ tail ^ (size.astype(np.uint64) << np.uint64(40))


def distinct_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, 32 bits of the size and ends, a span, number of each span) of the
    distinct spans by hash; spans of one hash that differ in size or ends stay apart."""
    h, ends = span_hashes(data, first, last, fold=False), span_ends(data, first, last)
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = np.diff(h[order]) != 0
    one, back = order[new], np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    if (ends != ends[one][back]).any():  # spans that share a hash: put equal ones together
        order = np.lexsort((ends, h))
        new[1:] = (np.diff(h[order]) != 0) | (np.diff(ends[order]) != 0)
        one = order[new]
        back[order] = np.cumsum(new) - 1
    return h[one], (mix(ends[one]) >> np.uint64(32)).astype(np.uint32), one, back


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, index of each document's first word, with the end)."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    first, last = word_spans(data, starts)
    return span_hashes(data, first, last), np.searchsorted(first, starts)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Index that takes the runs [start, start + size) one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def windows(words: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of ``k`` words inside one document."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(ODD) + words[i:i + n] + np.uint64(i + 1)) if i in (0, k - 1) \
            else h * np.uint64(ODD) + words[i:i + n]
    owner = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
    ok = owner[:n] == owner[k - 1:]
    return h[ok], owner[:n][ok]


def shingle_sets(words: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes by document, index of each document's
    first, with the end).  A shorter text is one shingle; no word, no shingle."""
    h, owner = windows(words, docs, k)
    n_words = np.diff(docs)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        one = np.empty(len(short), np.uint64)
        for j, d in enumerate(short):
            x = np.zeros(1, np.uint64)
            for w in words[docs[d]:docs[d + 1]]:
                x = mix(x * np.uint64(M1) + w)
            one[j] = mix(x + np.uint64(n_words[d]))[0]
        h, owner = np.concatenate([h, one]), np.concatenate([owner, short])
    order = np.lexsort((h, owner)) if len(short) else None
    if order is None:  # owners ascend already: sort the hashes inside each document
        order = np.argsort(h)
        order = order[np.argsort(owner[order], kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(docs)))
