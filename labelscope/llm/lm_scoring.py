"""LM scoring: an interpolated modified Kneser-Ney n-gram model.

Words.  Tokens are the words of a text (A-Z as a-z) and one end mark; n - 1
begin marks stand before the first.  A first pass counts them and numbers the
distinct ones; the ``FREQUENT`` most frequent have the lowest numbers.

Counting.  Tasks count n-grams of word numbers locally, cut them by bucket and
pack each piece (its different words as steps, n-grams as places among them);
Spark shuffles one binary run per piece.  Each bucket is merged in one group
whose size follows ``bucket_tokens``, not the corpus.  From a bucket of order k
come its n-grams with their counts, the totals and the numbers of continuations
(N1, N2, N3+) of its contexts, the counts of counts for the discounts, and the
runs of order k - 1, where an n-gram counts once for each different word before
it.

An n-gram's bucket is that of the shortest end of its context that is not hot,
so a context is complete in its bucket, and the n-grams of order k - 1 mostly
stay in the bucket of those they come from.  A context is hot if it stands
before more than an eighth of a bucket's tokens; those whose every end is hot
are spread by the whole n-gram, and Spark sums their totals.  The first pass finds
the hot ones: each is above that share in some task's tokens.

Storage.  Every order and bucket is a set of sorted arrays in the shared
folder, written under a temporary name and renamed, so a repeated task leaves
one result.  Of a sorted hash the bucket and the slot of a directory give the
first bits, the next 40 are kept.  Workers memory-map the arrays; a slab of
text looks its distinct n-grams up in sorted order.  Counts are one byte
each, larger ones in a side array.

Model, with D1, D2, D3+ from the counts of counts of each order:
    p_k(w|h) = max(c(hw) - D(c), 0) / T(h) + (D1 N1 + D2 N2 + D3 N3) / T(h) * p_{k-1}(w|h')
down to the uniform 1 / (V + 1); a context never seen passes p_{k-1} through.

Defined results: null and empty texts are the end mark alone; with no training
document every probability is uniform; repeated rows count and are scored one
by one; an empty table gives an empty result; a null ``doc_id`` is training
text (its remainder is unknown, not 0); extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm import text_kernel as tk
from labelscope.llm.scratch import Buckets, Parking, map_array, save, scratch_path, shared_file_path

BEGIN, END = np.uint64(0x5BD1E995A3C59AC3), np.uint64(0xC2B2AE3D27D4EB4F)
HELD = 2_000_000  # tokens that a counting task holds before it passes runs on
FREQUENT = 1 << 16  # words that are numbered by frequency
START, UNKNOWN = np.uint64(0), np.uint64((1 << 64) - 1)  # numbers of the begin mark and of words not in the vocabulary
SCORE_SLAB = 1 << 22
KEPT = 40  # bits of a hash kept beyond bucket and slot


def token_stream(words: np.ndarray, docs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns of each token's n-gram, index of each document's first token with the end)."""
    n_docs, n_words = len(docs) - 1, np.diff(docs)
    pad = order - 1
    first = docs[:-1] + np.arange(n_docs) * (pad + 1)  # where a document's begin marks stand
    stream = np.full(len(words) + n_docs * (pad + 1), END, np.uint64)
    stream[(first[:, None] + np.arange(pad)).ravel()] = BEGIN
    place = np.arange(len(words)) + np.repeat(np.arange(n_docs) * (pad + 1) + pad, n_words)
    stream[place] = words
    starts = docs + np.arange(n_docs + 1)
    at = np.arange(len(words) + n_docs) + np.repeat(np.arange(n_docs) + 1, n_words + 1) * pad
    return np.stack([stream[at - pad + i] for i in range(order)]), starts


def hash_columns(columns: np.ndarray) -> np.ndarray:
    h = np.full(columns.shape[1], len(columns), np.uint64)
    for c in columns:
        h = tk.mix(h * np.uint64(tk.ODD) + c)
    return h


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the different keys in order, a row of each, the place of every row's key among them)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], order[new], back


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, np.int64)


def merged(columns: np.ndarray, keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, key, count) of the distinct n-grams, by key; ``counts`` None: one each."""
    order = np.argsort(keys)
    keys = keys[order]
    first = firsts(keys)
    n = np.diff(first, append=len(keys)) if counts is None else sums(counts[order], first)
    return columns[:, order[first]], keys[first], n


class Routes:
    """Keys of n-grams and contexts: the first ``bits`` bits are the bucket."""

    def __init__(self, files: str, bits: int):
        self.files, self.bits = files, np.uint64(bits)
        self.hot_contexts = Buckets(files, "hot", ("context",))

    def hot(self, context: np.ndarray) -> np.ndarray:
        """Which context hashes are hot; few files hold them all."""
        out = np.zeros(len(context), bool)
        part = hot_file(context, int(self.bits))
        for f in (np.unique(part) if int(self.bits) > 8 else [0]):
            known = self.hot_contexts.part(int(f))
            if known is not None and len(known[0]):
                rows = np.flatnonzero(part == f)
                at = np.minimum(np.searchsorted(known[0], context[rows]), len(known[0]) - 1)
                out[rows] = known[0][at] == context[rows]
        return out

    def key(self, route: np.ndarray, own: np.ndarray) -> np.ndarray:
        low = np.uint64(64) - self.bits
        return (route >> low << low) | (own >> self.bits)

    def ends(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of contexts: (hash of the shortest end that is not hot, whether there is none: the
        context is spread, the context's key: its hash if it is spread)."""
        k = len(context)
        route, spread = np.zeros(context.shape[1], np.uint64), np.ones(context.shape[1], bool)
        for j in range(1, k + 1):
            h = hash_columns(context[k - j:])
            cold = spread & ~self.hot(h)
            route[cold] = h[cold]
            spread &= ~cold
        return route, spread, np.where(spread, h, self.key(route, h))

    def keys(self, columns: np.ndarray) -> np.ndarray:
        """Keys of n-grams."""
        own = hash_columns(columns)
        if len(columns) == 1:
            return own
        route, spread, _ = self.ends(columns[:-1])
        return np.where(spread, own, self.key(route, own))


def hot_file(context: np.ndarray, bits: int) -> np.ndarray:
    """Number of the file that a hot context is in: one for 256 buckets."""
    return (context >> np.uint64(64 - bits + 8)).astype(np.int64) if bits > 8 else np.zeros(len(context), np.int64)


def run_rows(kind: str, columns: np.ndarray, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row (kind, bucket, run) per bucket of n-grams sorted by key."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = firsts(bucket)
    data = []
    for a, b in zip(first, np.append(first[1:], len(bucket))):
        place = a + np.argsort(columns[0, a:b])
        data.append(pack_run(columns[:, place], counts[place]))
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(first)), pa.array(bucket[first], pa.int32()), pa.array(data, pa.binary())],
                                      ["kind", "bucket", "run"])


def planes(values: np.ndarray, width: int) -> np.ndarray:
    """The numbers' bytes, all first ones, all second ones, and so on."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T


def pack_run(columns: np.ndarray, counts: np.ndarray) -> bytes:
    """A run sorted by its first column as its different words (in order, as steps), the n-grams
    as numbers of words (the first ones as steps), and its counts."""
    coded = pa.array(columns.ravel()).dictionary_encode()
    words = coded.dictionary.to_numpy().astype(np.uint64)
    order = np.argsort(words)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words, index = words[order], rank[coded.indices.to_numpy()].reshape(columns.shape)
    steps = np.diff(words, prepend=np.uint64(0))
    wide = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    width = max(1, (len(words).bit_length() + 7) // 8)
    large = np.flatnonzero(counts > 254)
    size = np.array([columns.shape[1], len(words), len(large), width, wide], np.int64)
    data = b"".join(np.ascontiguousarray(x).tobytes() for x in (
        size, large.astype(np.int64), counts[large].astype(np.int64), planes(steps, wide), np.minimum(counts, 255).astype(np.uint8),
        np.diff(index[0], prepend=0).astype(np.int32).view(np.uint8).reshape(-1, 4).T, planes(index[1:].ravel(), width)))
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def read_run(run: bytes, order: int) -> tuple[np.ndarray, np.ndarray]:
    data = pa.Codec("zstd").decompress(run[8:], int.from_bytes(run[:8], "little"))
    n, m, n_large, width, wide = (int(x) for x in np.frombuffer(data, np.int64, 5))
    at = 40

    def take(dtype, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype, k, at)
        at += out.nbytes
        return out

    def numbers(k: int, bytes_each: int) -> np.ndarray:
        out = np.zeros((k, 8), np.uint8)
        out[:, :bytes_each] = take(np.uint8, bytes_each * k).reshape(bytes_each, k).T
        return out.view("<u8").ravel()
    large, more = take(np.int64, n_large), take(np.int64, n_large)
    words = np.cumsum(numbers(m, wide), dtype=np.uint64)
    counts = take(np.uint8, n).astype(np.int64)
    counts[large] = more
    steps = np.ascontiguousarray(take(np.uint8, 4 * n).reshape(4, n).T).view(np.int32).ravel()
    rest = numbers(n * (order - 1), width).reshape(order - 1, n)
    return words[np.concatenate([np.cumsum(steps)[None], rest.astype(np.int64)])], counts


def read_runs(runs: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [read_run(x, order) for x in runs]
    return np.concatenate([c for c, _ in parts], axis=1), np.concatenate([n for _, n in parts])


def save_keys(base: str, keys: np.ndarray, bits: int) -> None:
    """Sorted keys of a bucket: a directory of slots by the bits after the bucket's, and the KEPT bits after those."""
    deep = min(max(0, len(keys).bit_length() - 3), 64 - bits - KEPT)
    inside = keys << np.uint64(bits)
    slots = np.arange(1, 1 << deep, dtype=np.uint64) << np.uint64(64 - deep) if deep else np.zeros(0, np.uint64)
    rest = (inside << np.uint64(deep)) >> np.uint64(64 - KEPT)
    save(f"{base}.low", rest.astype(np.uint32)), save(f"{base}.high", (rest >> np.uint64(32)).astype(np.uint8))
    save(f"{base}.slot", np.concatenate([[0], np.searchsorted(inside, slots), [len(keys)]]).astype(np.uint32))


def find_keys(part: list[np.ndarray], keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key is in a bucket's arrays low, high, slot; its place)."""
    low, high, slot = part
    deep = (len(slot) - 1).bit_length() - 1
    inside = keys << np.uint64(bits)
    s = (inside >> np.uint64(64 - deep)).astype(np.int64) if deep else np.zeros(len(keys), np.int64)
    rest = ((inside << np.uint64(deep)) >> np.uint64(64 - KEPT)).astype(np.int64)
    a, b = slot[s].astype(np.int64), slot[s + 1].astype(np.int64)
    end = b.copy()
    last = len(low) - 1
    while last >= 0 and (a < b).any():  # halve every key's slot at once
        mid = (a + b) >> 1
        at = np.minimum(mid, last)
        less = (a < b) & ((high[at].astype(np.int64) << 32 | low[at]) < rest)
        b = np.where((a < b) & ~less, mid, b)
        a = np.where(less, mid + 1, a)
    if last < 0:
        return np.zeros(len(keys), bool), a
    at = np.minimum(a, last)
    return (a < end) & ((high[at].astype(np.int64) << 32 | low[at]) == rest), at


def flushes(batches: Iterator[pa.RecordBatch], order: int, words_of=None) -> Iterator[np.ndarray]:
    """Columns of about HELD tokens' n-grams, of word hashes, or of what ``words_of`` makes of the distinct ones."""
    held, n = [], 0

    def flush() -> np.ndarray:
        columns = np.concatenate(held, axis=1)
        if words_of is None:
            return columns
        coded = pa.array(columns.ravel()).dictionary_encode()
        return words_of(coded.dictionary.to_numpy().astype(np.uint64))[coded.indices.to_numpy()].reshape(columns.shape)

    for batch in batches:
        for _, data, starts in tk.text_slabs(batch["text"]):
            held.append(token_stream(*tk.word_hashes(data, starts), order)[0])
            n += held[-1].shape[1]
            if n >= HELD:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def count_words(docs: DataFrame, order: int, bits: int, share: float) -> DataFrame:
    """(kind, bucket, run) of the words of every text, and of the contexts that stand
    before more than ``share`` of a task's tokens (with the number of all its tokens)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in flushes(batches, order):
            words, keys, counts = merged(columns[-1:], columns[-1], None)
            yield run_rows("word", words, keys, counts, bits)
            for j in range(1, order):
                part = columns[order - 1 - j:order - 1]
                context, keys, counts = merged(part, hash_columns(part), None)
                some = counts > share * columns.shape[1]
                context, counts = context[:, some], counts[some]
                place = np.argsort(context[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"hot{j}"]), pa.array([columns.shape[1]], pa.int32()), pa.array([pack_run(context[:, place], counts[place])], pa.binary())],
                    ["kind", "bucket", "run"])
    return docs.select("text").mapInArrow(run, "kind string, bucket int, run binary")


def write_vocabulary(counted: DataFrame, folder: str, bits: int, parking: Parking) -> DataFrame:
    """Merge the words of each bucket; (bucket, numbers, words, counts): its totals and its most frequent words."""
    keep = max(16, (4 * FREQUENT) >> bits)

    def group(table: pa.Table) -> pa.Table:
        columns, counts = read_runs(table["run"].to_pylist(), 1)
        words, keys, counts = merged(columns, columns[0], counts)
        base = f"{folder}/vocabulary-{table['bucket'][0].as_py():05d}"
        large = np.flatnonzero(counts > 254)
        save(f"{base}.gram", keys), save(f"{base}.count", np.minimum(counts, 255).astype(np.uint8))
        save(f"{base}.large", np.stack([keys[large], counts[large].astype(np.uint64)]))
        top = np.lexsort((keys, -counts))[:keep]
        return pa.table([table["bucket"].slice(0, 1), pa.array([[int(counts.sum()), len(counts)]], pa.list_(pa.int64())),
                         pa.array([keys[top].view(np.int64)]), pa.array([counts[top].astype(np.int64)])],
                        names=["bucket", "numbers", "words", "counts"])
    return parking.park(counted.where("kind = 'word'").groupBy("bucket").applyInArrow(
        group, "bucket int, numbers array<long>, words array<long>, counts array<long>"), "vocabulary")


def write_frequent(found: DataFrame, files: str) -> None:
    """Number the most frequent words: at most FREQUENT rows."""
    top = found.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select("w.words", "w.counts").orderBy(
        F.desc("counts"), "words").limit(FREQUENT).toPandas()["words"].to_numpy(np.int64).view(np.uint64)
    place = np.argsort(top)
    save(f"{files}/frequent-00000.word", top[place]), save(f"{files}/frequent-00000.rank", (place + 1).astype(np.uint64))


class Words:
    """Numbers of words: 1 to FREQUENT by frequency, the others after those by their place in the vocabulary."""

    def __init__(self, model: dict):
        self.files, self.bits, self.base = model["files"], model["word_bits"], map_array(f"{model['files']}/vocabulary.base")
        self.vocabulary = Mapped(self.files, "vocabulary", ("gram", "count", "large"), self.bits)
        self.frequent = Buckets(self.files, "frequent", ("word", "rank"))

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Numbers of distinct words by hash."""
        out, order = np.full(len(words), UNKNOWN), np.argsort(words)
        for bucket, _, rows, at in self.vocabulary.find(words[order]):
            out[order[rows]] = (self.base[bucket] + at + 1 + FREQUENT).astype(np.uint64)
        known, rank = self.frequent.part(0)
        if len(known):
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            hit = known[at] == words
            out[hit] = rank[at[hit]]
        out[words == BEGIN] = START
        return out


def write_hot(counted: DataFrame, model: dict, share: float) -> None:
    """Sum the parts of the contexts, keep those before more than ``share`` of all tokens, and write their hashes."""
    folder, bits, order = model["files"], model["bits"], model["order"]
    total = model["tokens"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model)
        for batch in batches:
            for kind, run in zip(batch["kind"].to_pylist(), batch["run"].to_pylist()):
                columns, counts = read_run(run, int(kind[3:]))
                flat, back = np.unique(columns, return_inverse=True)
                h = hash_columns(words.numbers(flat)[back].reshape(columns.shape))
                yield pa.RecordBatch.from_arrays([pa.array(hot_file(h, bits), pa.int32()), pa.array(h.view(np.int64)), pa.array(counts)],
                                                 ["file", "context", "n"])

    def group(table: pa.Table) -> pa.Table:
        save(f"{folder}/hot-{table['file'][0].as_py():05d}.context", np.sort(table["context"].to_numpy().view(np.uint64)))
        return table.select(["file"]).slice(0, 1)
    if order > 1:
        counted.where("kind <> 'word'").select("kind", "run").mapInArrow(rows, "file int, context long, n long").groupBy("file", "context").agg(
            F.sum("n").alias("n")).where(F.col("n") > share * total).select("file", "context").groupBy("file").applyInArrow(group, "file int").count()


def count_grams(docs: DataFrame, model: dict) -> DataFrame:
    """(kind, bucket, run) of the n-grams of every text."""
    order, bits, files = model["order"], model["bits"], model["files"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, routes = Words(model), Routes(files, bits)
        for columns in flushes(batches, order, words.numbers):
            yield run_rows(f"run{order}", *merged(columns, routes.keys(columns), None), bits)
    return docs.select("text").mapInArrow(run, "kind string, bucket int, run binary")


def clipped(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, 255).astype(np.uint8)


def merge_buckets(counted: DataFrame, order: int, files: str, bits: int, parking: Parking) -> DataFrame:
    """Merge each bucket's runs, write its arrays, and return what other steps
    need: (kind, bucket, run, numbers) with the runs of the next lower order,
    the spread contexts' parts, and the bucket's statistics."""
    schema = "kind string, bucket int, run binary, numbers array<long>"

    def group(table: pa.Table) -> pa.Table:
        routes, bucket = Routes(files, bits), table["bucket"][0].as_py()
        columns, counts = read_runs(table["run"].to_pylist(), order)
        columns, keys, counts = merged(columns, routes.keys(columns), counts)
        base = f"{files}/order{order}-{bucket:05d}"
        large = np.flatnonzero(counts > 254)
        save_keys(base, keys, bits), save(f"{base}.count", clipped(counts))
        save(f"{base}.large", np.stack([large, counts[large]]))
        kinds, buckets, out_runs = ["stats"], [bucket], [None]
        numbers = [[int(counts.sum()), len(counts)] + [int((counts == k).sum()) for k in (1, 2, 3, 4)]]
        if order > 1:
            _, spread, context = routes.ends(columns[:-1])
            place = np.argsort(context)
            context, n, spread = context[place], counts[place], spread[place]
            first = firsts(context)
            total = np.stack([sums(x, first) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))])
            context, spread = context[first], spread[first]
            write_contexts(f"{files}/context{order}-{bucket:05d}", context[~spread], total[:, ~spread], bits)
            for i in np.flatnonzero(spread):
                kinds.append("spread"), buckets.append(bucket), out_runs.append(None)
                numbers.append([int(context[i].view(np.int64)), *total[:, i].tolist()])
            lower = columns[1:]
            below = run_rows(f"run{order - 1}", *merged(lower, routes.keys(lower), None), bits)
            kinds += below["kind"].to_pylist()
            buckets += below["bucket"].to_pylist()
            out_runs += below["run"].to_pylist()
            numbers += [None] * below.num_rows
        return pa.table([pa.array(kinds), pa.array(buckets, pa.int32()), pa.array(out_runs, pa.binary()),
                         pa.array(numbers, pa.list_(pa.int64()))], names=["kind", "bucket", "run", "numbers"])
    return parking.park(counted.where(F.col("kind") == f"run{order}").select("bucket", "run").groupBy("bucket").applyInArrow(group, schema), f"merged{order}")


def write_contexts(base: str, keys: np.ndarray, total: np.ndarray, bits: int) -> None:
    """Contexts by key: totals, for those above 1 the continuations by count, for those above 254 all numbers whole."""
    multi = np.flatnonzero(total[0] > 1)
    large = np.flatnonzero(total[0] > 254)
    save_keys(base, keys, bits), save(f"{base}.total", clipped(total[0])), save(f"{base}.multi", multi.astype(np.uint32))
    save(f"{base}.more", clipped(total[1:, multi])), save(f"{base}.whole", np.concatenate([large[None], total[:, large]]))


def write_spread(merged_rows: DataFrame, order: int, files: str, bits: int) -> None:
    """Sum the parts of the contexts that are spread over buckets, and write them by hash."""
    def group(table: pa.Table) -> pa.Table:
        rows = [table[f"c{i}"].to_numpy() for i in range(5)]
        place = np.argsort(rows[0].view(np.uint64))
        base = f"{files}/spread{order}-{table['file'][0].as_py():05d}"
        save(f"{base}.stats", np.stack([r[place] for r in rows[1:]])), save(f"{base}.key", rows[0].view(np.uint64)[place])
        return table.select(["file"]).slice(0, 1)
    context = F.get("numbers", F.lit(0))
    file = F.shiftrightunsigned(context, 64 - bits + 8).cast("int") if bits > 8 else F.lit(0)
    merged_rows.where("kind = 'spread'").select(file.alias("file"), *[F.get("numbers", F.lit(i)).alias(f"c{i}") for i in range(5)]).groupBy(
        "file", "c0").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(1, 5)]).groupBy("file").applyInArrow(group, "file int").count()


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [1, 2, 3])


def train(docs: DataFrame, order: int = 3, bucket_tokens: int = 1 << 21) -> dict:
    """Count ``docs`` (text) and write the model; returns its small description."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    files = shared_file_path(scratch_path(docs.sparkSession, "model"))
    os.makedirs(files, exist_ok=True)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_bits = max(3, (size // (32 << 20)).bit_length())
    share = 1 / (8 << max(3, (size // (4 * bucket_tokens)).bit_length()))  # of the tokens, if words and gaps have four bytes at least
    model = {"files": files, "order": order, "word_bits": word_bits, "levels": {}}
    with Parking(docs.sparkSession) as parking:
        counted = parking.park(count_words(docs, order, word_bits, share), "words")
        found = write_vocabulary(counted, files, word_bits, parking)
        stats = np.array([(r.bucket, *r.numbers) for r in found.select("bucket", "numbers").collect()], np.int64).reshape(-1, 3)
        base = np.zeros((1 << word_bits) + 1, np.int64)
        base[stats[:, 0] + 1] = stats[:, 2]
        save(f"{files}/vocabulary.base", np.cumsum(base)[:-1])
        model["tokens"], model["distinct"] = int(stats[:, 1].sum()), int(stats[:, 2].sum())
        write_frequent(found, files)
        model["bits"] = bits = max(3, (model["tokens"] // bucket_tokens).bit_length())
        write_hot(counted, model, share)
        parking.leave(counted)
        counted = count_grams(docs, model)
        for k in range(order, 0, -1):
            out = merge_buckets(counted, k, files, bits, parking)
            parking.leave(counted)
            stats = np.array([r["numbers"] for r in out.where("kind = 'stats'").select("numbers").collect()], np.int64).reshape(-1, 6).sum(0)
            model["levels"][k] = {"total": int(stats[0]), "distinct": int(stats[1]), "seen": stats[2:6], "discounts": discounts(stats[2:6])}
            if k > 1:
                write_spread(out, k, files, bits)
            counted = out
    return model


class Mapped:
    """The memory-mapped arrays of one kind; the first ``bits`` of a key are its bucket."""

    def __init__(self, files: str, name: str, columns: tuple[str, ...], bits: int):
        self.buckets, self.bits = Buckets(files, name, columns), bits

    def find(self, keys: np.ndarray) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
        """(bucket, arrays, rows of ascending ``keys`` that are in them, their places), bucket by bucket."""
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        first = firsts(bucket)
        for a, b in zip(first, np.append(first[1:], len(bucket))):
            part = self.buckets.part(int(bucket[a]))
            if part is None:
                continue
            hit, at = self.search(part, keys[a:b])
            yield int(bucket[a]), part, a + np.flatnonzero(hit), at[hit]

    def search(self, part: list, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.buckets.columns[0] == "low":
            return find_keys(part[:3], keys, self.bits)
        if not len(part[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(part[0], keys), len(part[0]) - 1)
        return part[0][at] == keys, at


def whole(counts: np.ndarray, at: np.ndarray, keys: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Counts at places, those above a byte from the side array, which names them by ``keys``."""
    n = counts[at].astype(np.int64)
    big = np.flatnonzero(n == 255)
    if len(big):
        n[big] = large[1][np.searchsorted(large[0], keys[big])].astype(np.int64)
    return n


class Scorer:
    """Looks up a model's arrays; one per task."""

    def __init__(self, model: dict):
        self.m, files, bits = model, model["files"], model["bits"]
        self.words, self.routes = Words(model), Routes(files, bits)
        self.grams = {k: Mapped(files, f"order{k}", ("low", "high", "slot", "count", "large"), bits) for k in model["levels"]}
        self.contexts = {k: Mapped(files, f"context{k}", ("low", "high", "slot", "total", "multi", "more", "whole"), bits)
                         for k in model["levels"] if k > 1}
        self.spread = {k: Mapped(files, f"spread{k}", ("key", "stats"), bits - 8) if bits > 8 else Mapped(files, f"spread{k}", ("key", "stats"), 0)
                       for k in model["levels"] if k > 1}

    def word_counts(self, words: np.ndarray) -> np.ndarray:
        """Training count of each token."""
        coded = pa.array(words).dictionary_encode()
        keys, _, back = distinct(coded.dictionary.to_numpy().astype(np.uint64))
        out = np.zeros(len(keys), np.int64)
        for _, (_, count, large), rows, at in self.words.vocabulary.find(keys):
            out[rows] = whole(count, at, keys[rows], large)
        return out[back][coded.indices.to_numpy()]

    def gram_counts(self, k: int, keys: np.ndarray) -> np.ndarray:
        keys, _, back = distinct(keys)
        out = np.zeros(len(keys), np.int64)
        for _, part, rows, at in self.grams[k].find(keys):
            out[rows] = whole(part[3], at, at, part[4])
        return out[back]

    def context_numbers(self, k: int, keys: np.ndarray, spread: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(total, what the discounts ``d`` leave to the lower order) of each n-gram's context; zeros for one never seen."""
        keys, first, back = distinct(keys)
        out, spread = np.zeros((4, len(keys))), spread[first]
        cold, hot = np.flatnonzero(~spread), np.flatnonzero(spread)
        for _, part, rows, at in self.contexts[k].find(keys[cold]):
            rows, (total, multi, more, large) = cold[rows], part[3:]
            out[:2, rows] = 1
            several = total[at] > 1
            rows, at = rows[several], at[several]
            out[0, rows], out[1:, rows] = total[at], more[:, np.searchsorted(multi, at)]
            big = total[at] == 255
            out[:, rows[big]] = large[1:, np.searchsorted(large[0], at[big])]
        for _, (_, stats), rows, at in self.spread[k].find(keys[hot]):
            out[:, hot[rows]] = stats[:, at]
        return out[0][back], (d @ out[1:])[back]

    def log10(self, columns: np.ndarray) -> np.ndarray:
        """log10 probability of each token after the n - 1 before it."""
        m = self.m
        p = np.full(columns.shape[1], 1.0 / (m["distinct"] + 1))
        coded = pa.array(columns.ravel()).dictionary_encode()
        words, index = self.words.numbers(coded.dictionary.to_numpy().astype(np.uint64)), coded.indices.to_numpy().reshape(columns.shape)
        columns = words[index]
        for k in range(1, m["order"] + 1):
            level = m["levels"][k]
            d = np.concatenate([[0.0], level["discounts"]])
            if k == 1:
                c = self.gram_counts(1, hash_columns(words[None]))[index[-1]]
                if level["total"]:
                    n = np.array([level["seen"][0], level["seen"][1], level["distinct"] - level["seen"][0] - level["seen"][1]], float)
                    p = (np.maximum(c - d[np.minimum(c, 3)], 0.0) + (d[1:] * n).sum() * p) / level["total"]
                continue
            one = k == 2  # contexts of one word are looked up once a word
            route, spread, context = self.routes.ends(words[None] if one else columns[m["order"] - k:-1])
            total, back_off = self.context_numbers(k, context, spread, d[1:])
            if one:
                route, spread, total, back_off = (x[index[-2]] for x in (route, spread, total, back_off))
            own = hash_columns(columns[m["order"] - k:])
            c = self.gram_counts(k, np.where(spread, own, self.routes.key(route, own)))
            p = np.where(total > 0, (np.maximum(c - d[np.minimum(c, 3)], 0.0) + back_off * p) / np.maximum(total, 1), p)
        return np.log10(p)


def score(docs: DataFrame, model: dict, smoothing: float = 0.1) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of rows (doc_id, text)."""
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, n = Scorer(model), model["tokens"]
        for batch in batches:
            for row, data, starts in tk.text_slabs(batch["text"], SCORE_SLAB):
                columns, ds = token_stream(*tk.word_hashes(data, starts), model["order"])
                c = scorer.word_counts(columns[-1])
                base = np.log10((c + smoothing) / (n + smoothing * (model["distinct"] + 1)))
                logp, at = scorer.log10(columns), ds[:-1]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(row, len(at)).cast(pa.int64()), pa.array(np.diff(ds), pa.int64()),
                     pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(np.full(len(at), n, np.int64)),
                     pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logp, at))], names)
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 10."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def perplexity_report(docs: DataFrame, order: int = 3) -> DataFrame:
    """Train on the documents outside the held-out tenth and score every row."""
    docs = docs.select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))), order)
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
