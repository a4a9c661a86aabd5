"""Near-duplicates: b-bit MinHash signatures joined under a Hamming bound.

A document is the set of its distinct 5-word shingles (fewer words: the whole
sequence; no word: the empty set, linked with nothing).  Its signature is
``chunks * chunk_len`` MinHash symbols of ``BITS`` = 16 bits.

Multi-index join.  The signature is split into ``chunks`` chunks.  Two
signatures that differ in at most ``d = 2 * chunks - 1`` symbols have, by
pigeonhole, a chunk that differs in at most one symbol.  Enumerating that one
allowed error -- a key per chunk and left-out position -- puts every such pair
into a common bucket, so no pair within the bound is missed.  With 10 chunks
of 5 symbols d is 19 of 50: a pair at Jaccard 0.85 exceeds it with a
probability of about 3e-5.  A key holds 4 symbols, 64 bits, so among N unlike
documents one meets 50 N / 2^64 others by chance: none worth counting at any N
(8-bit symbols would give 1.2 at 1e8 documents, and families that grow
together).  Documents alike at J < 0.85 still meet, with a probability of
about 50 J^4; such links are dropped when they are confirmed.

Links are confirmed on full sets.  Buckets with two or more members tie their
members into candidate families (a star per bucket, then connected
components, so a bucket of any size gives one row a member).  A family is cut
into blocks of ``block`` documents and every pair of blocks is one task group:
it filters pairs by signature distance, intersects full shingle sets, and
returns a spanning forest of the confirmed links -- never all pairs.  Documents
with one set (exact copies) are one representative throughout.

Defined results: null or empty text has 0 shingles and is its own component; a
null ``doc_id`` is linked with nothing, its component is null and it is kept;
rows that repeat a ``doc_id`` with the same text are that document again, with
another text a vertex of their own, linked with what is near that text; an
empty table gives an empty result.  Extra columns pass through :func:`filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm import text_kernel as tk
from labelscope.llm.components import connected_components
from labelscope.llm.scratch import parked


BITS = 16  # of a symbol


def signatures(h: np.ndarray, ix: np.ndarray, size: int, seed: int = 11, bits: int = BITS) -> np.ndarray:
    """MinHash symbols (two bytes each) of non-empty sets, one row a set."""
    rng = np.random.default_rng(seed)
    flips = rng.integers(0, 1 << 32, size, dtype=np.uint32)
    factors = rng.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1)
    x, out = (h >> np.uint64(32)).astype(np.uint32), np.empty((len(ix) - 1, size), np.uint16)
    for k in range(size):
        least = np.minimum.reduceat((x ^ flips[k]) * factors[k], ix[:-1])
        out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return out


def fingerprints(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each non-empty set, in two numbers."""
    return tuple(np.add.reduceat(tk.mix(x), at[:-1]).view(np.int64) for x in (h, h ^ np.uint64(tk.ODD)))


def describe(docs: DataFrame, k: int, size: int) -> DataFrame:
    """(doc_id, n_shingles, fp_a, fp_b, sig): the set's size, 128-bit fingerprint and signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, starts in tk.text_slabs(batch["text"]):
                words, ds = tk.word_hashes(data, starts)
                h, ix = tk.shingle_sets(words, ds, k)
                n = np.diff(ix)
                full = np.flatnonzero(n)
                a, b, sig = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [None] * len(n)
                if len(full):
                    at = ix[np.append(full, len(n))]
                    a[full], b[full] = fingerprints(h, at)
                    for j, s in zip(full, signatures(h, at, size)):
                        sig[j] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(row, len(n)).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b),
                     pa.array(sig, pa.binary())],
                    ["doc_id", "n_shingles", "fp_a", "fp_b", "sig"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        run, "doc_id long, n_shingles long, fp_a long, fp_b long, sig binary")


def bucket_keys(sig, chunks: int, chunk_len: int):
    """The signature's keys: each chunk without each of its symbols in turn."""
    at = lambda symbol, n: F.substring(sig, 2 * symbol + 1, 2 * n)
    return F.array(*[
        F.xxhash64(F.lit(c * chunk_len + p), at(c * chunk_len, p), at(c * chunk_len + p + 1, chunk_len - 1 - p))
        for c in range(chunks) for p in range(chunk_len)])


def candidate_families(reps: DataFrame, chunks: int, chunk_len: int) -> DataFrame:
    """``reps`` (rep, sig) -> (rep, family) for those that share a bucket with another."""
    keys = reps.select(F.explode(bucket_keys(F.col("sig"), chunks, chunk_len)).alias("key"), "rep")
    hubs = (keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n"))
            .where("n > 1").select("key", "hub"))
    stars = keys.join(hubs, "key").where("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    tree = connected_components(stars)
    return tree.select(F.col("u").alias("rep"), F.col("v").alias("family")).union(
        tree.select(F.col("v").alias("rep"), F.col("v").alias("family")).distinct())


def _forest(ids, sides, sets, sigs, percent: int, bound: int) -> list[tuple[int, int]]:
    """Confirmed links of one pair of blocks, as a spanning forest.  ``sides``
    holds a document's block: 0 or 1 for two blocks, all 0 for one."""
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links, n = [], np.array([len(s) for s in sets])
    two = bool(sides.any())
    for i in range(len(ids)):
        if two and sides[i]:
            continue
        others = np.flatnonzero(sides) if two else np.arange(i + 1, len(ids))
        small, large = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
        others = others[100 * small >= percent * large]
        others = others[(sigs[others] != sigs[i]).sum(1) <= bound]
        mine = root(i)
        others = [j for j in others if root(j) != mine]
        if not others:
            continue
        flat, size = np.concatenate([sets[j] for j in others]), n[others]
        at = np.minimum(np.searchsorted(sets[i], flat), n[i] - 1)
        common = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(size) - size)
        for j in np.asarray(others)[100 * common >= percent * (size + n[i] - common)]:
            if root(j) != root(i):
                parent[root(j)] = root(i)
                links.append((int(ids[i]), int(ids[j])))
    return links


def confirmed_links(docs: DataFrame, families: DataFrame, k: int, size: int, percent: int, bound: int,
                    block: int) -> DataFrame:
    """Links (u, v) of every candidate family, confirmed on full sets."""
    n = families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = families.join(n, "family").withColumn("mine", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, starts in tk.text_slabs(batch["text"]):
                words, ds = tk.word_hashes(data, starts)
                h, ix = tk.shingle_sets(words, ds, k)
                full = np.flatnonzero(np.diff(ix))
                rows = batch.slice(row, len(ds) - 1)
                if len(full):  # a document's other texts are of other classes
                    a, b = fingerprints(h, ix[np.append(full, len(ix) - 1)])
                    sig = signatures(h, ix[np.append(full, len(ix) - 1)], size)
                    own = (rows["fp_a"].to_numpy()[full] == a) & (rows["fp_b"].to_numpy()[full] == b)
                    full, sig = full[own], sig[own]
                part = rows.select(["rep", "family", "blocks", "mine"]).take(pa.array(full))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([h[ix[j]:ix[j + 1]].tobytes() for j in full], pa.binary()),
                     pa.array([s.tobytes() for s in sig] if len(full) else [], pa.binary())],
                    ["rep", "family", "blocks", "mine", "shingles", "sig"])

    def compare(table: pa.Table) -> pa.Table:
        mine, ids = table["mine"].to_numpy(), table["rep"].to_numpy()
        first = np.unique(ids, return_index=True)[1]
        table, mine, ids = table.take(first), mine[first], ids[first]
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        found = _forest(ids, (mine == b) & (a != b), [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()],
                        np.stack([np.frombuffer(x, np.uint16) for x in table["sig"].to_pylist()]), percent, bound)
        return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    # the families grow with the documents: the same shuffled join at every size
    full = texts.join(placed.hint("merge"), "doc").select("rep", "text", "fp_a", "fp_b", "family", "blocks", "mine").mapInArrow(
        sets, "rep long, family long, blocks int, mine int, shingles binary, sig binary")
    pairs = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "rep", "mine", "shingles", "sig")
    return pairs.groupBy("family", "a", "b").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, chunks: int = 10, chunk_len: int = 5,
                    block: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    size = chunks * chunk_len
    described = parked(describe(docs, k, size), "signatures")
    real = described.where("n_shingles > 0 and doc_id is not null")
    key = ["fp_a", "fp_b", "n_shingles"]
    classes = real.groupBy(*key).agg(F.min(F.struct("doc_id", "sig")).alias("first")).select(
        *key, F.col("first.doc_id").alias("doc"), F.col("first.sig").alias("sig"), F.monotonically_increasing_id().alias("rep"))
    classes = parked(classes, "classes")   # numbered: one document may have several texts, so several classes
    families = candidate_families(classes.select("rep", "sig"), chunks, chunk_len)
    families = parked(families.join(classes.select("rep", "doc", "fp_a", "fp_b"), "rep"), "families")
    links = confirmed_links(docs, families, k, size, percent, 2 * chunks - 1, block)
    tree = connected_components(links).withColumnRenamed("u", "rep").withColumnRenamed("v", "root")
    rooted = classes.select(*key, "doc", "rep").join(tree, "rep", "left").select(*key, "doc", F.coalesce("root", "rep").alias("root"))
    least = rooted.join(rooted.groupBy("root").agg(F.min("doc").alias("component_id")), "root").select(*key, "component_id")
    out = described.select("doc_id", *key).join(least, key, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.cast("long").alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def filter_documents(docs: DataFrame, **params) -> DataFrame:
    """One document of each component, the one with the smallest id; all columns."""
    gone = near_duplicates(docs, **params).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
