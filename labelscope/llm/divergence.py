"""Source divergence audit: how far a source's use of terms is from its language's and from other sources'.

Terms are the runs of letters A-Z (as a-z) and of non-ASCII characters.  A
language keeps the terms that at least ``least`` of its documents hold; V is
their number.  A group (language, source) and the language itself give each
kept term p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), in whole
numbers.  Two reports come from that: the distance of every pair of sources of
a language, sum of |p - q| over all kept terms, and the ``top`` terms that a
group uses more than its language, by p - q.

Counting.  Tasks cut a slab of text into one contiguous array of terms and
encode it by Arrow's dictionary, so terms are compared as strings, never by a
hash alone; Spark sums (language, source, term, count, documents).

Top terms.  For a fixed group p grows with the count in the group and q with
the count in the language, so a term comes before every term that it dominates:
higher or equal group count, lower or equal language count, earlier in UTF-8.
Terms dominated by ``top`` others cannot be reported.  Partitions, sorted by
group, retain each group's skyband (terms dominated by fewer than ``top``
others); the skybands of some partitions are merged, then those of all, and
only what is left is ranked by its exact value.  A skyband is merged in blocks,
so memory follows its size and not the group's.

Pairs.  A language's terms are cut into slices and its sources into blocks,
both by hash and both counted from the data; one kernel call fills the matrix
of one slice and two blocks and returns partial sums, which Spark adds up.

Defined results: null text, language and source are ''; a group or a language
without kept terms has V = 0, distance 0 and no terms; repeated rows count each
time; equal values are ranked by the item's UTF-8; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm import text_kernel as tk
from labelscope.llm.scratch import parked

SCALE, PRIOR = 1_000_000_000, 5
SLAB = 12 << 20
SLICE, BLOCK = 2048, 128  # terms of a slice and sources of a block, about
WAYS = 16                 # slices of a group in the first merge of skybands
CHUNK = 1024              # points that are compared with a skyband at once

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_LETTER = ((_LOWER >= 97) & (_LOWER <= 122)) | (_BYTES >= 128)


def slab_terms(data: np.ndarray, starts: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """(the terms of a slab in order, index of each document's first term, with the end)."""
    inside = _LETTER[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    begins[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    first = np.flatnonzero(begins)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - first)])
    letters = _LOWER[data[inside]]
    terms = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters))
    return terms, np.searchsorted(first, starts)


def slab_counts(data: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of the distinct (term, group) of a slab; ``group`` has a number a document."""
    terms, at = slab_terms(data, starts)
    coded = terms.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    n_docs = len(group)
    pairs = np.sort(code * n_docs + np.repeat(np.arange(n_docs), np.diff(at)))
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(pairs)))
    code, doc = np.divmod(pairs[first], n_docs)
    n_groups = int(group.max()) + 1
    keys, back = np.unique(code * n_groups + group[doc], return_inverse=True)
    code, owner = np.divmod(keys, n_groups)
    count = np.bincount(back, n, len(keys)).astype(np.int64)
    return coded.dictionary.take(pa.array(code)).cast(pa.string()), owner, count, np.bincount(back, minlength=len(keys))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each group's terms; every group also has a row without a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.StructArray.from_arrays([batch["lang"].dictionary_encode().indices, batch["source"].dictionary_encode().indices], ["a", "b"])
            a, b = (np.asarray(names.field(k)).astype(np.int64) for k in (0, 1))
            for row, data, starts in tk.text_slabs(batch["text"], SLAB):
                rows = slice(row, row + len(starts) - 1)
                _, place, group = np.unique(a[rows] * (int(b.max()) + 1) + b[rows], return_index=True, return_inverse=True)
                term, owner, n, held = slab_counts(data, starts, group)
                for which, extra in ((place[owner], (term, n, held)), (place, (pa.nulls(len(place), pa.string()), *np.zeros((2, len(place)), np.int64)))):
                    which = pa.array(row + which)
                    yield pa.RecordBatch.from_arrays([batch["lang"].take(which), batch["source"].take(which), *map(_array, extra)],
                                                     ["lang", "source", "term", "n", "docs"])
    part = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], "text").mapInArrow(
        run, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _array(x) -> pa.Array:
    return x if isinstance(x, pa.Array) else pa.array(x, pa.int64())


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)) of three long columns, exact in decimals."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(20,0)) "
                  f"div cast({total} + {PRIOR} * {terms} as decimal(20,0))")


def shares(count: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The same in numpy, by long division in base 1000, so no step leaves a long; ``by`` is the whole denominator."""
    rest, out = count + PRIOR, np.int64(0)
    for _ in range(3):
        part, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + part
    return out + 1


def skyband(n: np.ndarray, lang_n: np.ndarray, term: np.ndarray, top: int) -> np.ndarray:
    """Places of the points that fewer than ``top`` others dominate: higher or equal ``n``, lower or equal ``lang_n``, earlier ``term``."""
    order = np.lexsort((term, lang_n, -n))  # whatever dominates a point comes before it
    y, z = lang_n[order], term[order]
    kept = np.zeros(0, np.int64)
    for a in range(0, len(order), CHUNK):
        here = np.arange(a, min(a + CHUNK, len(order)))
        by = ((y[kept][:, None] <= y[here]) & (z[kept][:, None] < z[here])).sum(0)
        here = here[by < top]
        by = by[by < top]
        inside = (y[here][:, None] <= y[here]) & (z[here][:, None] < z[here]) & np.triu(np.ones((len(here), len(here)), bool), 1)
        kept = np.concatenate([kept, here[by + inside.sum(0) < top]])
    return order[kept]


def retain(points: DataFrame, top: int) -> DataFrame:
    """The skyband of each group's points in each partition, of rows (lang, source, term, n, lang_n)."""
    names = ["lang", "source", "term", "n", "lang_n"]

    def reduced(table: pa.Table) -> pa.Table:
        term = table["term"].combine_chunks().cast(pa.binary())
        rank = np.empty(len(term), np.int64)
        rank[pa.compute.sort_indices(term).to_numpy()] = np.arange(len(term))
        return table.take(pa.array(skyband(table["n"].to_numpy(), table["lang_n"].to_numpy(), rank, top)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None
        for batch in batches:
            lang, source = batch["lang"].to_pylist(), batch["source"].to_pylist()
            edges = [0, *(i for i in range(1, len(lang)) if (lang[i], source[i]) != (lang[i - 1], source[i - 1])), len(lang)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if (lang[a], source[a]) == key:
                    held = reduced(pa.concat_tables([held, part]))
                    continue
                if held is not None:
                    yield from held.combine_chunks().to_batches()
                held, key = reduced(part), (lang[a], source[a])
        if held is not None:
            yield from held.combine_chunks().to_batches()
    return points.select(*names).sortWithinPartitions("lang", "source").mapInArrow(
        run, "lang string, source string, term string, n long, lang_n long")


def top_terms(points: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank) of each group's terms, from the merged skybands of ``points``."""
    few = retain(points, top)
    few = retain(few.repartition("lang", "source", F.spark_partition_id() % WAYS), top)
    few = retain(few.repartition("lang", "source"), top)
    valued = few.join(groups, ["lang", "source"]).withColumn("p", share("n", "group_total", "v")).withColumn(
        "q", share("lang_n", "lang_total", "v")).where("p > q")
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn(
        "rank", F.row_number().over(place)).where(F.col("rank") <= top)


def source_pairs(points: DataFrame, groups: DataFrame, slice_terms: int = SLICE, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value, rank): the summed distances of every two sources of a language."""
    size = groups.groupBy("lang").agg(F.count("*").alias("sources")).select(
        "lang", F.ceil(F.col("sources") / block).cast("long").alias("blocks"))
    blocked = groups.join(size, "lang").select(
        "lang", "source", "group_total", "v", "blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / slice_terms)).cast("long").alias("slices"),
        F.expr("pmod(xxhash64(source), blocks)").alias("block"))
    cells = F.explode(F.expr("transform(sequence(0L, blocks - 1), x -> struct(least(x, block) AS a, greatest(x, block) AS b))"))
    common = ["lang", "slice", "cell.a", "cell.b", "block", "source", "term", "n", "total"]
    total = (F.col("group_total") + PRIOR * F.col("v")).alias("total")
    marks = blocked.withColumn("slice", F.explode(F.expr("sequence(0L, slices - 1)"))).withColumn("cell", cells).select(
        *[F.lit(None).cast("string").alias("term") if c == "term" else F.lit(0).cast("long").alias("n") if c == "n" else
          total if c == "total" else F.col(c) for c in common])
    rows = points.join(blocked, ["lang", "source"]).withColumn("slice", F.expr("pmod(xxhash64(term), slices)")).withColumn(
        "cell", cells).select(*[total if c == "total" else F.col(c) for c in common])

    def kernel(table: pa.Table) -> pa.Table:
        source = np.array(table["source"].to_pylist(), object)
        mark = table["term"].is_null().to_numpy()
        names, first = np.unique(source[mark], return_index=True)
        by, block_of = table["total"].to_numpy()[mark][first], table["block"].to_numpy()[mark][first]
        term = table["term"].combine_chunks().filter(pa.array(~mark)).dictionary_encode()
        n_terms = len(term.dictionary)
        p = np.repeat((shares(np.zeros(len(by), np.int64), by) if n_terms else by)[None], n_terms, axis=0)
        which = np.searchsorted(names, source[~mark])
        p[term.indices.to_numpy(), which] = shares(table["n"].to_numpy()[~mark], by[which]) if n_terms else 0
        # a term that no source of the two blocks holds adds the same to each pair: it has no row here
        left = np.flatnonzero(block_of == table["a"][0].as_py())
        right = np.flatnonzero(block_of == table["b"][0].as_py())
        out = [(i, right[right > i] if table["a"][0].as_py() == table["b"][0].as_py() else right) for i in left]
        value = [np.abs(p[:, js] - p[:, i:i + 1]).sum(0) for i, js in out]
        a, b = np.concatenate([[i] * len(js) for i, js in out] or [[]]).astype(int), np.concatenate([js for _, js in out] or [[]]).astype(int)
        return pa.table([pa.array([table["lang"][0].as_py()] * len(a), pa.string()), pa.array(names[a], pa.string()), pa.array(names[b], pa.string()),
                         pa.array(np.concatenate(value or [[]]).astype(np.int64)), pa.array(np.full(len(a), n_terms), pa.int64())],
                        names=["lang", "x", "y", "value", "terms"])
    part = rows.union(marks).groupBy("lang", "slice", "a", "b").applyInArrow(kernel, "lang string, x string, y string, value long, terms long")
    sums = part.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    rest = groups.select("lang", "source", "v", F.when(F.col("v") > 0, share("0L", "group_total", "v")).alias("none"))
    for c in ("x", "y"):
        sums = sums.join(rest.select("lang", F.col("source").alias(c), F.col("none").alias(f"none_{c}"), "v"), ["lang", c]).drop(*["v"] if c == "x" else [])
    sums = sums.withColumn("value", F.col("value") + F.coalesce((F.col("v") - F.col("terms")) * F.abs(F.col("none_x") - F.col("none_y")), F.lit(0)))
    both = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sums.select("lang", both.alias("pair"), "value").select("lang", "pair.*", "value").withColumn("rank", F.row_number().over(place))


def audit(docs: DataFrame, least: int = 30, top: int = 50, slice_terms: int = SLICE, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of rows (text, lang, source): part ``pair`` and part ``term``."""
    counts = parked(term_counts(docs), "terms")
    kept = parked(counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(
        F.col("docs") >= least).drop("docs"), "kept")
    points = parked(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "points")
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("v"))
    groups = counts.where("term IS NULL").select("lang", "source").join(
        points.groupBy("lang", "source").agg(F.sum("n").alias("group_total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = parked(groups.na.fill(0, ["group_total", "lang_total", "v"]), "groups")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_pairs(points, groups, slice_terms, block).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.union(top_terms(points, groups, top).withColumn("part", F.lit("term")).select(*columns))
