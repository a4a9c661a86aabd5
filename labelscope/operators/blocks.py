"""Block kernels for work that is a matrix product (item x centroid,
item x item).

Two physical strategies, chosen by a size check made before anything is
shipped:

* **broadcast** -- the small side (centroids, class lists) is counted first;
  if ``rows * width * 8`` bytes is under ``labelscope.kernel.broadcastBytes``
  (default 256 MiB) it is collected once, broadcast, and every partition of
  the big side runs a numpy kernel over Arrow batches (``mapInArrow``).  The
  big side is not shuffled at all.
* **blocked cogroup** -- otherwise both sides are hashed into blocks and
  replicated so that each (left block, right block) pair meets in exactly one
  cogroup (the distributed form of a blocked matrix product).  Kernels emit
  only per-row partial results (best label, top-k, sums), never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024
DEFAULT_BLOCK_BYTES = 64 * 1024 * 1024


def broadcast_limit(spark) -> int:
    return int(spark.conf.get("labelscope.kernel.broadcastBytes", str(DEFAULT_BROADCAST_BYTES)))


def block_bytes(spark) -> int:
    return int(spark.conf.get("labelscope.kernel.blockBytes", str(DEFAULT_BLOCK_BYTES)))


def arrow_matrix(col) -> np.ndarray:
    """List<float|double> Arrow column -> (n, d) float64 matrix (no per-row loop)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0))
    offs = col.offsets.to_numpy()
    lens = np.diff(offs)
    d = int(lens[0])
    if not np.all(lens == d):
        raise ValueError("vectors of unequal length in one column")
    vals = col.values.to_numpy(zero_copy_only=False)[offs[0]: offs[0] + n * d]
    return vals.astype(np.float64).reshape(n, d)


def to_batch(pdf, schema) -> pa.RecordBatch:
    """pandas frame -> Arrow batch with exactly the declared Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    return pa.RecordBatch.from_pandas(pdf, schema=to_arrow_schema(schema), preserve_index=False)


def pandas_matrix(series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.values])


def blocks_for(n_rows: int, width: int, spark) -> int:
    """Number of blocks so that one block of ``n_rows x width`` doubles fits the block budget."""
    total = max(1, n_rows) * max(1, width) * 8
    return max(1, math.ceil(total / block_bytes(spark)))


def block_counts(n_left: int, n_right: int, width: int, spark, least_rows: int = 512) -> tuple[int, int]:
    """(left, right) block counts from the data and the budget: a block of
    either side fits it, and so does the matrix of doubles between two blocks.
    Small inputs are cut further on the left, to use the cores."""
    rows = max(1, math.isqrt(block_bytes(spark) // 8))
    right = max(blocks_for(n_right, width, spark), math.ceil(n_right / rows))
    left = max(blocks_for(n_left, width, spark), math.ceil(n_left / rows),
               min(spark.sparkContext.defaultParallelism, math.ceil(n_left / least_rows)))
    return left, right


def tiled_counts(n_left: int, n_right: int, width: int, spark, per_row: int = 0, least_rows: int = 512) -> tuple[int, int]:
    """(left, right) block counts for a kernel that goes through a block pair in
    tiles (:func:`tiles`): only the rows themselves have to fit a quarter of the
    budget, so blocks are large and a row is copied few times.  ``per_row``:
    values that the kernel returns per left row.  Small inputs are cut further on
    the longer side, to use the cores."""
    rows = max(1, block_bytes(spark) // 4 // (8 * (max(1, width) + 16)))
    own = min(rows, max(1, block_bytes(spark) // (32 * max(1, per_row))))
    left, right = max(1, math.ceil(n_left / own)), max(1, math.ceil(n_right / rows))
    cores = spark.sparkContext.defaultParallelism
    if n_left >= n_right:
        left = max(left, min(math.ceil(cores / right), math.ceil(n_left / least_rows)))
    else:
        right = max(right, min(math.ceil(cores / left), math.ceil(n_right / least_rows)))
    return left, right


def tiles(n_left: int, n_right: int, budget_bytes: int = DEFAULT_BLOCK_BYTES):
    """Slices of the left rows whose matrix with all right rows fits a quarter of the budget."""
    step = max(1, budget_bytes // 4 // (8 * max(1, n_right)))
    return (slice(i, min(i + step, n_left)) for i in range(0, n_left, step))


def best_columns(S: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, values) of the ``k`` largest entries of each row, the
    leftmost of equal ones, those of -inf left out.  Ties cost nothing.  ``S`` is spent."""
    at, found = np.arange(len(S)), []
    for _ in range(min(k, S.shape[1])):
        col = S.argmax(axis=1)
        val = S[at, col]
        live = val > -np.inf
        found.append((at[live], col[live], val[live]))
        S[at, col] = -np.inf
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def replicate(df: DataFrame, id_col: str, own: str, other: str, n_own: int, n_other: int) -> DataFrame:
    """Hash rows into ``n_own`` blocks and copy each row once per block of the other side."""
    out = df.withColumn(own, F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_own)).cast("int"))
    if n_other == 1:
        return out.withColumn(other, F.lit(0))
    return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def cogroup_blocks(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
                   n_left: int, n_right: int, kernel, schema, keys: list[str] | None = None) -> DataFrame:
    """Run ``kernel(left_pdf, right_pdf) -> pdf`` once per (left block, right
    block) -- per value of ``keys`` too when given (e.g. a fold: only rows of
    the same key meet)."""
    keys = keys or []
    # fresh attribute ids on both sides: the two inputs often share lineage
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    lrep = replicate(left, left_id, "_lb", "_rb", n_left, n_right)
    rrep = replicate(right, right_id, "_rb", "_lb", n_right, n_left)

    def fn(lp, rp):
        if len(lp) == 0 or len(rp) == 0:
            import pandas as pd
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema.fields})
        return kernel(lp.drop(columns=["_lb", "_rb"]), rp.drop(columns=["_lb", "_rb"]))

    return (lrep.groupBy(*keys, "_lb", "_rb")
            .cogroup(rrep.groupBy(*keys, "_lb", "_rb"))
            .applyInPandas(fn, schema))


def sparse_dot_block(rq, cq, wq, nq, rr, cr, wr, nr, budget_bytes: int = DEFAULT_BLOCK_BYTES,
                     dense_ratio: float = 1 / 16) -> np.ndarray:
    """S = Q @ R.T for two sparse row sets given as (row, term code, weight)
    triples (term codes shared between the sides).

    Terms frequent enough in this block pair (``df_q * df_r >= dense_ratio *
    nq * nr``) go through one BLAS product over those columns; the others
    are expanded exactly into their (q, r) pairs -- vectorised with
    ``repeat`` and accumulated with ``bincount`` in bounded chunks.
    """
    S = np.zeros((nq, nr))
    if len(cq) == 0 or len(cr) == 0:
        return S
    V = int(max(cq.max(), cr.max())) + 1
    dfq = np.bincount(cq, minlength=V)
    dfr = np.bincount(cr, minlength=V)
    shared = (dfq > 0) & (dfr > 0)
    dense = shared & (dfq.astype(float) * dfr >= dense_ratio * nq * nr)
    # dense part
    dt = np.flatnonzero(dense)
    if len(dt):
        col = np.full(V, -1)
        col[dt] = np.arange(len(dt))
        step = max(1, budget_bytes // (8 * (nq + nr)))
        mq, mr = dense[cq], dense[cr]
        qr, qc, qw = rq[mq], col[cq[mq]], wq[mq]
        rr_, rc, rw = rr[mr], col[cr[mr]], wr[mr]
        for c0 in range(0, len(dt), step):
            width = min(step, len(dt) - c0)
            sq = (qc >= c0) & (qc < c0 + width)
            sr = (rc >= c0) & (rc < c0 + width)
            X = np.zeros((nq, width))
            Y = np.zeros((nr, width))
            X[qr[sq], qc[sq] - c0] = qw[sq]
            Y[rr_[sr], rc[sr] - c0] = rw[sr]
            S += X @ Y.T
    # sparse part: exact pair expansion over the remaining shared terms
    rare = shared & ~dense
    mq, mr = rare[cq], rare[cr]
    if not mq.any() or not mr.any():
        return S
    q_r, q_c, q_w = rq[mq], cq[mq], wq[mq]
    oq = np.argsort(q_c, kind="stable")
    q_r, q_c, q_w = q_r[oq], q_c[oq], q_w[oq]
    r_r, r_c, r_w = rr[mr], cr[mr], wr[mr]
    orr = np.argsort(r_c, kind="stable")
    r_r, r_c, r_w = r_r[orr], r_c[orr], r_w[orr]
    cnt_r = np.bincount(r_c, minlength=V)
    start_r = np.concatenate([[0], np.cumsum(cnt_r)[:-1]])
    rep = cnt_r[q_c]
    max_pairs = max(1, budget_bytes // 32)
    csum = np.cumsum(rep)
    lo = 0
    while lo < len(rep):
        base_sum = csum[lo - 1] if lo else 0
        hi = int(np.searchsorted(csum, base_sum + max_pairs, side="right"))
        hi = max(hi, lo + 1)
        rp_ = rep[lo:hi]
        tot = int(rp_.sum())
        if tot:
            within = np.arange(tot) - np.repeat(np.cumsum(rp_) - rp_, rp_)
            ridx = np.repeat(start_r[q_c[lo:hi]], rp_) + within
            qi = np.repeat(q_r[lo:hi], rp_)
            prod = np.repeat(q_w[lo:hi], rp_) * r_w[ridx]
            S += np.bincount(qi * nr + r_r[ridx], weights=prod, minlength=nq * nr).reshape(nq, nr)
        lo = hi
    return S


ROWS_PER_SALT = 100_000


def meet_blocks(rows: DataFrame, table: DataFrame, key: str, entry, block_size: int, out: str = "_entries") -> DataFrame:
    """Every row beside every block of a small table's entries: ``rows`` with
    ``out``, an array of at most about ``block_size`` structs of ``table``.

    ``table`` (hashed into blocks by the column ``entry``) is repeated for salts
    of the rows' ``key``, and both meet in an equi-join, so nothing is collected
    and a block's rows spread over as many tasks as their number asks for."""
    n, size = rows.count(), table.count()
    salts, n_blocks = max(1, n // ROWS_PER_SALT), max(1, -(-size // block_size))
    longs = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    blocked = table.groupBy(F.pmod(F.xxhash64(F.col(entry).cast("string")), F.lit(n_blocks)).alias("_block")).agg(
        F.collect_list(F.struct(*table.columns)).alias(out)).withColumn("_salt", longs(salts))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(salts))).withColumn("_block", longs(n_blocks)).join(
        blocked, ["_block", "_salt"]).drop("_block", "_salt")
