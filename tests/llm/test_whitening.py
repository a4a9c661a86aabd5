import math

import numpy as np
import pytest


def rebuilt(d, vectors):
    return vectors @ (d[:, :, None] * vectors.transpose(0, 2, 1))


@pytest.mark.parametrize("size", [1, 2, 3, 8, 40])
@pytest.mark.parametrize("kind", ["plain", "zero", "equal", "close", "axis", "nothing"])
def test_rank_one_change(size, kind):
    from labelscope.llm.whitening import rank_one
    rng, lanes = np.random.default_rng(size), 5
    d = np.sort(rng.random((lanes, size)) * 10.0 ** rng.integers(-6, 6, (lanes, size)), 1)
    if kind == "zero":
        d[:] = 0
    if kind == "equal":
        d = np.sort(rng.integers(0, 3, (lanes, size)).astype(float), 1)
    if kind == "close":
        d = np.sort(1 + 1e-14 * rng.random((lanes, size)), 1)
    u = np.linalg.qr(rng.standard_normal((lanes, size, size)))[0]
    v = u[:, :, 0] * 3 if kind == "axis" else np.zeros((lanes, size)) if kind == "nothing" else rng.standard_normal((lanes, size))
    rho = rng.random(lanes) * 5
    want = rebuilt(d, u) + rho[:, None, None] * v[:, :, None] * v[:, None, :]
    values, vectors = rank_one(d, u, rho, v)
    assert (np.diff(values, axis=1) >= 0).all()
    assert np.abs(rebuilt(values, vectors) - want).max() <= 1e-13 * size * max(np.abs(want).max(), 1)
    assert np.abs(vectors.transpose(0, 2, 1) @ vectors - np.eye(size)).max() < 1e-13 * size


def test_spectra_of_parts_merge_to_the_scatter_of_all():
    from labelscope.llm.whitening import Spectra
    x = np.floor(np.random.default_rng(2).standard_normal((203, 6)) * 100) + 1e5
    x[:, 5] = 7                                # no variance
    x[20:60] = x[20]                           # repeated rows
    held = Spectra.empty(5, 6)
    for a in range(0, len(x), 5):
        held.add(x[a:a + 5])
    out = Spectra.unpacked([held.joined().packed()], 6)
    c = (x - x.mean(0)).T @ (x - x.mean(0))
    assert out.n[0] == 203 and np.abs(out.mean[0] - x.mean(0)).max() < 1e-9
    assert np.abs(rebuilt(out.values, out.vectors)[0] - c).max() < 1e-12 * c.max()


def brute(rows, components=8):
    """(id, component) -> (n, deviation, |whitened|, explained) of the rows, by plain arithmetic and one eigh."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in kept]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    kept = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in kept if len(v) == size]
    n, total = len(kept), [sum(c) for c in zip(*(v for _, v in kept))]
    x = np.array([v for _, v in kept], float) - np.array([s / n for s in total])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for (i, v), row in zip(kept, x):
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, total))
        for k in range(min(components, size)):
            alive = values[k] > 1e-9 * values[0]
            out.append((i, k + 1, n, deviation, abs(row @ vectors[:, k]) / math.sqrt(values[k]) if alive else None, values[k] / values.sum()))
    return out


def compare(got, want):
    key = lambda r: (r[1], repr(r[0]), r[3], r[4] or 0)
    got = sorted(((r["vec_id"], r["component"], r["n"], int(r["deviation"]), r["whitened"] if r["whitened"] is None else abs(r["whitened"]),
                   r["explained"]) for r in got), key=key)
    assert [r[:4] for r in got] == [r[:4] for r in sorted(want, key=key)]
    for a, b in zip(got, sorted(want, key=key)):
        assert (a[4] is None) == (b[4] is None)
        assert a[4] is None or abs(a[4] - b[4]) < 1e-7
        assert abs(a[5] - b[5]) < 1e-9


def awkward_rows():
    rng = np.random.default_rng(7)
    rows = [(i, [float(c) for c in rng.standard_normal(10) * np.arange(1, 11)]) for i in range(90)]
    for _, v in rows:
        v[9] = 0.25                            # a dimension without variance
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, None), (91, []), (92, None), (93, [None] * 10), (94, [float("nan")] * 10),
             (95, [float("inf")] + [0.0] * 9), (96, [1.0, 2.0]), (97, [-float("inf")] * 10)]
    return rows


def test_whiten_against_brute_force(spark):
    from labelscope.llm.whitening import whiten
    rows = awkward_rows()
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, component int, vector int").repartition(5)
    got = whiten(table).collect()
    compare(got, brute(rows))
    assert got[0]["identity_error"] < 1e-9
    x = {k: np.array([r["whitened"] for r in got if r["component"] == k]) for k in range(1, 9)}
    assert abs(np.mean(x[1] * x[1]) - 1) < 1e-9 and abs(np.mean(x[1] * x[8])) < 1e-9


@pytest.mark.parametrize("rows", [[(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5]), (3, [0.5])]])
def test_vectors_without_variance(spark, rows):
    from labelscope.llm.whitening import whiten
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows) * len(rows[0][1])
    assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(0, None, 0.0, 0.0)}


def test_no_vector_left(spark):
    from labelscope.llm.whitening import whiten
    for rows in ([], [(1, None)]):
        assert whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_deviations_beyond_a_long():
    from labelscope.llm.whitening import deviations
    x, n = np.array([[99_000, 100_500], [101_000, 99_500]]), 10 ** 12
    total = np.array([100_000 * n, 100_000 * n], object)
    assert list(deviations(x, n, total)) == [1_250_000 * n * n, 1_250_000 * n * n]
    assert list(deviations(x, 2, np.array([200_000, 200_000], object))) == [5_000_000, 5_000_000]


def test_query_on_the_whole_table(spark):
    from labelscope.llm.queries import op13_embedding_whitening
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = op13_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes)["deviation"] == "bigint"
    compare(got.collect(), brute(rows))


def test_entries_too_large_are_refused():
    import pyarrow as pa
    from labelscope.llm.whitening import whole
    with pytest.raises(ValueError):
        whole(pa.array([[1e300, 0.0]]), 2)
