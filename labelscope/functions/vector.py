"""Dense-vector expressions over ``array<double>`` columns (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double_array(col) -> Column:
    return _c(col).cast("array<double>")


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def unit_norm(a, eps: float = 0.0) -> Column:
    """Row divided by its L2 norm (+eps); an all-zero row stays zero."""
    v = _c(a)
    n = l2_norm(v) + F.lit(eps)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(
        F.transform(v, lambda x: x * 0.0))


def sq_dist(a, b) -> Column:
    d = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def euclid(a, b) -> Column:
    return F.sqrt(sq_dist(a, b))
