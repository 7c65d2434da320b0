"""Binning expressions (X18-X21, A7/A8 bin index, A10 histogram bins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paircraft.schema import LEN_DIFF_EDGES


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def inner_edges(edges: Column) -> Column:
    """Edges without the first and last; empty when fewer than 3 edges."""
    return F.when(F.size(edges) > 2, F.slice(edges, 2, F.size(edges) - 2)) \
            .otherwise(F.array().cast("array<double>"))


def qcut_bin(x, edges: Column) -> Column:
    """0-based bin of ``x`` for sorted distinct ``edges`` with right-closed
    bins, the lowest edge included (``qcut``/``cut`` semantics): the number
    of inner edges strictly below ``x``. Null stays null."""
    x = _c(x)
    return F.when(x.isNotNull(), F.size(F.filter(inner_edges(edges), lambda e: e < x)))


def fixed_bin(x, edges=LEN_DIFF_EDGES, null_bin: int = 0) -> Column:
    """``cut(x, edges, include_lowest=True)`` with null / out-of-range -> ``null_bin``
    (X18). Right-closed; ``Bucketizer`` is left-closed and is not used."""
    x = _c(x)
    lo, hi = float(edges[0]), float(edges[-1])
    e = F.array(*[F.lit(float(v)) for v in edges])
    b = F.size(F.filter(inner_edges(e), lambda t: t < x))
    return F.when(x.isNull() | (x < lo) | (x > hi), F.lit(null_bin)).otherwise(b).cast("int")


def one_hot(idx, width: int) -> Column:
    """``array<double>`` of ``width`` with a 1 at ``idx``."""
    i = _c(idx)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                       lambda k: F.when(k == i, 1.0).otherwise(0.0))


def width_bucket(x, lo, hi, n: int) -> Column:
    """1-based equal-width bin over [lo, hi], the maximum in the last bin
    (histogram data, A10). A constant column falls in bin 1."""
    x, lo, hi = _c(x), _c(lo), _c(hi)
    b = F.floor((x - lo) * n / (hi - lo)) + 1
    return F.when(hi == lo, F.lit(1)).otherwise(F.least(b, F.lit(n))).cast("int")
