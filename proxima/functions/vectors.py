"""Column expressions over dense vectors stored as ``ARRAY<DOUBLE>``.

Everything here builds a ``Column``; nothing runs until the caller's action, and every
expression stays inside whole-stage codegen except the higher-order form of the distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Widest vector for which the distance is unrolled into one arithmetic expression; wider
# vectors use the higher-order form, whose cost does not grow the generated code.
UNROLL_LIMIT = 128


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squared_distance(a, b, dim: int | None = None) -> Column:
    """Sum over i of (a[i] - b[i])^2, added left to right.

    With a static ``dim`` the sum is unrolled, ``((t0 + t1) + t2) + ...``, which codegen turns
    into straight-line arithmetic.  Without it, ``aggregate(zip_with(...))`` adds the same terms
    in the same order, so both forms are bit-identical.  The order matters: ties between
    neighbours are decided on exact equality of distances.
    """
    a, b = _col(a), _col(b)
    if dim is not None and 0 < dim <= UNROLL_LIMIT:
        terms = []
        for i in range(dim):
            diff = a.getItem(i) - b.getItem(i)
            terms.append(diff * diff)
        return reduce(lambda s, t: s + t, terms)
    if dim == 0:
        return F.lit(0.0)
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
        F.lit(0.0).cast("double"),
        lambda acc, v: acc + v,
    )


def euclidean(a, b, dim: int | None = None) -> Column:
    """Euclidean distance between two vectors of equal length (the label is not part of them)."""
    return F.sqrt(squared_distance(a, b, dim))


def checked_dim(features, dim: int, what: str = "vector", row_id=None) -> Column:
    """``features`` unchanged, or a runtime error naming the row and its size when it is not ``dim``.

    The check is a lazy per-row expression, so it costs no extra pass over the data and both
    distance forms see only vectors of the declared width.
    """
    f = _col(features)
    row = F.lit("") if row_id is None else F.concat(
        F.lit(" of row "), F.coalesce(_col(row_id).cast("string"), F.lit("NULL")))
    size = F.when(f.isNull(), F.lit("no")).otherwise(F.size(f).cast("string"))
    return F.when(F.size(f) == F.lit(dim), f).otherwise(
        F.raise_error(F.concat(F.lit(what), row, F.lit(" has "), size, F.lit(f" values where {dim} were declared"))))


def feature_part(values, dim: int | None = None) -> Column:
    """The first ``dim - 1`` values of a row whose last value is the label.

    ``dim`` counts the label, as in the original programs; without it, every value but the
    last is a feature.
    """
    v = _col(values)
    n = F.lit(dim - 1) if dim is not None else F.size(v) - 1
    return F.slice(v, 1, n)


def label_part(values, dim: int | None = None) -> Column:
    """The label of a row: its last value, or the value at position ``dim`` when declared."""
    v = _col(values)
    if dim is not None:
        return F.element_at(v, dim)
    return F.element_at(v, -1)
