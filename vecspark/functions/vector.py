"""Distances and preparation of vectors, as columns and in numpy. Smaller is closer for every metric.

Sums are 32-bit and run from the first component to the last, so results agree bit for bit between the two forms; only the
norm is summed in 64 bits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecspark.config import MAX_ID


def _sum(a: Column, b: Column, term) -> Column:
    total = F.aggregate(F.zip_with(a, b, term), F.lit(0.0).cast("float"), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.concat(F.lit("dimension mismatch: "), F.size(a), F.lit(" vs "), F.size(b))).cast("float"))


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def norm(v: Column) -> Column:
    wide = F.transform(v, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x))


def normalize(v: Column) -> Column:
    """The vector over its norm; an error for a norm that is zero or not finite."""
    error = F.raise_error(F.lit("cannot normalize a vector whose norm is zero or not finite")).cast("array<float>")

    def scaled(n: Column) -> Column:
        return F.when((n > 0) & (n < float("inf")), F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(error)

    # An array of one element binds the norm, which a lambda would compute again for each component.
    return F.get(F.transform(F.array(norm(v)), scaled), F.lit(0))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Squared L2, or the negated dot product: 0 - x, so orthogonal vectors give +0.0. COSINE expects prepared vectors."""
    return squared_l2(a, b) if metric == "L2" else F.lit(0.0).cast("float") - dot(a, b)


def prepare(metric: str, v: Column) -> Column:
    """What is stored and searched for: the normalized vector under COSINE, else the vector."""
    return normalize(v) if metric == "COSINE" else v


def literal(v) -> Column:
    return F.lit([float(x) for x in np.asarray(v, np.float32)]).cast("array<float>")


def invalid(metric: str, dim: int, point_id: Column, v: Column) -> Column:
    """Why a point is not accepted, naming its id; null if it is."""
    name = F.coalesce(point_id, F.lit("null"))
    # Ids are limited in UTF-16 units; a code point beyond the basic plane has two.
    units = F.length(point_id) + F.length(F.regexp_replace(point_id, "[\\x{0}-\\x{FFFF}]", ""))
    return (
        F.when(point_id.isNull() | (F.length(point_id) == 0) | (units > MAX_ID), F.concat(F.lit(f"an id needs 1 to {MAX_ID} characters: "), name))
        .when(v.isNull() | (F.size(v) != dim), F.concat(F.lit("vector of "), name, F.lit(" has dim "), F.coalesce(F.size(v), F.lit(0)).cast("string"), F.lit(f", expected {dim}")))
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.concat(F.lit("vector of "), name, F.lit(" has a component that is not finite")))
        .when(F.lit(metric == "COSINE") & F.forall(v, lambda x: x == 0), F.concat(F.lit("vector of "), name, F.lit(" is zero, which COSINE cannot use")))
    )


def check_query(metric: str, dim: int, v) -> np.ndarray:
    """A query as it is searched for, validated like a stored point."""
    q = np.asarray(v, np.float32)
    if q.ndim != 1 or len(q) != dim:
        raise ValueError(f"vector of query has dim {q.size}, expected {dim}")
    if not np.isfinite(q).all():
        raise ValueError("vector of query has a component that is not finite")
    return prepared(metric, q[None])[0]


def prepared(metric: str, many: np.ndarray) -> np.ndarray:
    many = np.asarray(many, np.float32)
    if metric != "COSINE":
        return many
    total = np.zeros(len(many))
    for d in range(many.shape[1]):
        total += many[:, d].astype(np.float64) ** 2
    n = np.sqrt(total)
    if not ((n > 0) & np.isfinite(n)).all():
        raise ValueError("cannot normalize a vector whose norm is zero or not finite")
    return (many / n[:, None]).astype(np.float32)


def distances(metric: str, many: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of rows to a query, summed component by component."""
    total = np.zeros(len(many), np.float32)
    for d in range(many.shape[1]):
        x = many[:, d]
        total += (x - q[d]) * (x - q[d]) if metric == "L2" else x * q[d]
    return total if metric == "L2" else np.float32(0) - total
