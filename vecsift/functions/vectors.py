"""Vector algebra as column expressions over array<double>: they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    """Cast before any arithmetic: float32 sums can swap ranks."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x / by)


def unit(v: Column) -> Column:
    """v / |v|; a zero vector is an error, as a refusal would hide it."""
    n = norm(v)
    return F.when(n > 0, scaled(v, n)).otherwise(F.raise_error(F.lit("zero vector")).cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """Two-step normalisation (largest component, then length) and a clip to [-1, 1]."""
    most = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))
    a, b = scaled(a, most(a)), scaled(b, most(b))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))


def negative_l2(a: Column, b: Column) -> Column:
    return -F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def average(a: Column, b: Column, weight: float = 1.0) -> Column:
    """unit(a + weight * b)."""
    return unit(F.zip_with(a, b, lambda x, y: x + weight * y))


def concatenated(a: Column, b: Column, weight: float) -> Column:
    """[sqrt(1 - w) unit(a), sqrt(w) unit(b)]: its dot product is the weighted sum of both cosines."""
    return F.concat(F.transform(unit(a), lambda x: x * (1 - weight) ** 0.5), F.transform(unit(b), lambda x: x * weight**0.5))


def centred_unit(v: Column, guard: float = 1e-9) -> Column:
    """Subtract the row's mean, divide by its length (plus a guard)."""
    mean = total(v) / F.size(v)
    c = F.transform(v, lambda x: x - mean)
    return scaled(c, norm(c) + guard)


def applied(v: Column, mean: list[float], matrix: list[list[float]]) -> Column:
    """unit(matrix (v - mean)): whitening with literals of the plan, for moderate sizes."""
    m = F.array(*[F.lit(float(x)) for x in mean])
    c = F.zip_with(v, m, lambda x, y: x - y)
    return unit(F.array(*[dot(c, F.array(*[F.lit(float(x)) for x in row])) for row in matrix]))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes x, y, w, h; 0 where both are empty."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    w = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = (w * h).cast("double")
    union = (aw * ah + bw * bh) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
