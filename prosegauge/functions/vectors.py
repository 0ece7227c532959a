"""Vector expressions over ARRAY<FLOAT|DOUBLE> columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from prosegauge.functions.numeric import ratio, unit


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), norm(a) * norm(b))


def prototype_similarity(vec: Column, prototypes: Sequence[Sequence[float]]) -> Column:
    """Best cosine against a few constant vectors, stretched to 0-1."""
    consts = [F.array(*[F.lit(float(v)) for v in p]) for p in prototypes]
    sims = [cosine(vec, p) for p in consts]
    best = sims[0] if len(sims) == 1 else F.greatest(*sims)
    return F.when(vec.isNotNull(), unit((best - 0.15) / 0.65)).otherwise(0.0)
