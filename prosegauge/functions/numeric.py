"""Small numeric column expressions shared by every operator."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def clip(c: Column, lo: float, hi: float) -> Column:
    """Bound a value that is not NULL (``greatest`` and ``least`` skip NULLs)."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def unit(c: Column) -> Column:
    return clip(c, 0.0, 1.0)


def rounded(c: Column, digits: int) -> Column:
    """Half-up rounding. The nudge makes ties independent of the last floating-point bit."""
    return F.round(c + 1e-9, digits)


def r4(c: Column) -> Column:
    return rounded(c, 4)


def r2(c: Column) -> Column:
    return rounded(c, 2)


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def any_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def weighted(cols: Mapping[str, Column] | None = None, weights: Mapping[str, float] | None = None, **_) -> Column:
    """Sum of ``weights[k] * cols[k]``."""
    return total([F.lit(w) * cols[k] for k, w in weights.items()])


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num / den, or ``default`` where the denominator is not positive."""
    safe = F.when(den > 0, num / den)
    return safe if default is None else F.coalesce(safe, F.lit(default))


def to_float0(c: Column) -> Column:
    """Lenient cast of text with default 0 (an empty text is sorted out before the cast can fail)."""
    return F.coalesce(F.nullif(c, F.lit("")).try_cast("double"), F.lit(0.0))


def to_int0(c: Column) -> Column:
    """Lenient truncating cast of text with default 0."""
    return F.coalesce(F.nullif(c, F.lit("")).try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def clamp(c: Column, lo: float, hi: float, default: float) -> Column:
    """Clamp to [lo, hi]; anything that is not a number becomes ``default``."""
    number = c.try_cast("double")
    return F.when(number.isNull(), default).otherwise(clip(number, lo, hi))


def score_band(c: Column) -> Column:
    return (F.when(c >= 80.0, "excellent").when(c >= 60.0, "good").when(c >= 40.0, "fair").otherwise("poor"))


def score_percent(c: Column) -> Column:
    """Position of a 20-95 score inside its range, in percent."""
    return clip((c - 20.0) / 75.0 * 100.0, 0.0, 100.0)


def normalize_probs(cols: Sequence[Column], fallback: str = "uniform") -> list[Column]:
    """Clip at zero and divide by the sum; a zero vector becomes uniform or stays zero."""
    pos = [F.greatest(F.lit(0.0), c) for c in cols]
    mass = total(pos)
    default = 1.0 / len(cols) if fallback == "uniform" else 0.0
    return [ratio(c, mass, default) for c in pos]


def argmax_label(pairs: Sequence[tuple[object, Column]]) -> Column:
    """Label with the greatest value; the first declared label wins a tie."""
    best = F.greatest(*[c for _, c in pairs])
    return F.coalesce(*[F.when(c == best, F.lit(label)) for label, c in pairs])


def top_two(cols: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Greatest, second greatest, and their gap."""
    ranked = F.sort_array(F.array(*cols), asc=False)
    top, second = ranked[0], ranked[1]
    return top, second, unit(top - second)


def lookup(key: Column, table: Mapping[str, float], default: float | None = None) -> Column:
    """A small constant table as a CASE expression."""
    out = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), list(table.items())[1:],
                 F.when(key == next(iter(table)), F.lit(next(iter(table.values())))))
    return out if default is None else out.otherwise(F.lit(default))
