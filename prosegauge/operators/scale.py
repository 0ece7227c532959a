"""Skew-proof building blocks.

A plain window over one key sorts that key in one task. One user, class or
label may hold a third of all rows, so running values and ranks are computed in
two levels instead: inside (key, chunk) partitions, plus one offset per chunk
from a small pre-aggregated table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prosegauge.session import checkpointed


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL meets NULL, so that no row of ``left`` is lost."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in ranges of ``keys`` and ``order`` of about equal row counts; ``_chunk`` is the number of the range.

    A hot key, or a hot day of one, is spread over many ranges. The ranges are sampled, so they are fixed by a
    checkpoint before anything reads them twice; the input itself is read once.
    """
    return checkpointed(df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id()))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None,
            maxima: Mapping[str, Column] | None = None, inclusive: bool = True) -> DataFrame:
    """Add running sums and maxima per ``keys`` in ``order``.

    Works inside (key, chunk) partitions; only one row per (key, chunk) meets in a window of a key. A frame that is
    ``chunked`` already keeps its ``_chunk``.
    """
    given = "_chunk" in df.columns
    sums, maxima = dict(sums or {}), dict(maxima or {})
    fold = {**{n: F.sum for n in sums}, **{n: F.max for n in maxima}}
    cut = [*keys, "_chunk"]
    base = (df if given else chunked(df, keys, order)).select(
        "*", *[e.alias(f"_v_{n}") for n, e in {**sums, **maxima}.items()], F.lit(1).alias("_place"))
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = base.groupBy(*cut).agg(*[f(f"_v_{n}").alias(f"_v_{n}") for n, f in fold.items()])
    # what came before a chunk enters it as one row ahead of the others: no join, one shuffle, NULL keys included
    heads = totals.select(*cut, *[f(f"_v_{n}").over(earlier).alias(f"_v_{n}") for n, f in fold.items()],
                          F.lit(0).alias("_place"))
    here = W.partitionBy(*cut).orderBy("_place", *order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    both = base.unionByName(heads, allowMissingColumns=True)
    value = {n: f(f"_v_{n}").over(here) for n, f in fold.items()}
    placed = both.select(*df.columns, *([] if given else ["_chunk"]), "_place", *[
        (F.coalesce(v, F.lit(0)) if n in sums else v).alias(n) for n, v in value.items()]).filter("_place = 1")
    return placed.drop("_place") if given else placed.drop("_place", "_chunk")


def hash_order(key: Column, seed: int) -> Column:
    """Repeatable shuffle key: any engine with md5 gives the same order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def group_rank(df: DataFrame, group: str, order: str, upto: int | None = None, digits: int = 3) -> DataFrame:
    """Exact 1-based ``_rank`` by a hexadecimal hash column, and group size ``_size``.

    Rows are ranked inside (group, hash prefix) partitions: 4096 of them per
    group by default. With ``upto`` the prefixes that lie wholly beyond that
    rank are dropped before the shuffle.
    """
    base = df.withColumn("_prefix", F.substring(order, 1, digits))
    counts = base.groupBy(group, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    by_group = W.partitionBy(group)
    offsets = counts.select(
        group, "_prefix",
        F.coalesce(F.sum("_n").over(by_group.orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.sum("_n").over(by_group).alias("_size"),
    )
    if upto is not None:
        offsets = offsets.filter(F.col("_before") < upto)
    inside = W.partitionBy(group, "_prefix").orderBy(order)
    ranked = (join_null_safe(base, offsets, [group, "_prefix"])
              .withColumn("_rank", F.col("_before") + F.row_number().over(inside))
              .drop("_prefix", "_before"))
    return ranked if upto is None else ranked.filter(F.col("_rank") <= upto)


def first_rows(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """First row per key. Copies are folded map-side, so a group of any size is safe."""
    row = F.struct(*[F.col(c) for c in df.columns])
    # JSON keeps the values apart, and NULL from every text
    key = F.sha2(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"}), 256)
    return df.groupBy(key.alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                  rank: str = "_rank") -> DataFrame:
    """Best ``k`` rows per group. Spark's own group limit cuts every group to ``k`` rows in each task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def top_by_own_limit(df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: str, unique: Sequence[str],
                     salts: int = 32) -> DataFrame:
    """Best rows per group, as many as the group's column ``limit`` says (the same in all its rows; any size).

    Rows are cut per (group, salt) first, so a hot group reaches its last task as ``salts * limit`` rows. ``unique``
    names the columns that tell rows of a group apart.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*unique), F.lit(salts)))
    for keys in ([*group, "_salt"], group):
        salted = salted.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(
            F.col("_rank") <= F.col(limit))
    return salted.drop("_salt")
