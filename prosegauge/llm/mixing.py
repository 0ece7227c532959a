"""Operator 2: mixing sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.llm.common import saved
from prosegauge.llm.graph import components

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many patterns the tables with a row for each are broadcast; more are joined by shuffle, with the same result.
MAX_PATTERNS = 20_000
BUCKETS = 4096
#: Rounds of choosing documents that fit into what the rounds before left of a quota.
ROUNDS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> dict[str | None, float]:
    """Each source's share of all words: weights repeat over the sources by code point, null last; a share stops at
    ``most`` times the source's size, and what is over is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, list(order)
    while open_:
        rest = total - sum(out.values())
        scale = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if scale * weight[s] > most * sizes[s]]
        out |= {s: float(most * sizes[s]) for s in full} if full else {s: scale * weight[s] for s in open_}
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: list[tuple[tuple[str | None, ...], int]], quotas: dict[str | None, int],
          most: int = 3) -> dict[int, dict[str | None, int]]:
    """Words that each pattern gives each of its sources: a flow of most words at least cost.

    The k-th use of a pattern's words costs k, so the first uses of all are taken before any repeats. Shortest
    augmenting paths with potentials; each one fills a use, a quota or a path back.
    """
    source = {s: i for i, s in enumerate(quotas)}
    first, n = 2 + len(patterns), 2 + len(patterns) + len(source)
    graph: list[list[list[int]]] = [[] for _ in range(n)]  # arcs: to, room, cost, place of the way back

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for i, (members, size) in enumerate(patterns):
        for k in range(1, most + 1):
            arc(0, 2 + i, size, k)
        for s in members:
            arc(2 + i, first + source[s], most * size, 0)
    for s, i in source.items():
        arc(first + i, 1, quotas[s], 0)
    high = [0] * n
    while True:
        far, via = [float("inf")] * n, [None] * n
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room > 0 and (new := d + cost + high[a] - high[b]) < far[b]:
                    far[b], via[b] = new, (a, k)
                    heapq.heappush(heap, (new, b))
        if via[1] is None:
            break
        high = [h + f if f < float("inf") else h + far[1] for h, f in zip(high, far, strict=True)]
        room, b = None, 1
        while b:
            a, k = via[b]
            room, b = graph[a][k][1] if room is None else min(room, graph[a][k][1]), a
        b = 1
        while b:
            a, k = via[b]
            graph[a][k][1] -= room
            graph[b][graph[a][k][3]][1] += room
            b = a
    names = list(source)
    return {
        i: {names[b - first]: most * size - left for b, left, _, _ in graph[2 + i] if b >= first}
        for i, (_, size) in enumerate(patterns)
    }


def _goals(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``targets`` of a table of any length: source, source_size, place (in order), target."""
    rows = saved(sizes.orderBy(F.col("source").isNull(), "source").select(
        "source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "mix-sources")
    before, offsets = 0, []
    for r in rows.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        offsets.append((r["part"], before))
        before += r["count"]
    offset = sizes.sparkSession.createDataFrame(offsets, "part int, before long")
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    rows = saved(rows.join(F.broadcast(offset), "part").withColumn("place", place).select(
        "source", "source_size", "place", weight.alias("weight")), "mix-sources")
    cap = most * F.col("source_size")
    scale, closed = 0.0, -1
    while True:  # a source at its cap stays there, as the level only rises
        full = F.lit(scale) * F.col("weight") > cap
        got = rows.agg(F.sum("source_size").alias("total"), F.count_if(full).alias("closed"),
                       F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if got["closed"] == closed or not got["open"]:
            break
        scale, closed = (got["total"] - float(got["capped"] or 0)) / got["open"], got["closed"]
    return rows.select("source", "source_size", "place", F.when(full, cap.cast("double")).otherwise(
        F.lit(scale) * F.col("weight")).alias("target"))


def _given(patterns: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """Words that each pattern gives: pattern, given.

    A source that no other shares takes what its only pattern has. Patterns of sources that overlap go to the flow, each
    connected group of sources in a task of its own.
    """
    member = patterns.select("pattern", "size", F.size("sources").alias("n"), F.explode("sources").alias("source"))
    member = member.join(goals, member["source"].eqNullSafe(goals["source"])).select(
        "pattern", "size", "n", "place", F.rint("target").cast("long").alias("quota"))
    alone = member.where("n = 1").select("pattern", "place", F.least("quota", most * F.col("size")).alias("given"))
    shared = saved(member.where("n > 1"), "mix-shared")
    if shared.isEmpty():
        return alone.select("pattern", "given")
    lead = shared.groupBy("pattern").agg(F.min("place").alias("a"))
    links = saved(shared.join(lead, "pattern").where("a != place").select("a", F.col("place").alias("b")).distinct(), "mix-links")
    groups = saved(components(links), "mix-groups")
    flows = member.join(groups, member["place"] == groups["node"]).select("root", "pattern", "size", "place", "quota")

    def flow(rows: pd.DataFrame) -> pd.DataFrame:
        found = sorted((sorted(part["place"].tolist()), int(part["size"].iloc[0]), number) for number, part in rows.groupby("pattern"))
        got = route([(tuple(members), size) for members, size, _ in found],
                    dict(zip(rows["place"].tolist(), rows["quota"].tolist(), strict=True)), most)
        return pd.DataFrame({"pattern": [number for _, _, number in found], "given": [sum(got[i].values()) for i in range(len(found))]})

    free = alone.join(groups, alone["place"] == groups["node"], "left_anti").select("pattern", "given")
    return free.unionByName(flows.groupBy("root").applyInPandas(flow, "pattern long, given long"))


def _fill(slim: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Choose, in seeded order, the documents of each pattern that fit into what is left, up to the first that is over.

    Sums of the parts of the order find the part where the room ends; only that part's rows are ranked.
    """
    fits = slim.where("NOT chosen AND size > 0 AND size <= left")
    parts = fits.groupBy("sources", "left", "bucket").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("sources").orderBy("bucket"))
    cut = parts.withColumn("upto", upto).where("upto > left AND upto - words <= left").select(
        "sources", F.col("bucket").alias("cut"), (F.col("left") - (F.col("upto") - F.col("words"))).alias("room"))
    some = fits.join(small(cut), "sources").where("bucket = cut")  # cut: a row for each pattern at most
    ranked = some.groupBy("sources", "room", "order").agg(F.sum("size").alias("words")).withColumn(
        "upto", F.sum("words").over(Window.partitionBy("sources").orderBy("order")))
    last = ranked.where("upto <= room").groupBy("sources").agg(F.max("order").alias("last"))
    slim = slim.join(small(cut), "sources", "left").join(small(last), "sources", "left")
    below = F.col("cut").isNull() | (F.col("bucket") < F.col("cut")) | (
        F.col("bucket") == F.col("cut")) & F.coalesce(F.col("order") <= F.col("last"), F.lit(False))
    slim = slim.withColumn("new", ~F.col("chosen") & (F.col("size") > 0) & (F.col("size") <= F.col("left")) & below)
    used = slim.where("new").groupBy("sources").agg(F.sum("size").alias("used"))
    return slim.join(small(used), "sources", "left").select(
        *[c for c in slim.columns if c not in ("chosen", "left", "new", "cut", "room", "last")],
        (F.col("chosen") | F.col("new")).alias("chosen"), (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"))


def mix_sources(docs: DataFrame, members: Column, *, weights: tuple[int, ...] = (5, 2, 1), most: int = 3,
                seed: int = 7) -> DataFrame:
    """How many words of each document a mix takes so that each source comes to its target.

    ``members``: array of the sources that a document belongs to; null or empty counts as one null source. Documents
    are summed by membership pattern; quotas and, where sources overlap, the flow run on those sums, any number of them. Inside a pattern all
    documents are used equally often, and some once more: those first in a seeded order, in ``ROUNDS`` rounds of what
    still fits, and one as many times more as fits the rest best. Only one of ``BUCKETS`` parts of the order is ranked.

    One row for each input row: doc_id, size, sources (array), source_size and target (of the first source), repeats,
    taken = size * repeats. Null or empty texts have size 0 and taken 0. Rows that agree in id and text are taken or left
    together. An empty table gives no rows. Same rows, same result, however they are partitioned.
    """
    return _mixed(docs, members, weights, most, seed).drop("order")


def _mixed(docs: DataFrame, members: Column, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """``mix_sources`` with the seeded order number of each row."""
    own = F.coalesce(members, F.array(F.lit(None).cast("string")))
    own = F.array_sort(F.array_distinct(F.when(F.size(own) == 0, F.array(F.lit(None).cast("string"))).otherwise(own)))
    slim = saved(docs.select(
        "doc_id", own.alias("sources"), word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("order")), "mix")
    patterns = saved(slim.groupBy("sources").agg(F.sum("size").alias("size")).withColumn(
        "pattern", F.monotonically_increasing_id()), "mix-patterns")
    small = F.broadcast if patterns.count() <= MAX_PATTERNS else lambda df: df
    goals = saved(_goals(patterns.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(
        F.sum("size").alias("source_size")), weights, most), "mix-goals")
    first = patterns.withColumn("first", F.get("sources", F.lit(0)))
    given = F.when(F.col("size") > 0, F.col("given")).otherwise(0)
    own = F.when(F.col("size") > 0, F.col("size")).otherwise(1)
    plan = small(saved(first.join(goals, first["first"].eqNullSafe(goals["source"])).join(
        _given(patterns, goals, most), "pattern").select(
            "sources", "source_size", "target", ((given - given % own) / own).cast("long").alias("every"),
            (given % own).alias("rest")), "mix-plan"))
    slim = slim.join(plan, "sources").withColumn("bucket", F.shiftrightunsigned("order", 52).cast("int")).withColumns(
        {"chosen": F.lit(False), "left": F.col("rest")})
    for _ in range(ROUNDS):
        slim = saved(_fill(slim, small), "mix-round")
    used = F.col("every") + F.col("chosen").cast("long")
    times = F.least(F.lit(most) - used, F.round(F.col("left") / F.col("size")).cast("long"))
    fit = slim.where("size > 0 AND left > 0").withColumn("times", times).where("times > 0").groupBy("sources").agg(
        F.min(F.struct(F.abs(F.col("left") - F.col("times") * F.col("size")).alias("off"), "order", "times")).alias("best"),
        F.max("left").alias("still")).where("best.off < still").select(
        "sources", F.col("best.order").alias("fit"), F.col("best.times").alias("times"))
    out = slim.join(small(fit), "sources", "left")  # at most a row for each pattern
    more = F.when(F.col("order") == F.col("fit"), F.col("times")).otherwise(F.lit(0))
    repeats = F.when(F.col("size") > 0, used + more).otherwise(F.lit(0))
    return out.select("doc_id", "size", "sources", "source_size", "target", repeats.alias("repeats"),
                      (F.col("size") * repeats).alias("taken"), "order")


def mixed_documents(docs: DataFrame, members: Column, *, weights: tuple[int, ...] = (5, 2, 1), most: int = 3,
                    seed: int = 7) -> DataFrame:
    """The documents that a mix takes, each as often as it is repeated, with the columns of ``docs``."""
    taken = _mixed(docs, members, weights, most, seed).where("repeats > 0").select("order", "repeats").distinct()
    times = taken.select("order", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("order"))
    return rows.join(times.select("order"), "order").select("_row.*")
