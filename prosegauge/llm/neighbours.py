"""Operator 9: approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.llm.common import mix, saved

#: The fit: so many vectors tell the spread of a hash, and the true neighbours of so many queries set the probes.
SAMPLE_ROWS, SAMPLE_QUERIES = 2000, 48
TABLES, BUCKET_ROWS, AIM, MAX_PROBES = 2, 512, 0.96, 128
#: A bucket over so many vectors or probes is compared in blocks.
BLOCK_ROWS = 8192


@dataclass
class Index:
    """Hashes floor((a.v + b) / width) with normal a: ``hashes`` of them for each table."""

    directions: np.ndarray  # tables, hashes, dimensions
    shifts: np.ndarray
    width: float
    probes: int

    def cells(self, vectors: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers, and the place inside each cell from 0 to 1."""
        at = vectors @ self.directions[t].T / self.width + self.shifts[t]
        cell = np.floor(at)
        return np.clip(cell, -2**40, 2**40).astype(np.int64), at - cell

    @staticmethod
    def key(cells: np.ndarray) -> np.ndarray:
        out = np.zeros(cells.shape[:-1], np.uint64)
        for j in range(cells.shape[-1]):
            out = mix(out + cells[..., j].astype(np.uint64) * np.uint64(2) + np.uint64(j + 1))
        return out.view(np.int64)

    def sequence(self, place: np.ndarray, count: int) -> list[tuple[int, ...]]:
        """Perturbations of a query's cell, likeliest first: least sum of squared distances to the cells visited.

        Each hash has its choices in order of distance; a heap joins them best first.
        """
        choices = []
        for f in place.tolist():
            cost = [(0.0, 0)] + [(d * d, s) for k in (1, 2, 3) for d, s in ((k - f, k), (f + k - 1, -k))]
            choices.append(sorted(cost))
        # the hashes in order of their second choice, so that each set of choices is reached in one way
        order = sorted(range(len(choices)), key=lambda j: choices[j][1][0])
        out = [tuple([0] * len(choices))]
        heap = [(choices[order[0]][1][0], 0, ((0, 1),))] if count > 1 else []
        while heap and len(out) < count:
            cost, last, picked = heapq.heappop(heap)
            step = [0] * len(choices)
            for j, k in picked:
                step[order[j]] = choices[order[j]][k][1]
            out.append(tuple(step))
            j, k = picked[-1]
            now = choices[order[j]]
            if k + 1 < len(now):
                heapq.heappush(heap, (cost - now[k][0] + now[k + 1][0], last, (*picked[:-1], (j, k + 1))))
            if j + 1 < len(order):
                ahead = choices[order[j + 1]][1][0]
                heapq.heappush(heap, (cost + ahead, j + 1, (*picked, (j + 1, 1))))
                if k == 1:
                    heapq.heappush(heap, (cost - now[1][0] + ahead, j + 1, (*picked[:-1], (j + 1, 1))))
        return out


def _usable(vector: Column) -> Column:
    double = vector.cast("array<double>")
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(double, lambda x: x != 0)


def _stack(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pa.Array):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def nearest_of(ids: np.ndarray, vectors: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest by distance, then id; every one but the query's own row."""
    far = np.sqrt(((vectors - query) ** 2).sum(1))
    keep = np.flatnonzero(ids != own)
    if len(keep) > k:
        edge = np.partition(far[keep], k - 1)[k - 1]
        keep = keep[far[keep] <= edge]
    keep = keep[np.lexsort((ids[keep], far[keep]))][:k]
    return ids[keep], far[keep]


def _top(df: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _against_few(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """Exact neighbours of a bounded list of queries: each batch gives its own nearest."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column("vec_id").to_numpy(), _stack(batch.column("embedding"))
            for query, vector in queries if len(ids) else ():
                found, far = nearest_of(ids, own, query, np.array(vector), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), query)), pa.array(found), pa.array(far)], ["query_id", "vec_id", "score"])

    return _top(vectors.mapInArrow(compare, "query_id long, vec_id long, score double"), k)


def fit(vectors: DataFrame, queries: DataFrame, k: int, seed: int = 11) -> Index:
    """Width, number of hashes and number of probes.

    The width is 1.8 times the median distance of a k-th neighbour, from the true neighbours of up to
    ``SAMPLE_QUERIES`` queries among all vectors. The number of hashes leaves about ``BUCKET_ROWS`` vectors for a
    bucket at the entropy of a hash over up to ``SAMPLE_ROWS`` vectors. Probes double until the calibration queries
    find the share ``AIM`` of their true neighbours; if ``MAX_PROBES`` are not enough, there is one hash less.
    """
    pick = lambda df, n: [(r[0], list(r[1])) for r in df.select(
        "vec_id", F.col("embedding").cast("array<double>")).orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(n).collect()]
    few, some = pick(queries, SAMPLE_QUERIES), pick(vectors, SAMPLE_ROWS)
    total = vectors.count()
    true = _against_few(vectors, few, k).join(vectors, "vec_id").select("query_id", "rank", "embedding").collect() if few else []
    sample = np.array([v for _, v in some]) if some else np.zeros((1, 1))
    at = dict(few)
    pairs = [(np.array(at[r["query_id"]]), np.asarray(r["embedding"], np.float64)) for r in true]
    last = [np.linalg.norm(q - v) for (q, v), r in zip(pairs, true, strict=True) if r["rank"] == k]
    width = 1.8 * float(np.median(last)) if last and np.median(last) > 0 else float(max(sample.std(), 1e-9))
    draw = np.random.default_rng(seed)
    dims = sample.shape[1]
    trial = np.floor(sample @ draw.normal(size=(8, dims)).T / width + draw.uniform(size=8))
    entropy = []
    for j in range(8):
        _, times = np.unique(trial[:, j], return_counts=True)
        p = times / times.sum()
        entropy.append(float(-(p * np.log(p)).sum()))
    hashes = math.ceil(math.log(max(total / BUCKET_ROWS, 2)) / max(np.mean(entropy), 0.25))
    hashes = min(max(hashes, 2), 24)
    while True:
        index = Index(draw.normal(size=(TABLES, hashes, dims)), draw.uniform(size=(TABLES, hashes)), width, 1)
        ranks = _visits(index, pairs)
        while index.probes < MAX_PROBES and (ranks < index.probes).mean() < AIM:
            index.probes *= 2
        if hashes == 1 or (ranks < index.probes).mean() >= AIM:
            return index
        hashes -= 1


def _visits(index: Index, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """After how many probes each query meets its neighbour, in the better table."""
    ranks = np.full(max(len(pairs), 1), MAX_PROBES if pairs else 0)
    for t in range(TABLES):
        made: dict[bytes, dict[tuple[int, ...], int]] = {}
        for i, (q, v) in enumerate(pairs):
            cell, place = index.cells(q[None], t)
            steps = made.get(q.tobytes())
            if steps is None:
                steps = made[q.tobytes()] = {s: n for n, s in enumerate(index.sequence(place[0], MAX_PROBES))}
            other, _ = index.cells(v[None], t)
            ranks[i] = min(ranks[i], steps.get(tuple((other - cell)[0].tolist()), MAX_PROBES))
    return ranks


def search(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The k nearest rows (Euclidean distance in doubles) of each query row, nearest first, ties to smaller vec_id.

    ``rows``: vec_id, embedding. Null ids, and vectors that are null, zero or hold null or non-finite components, take
    no part; neither do vectors of another length than most. Rows that agree in id and vector count once; of equal
    vectors only the k + 1 smallest ids can be in a result, so only they are indexed (ranked map-side first).

    Each vector lies in one bucket of each table; a query visits buckets in estimated success order. Buckets are
    compared exactly, large ones in blocks; only a bucket's nearest k leave it. A query that finds fewer than k is
    compared with all rows in blocks. An empty table gives no rows. Columns: query_id, rank, vec_id, score.
    """
    spark = rows.sparkSession
    used = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("query"))
    sizes = used.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.range(0).select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"),
                                     F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score"))
    used = used.where(F.size("embedding") == sizes[0]["n"])
    equal = Window.partitionBy("embedding").orderBy("vec_id")
    vectors = saved(used.withColumn("_n", F.dense_rank().over(equal)).where(F.col("_n") <= k + 1).drop("_n").distinct(),
                    "vectors")
    queries = saved(used.where("query").select("vec_id", "embedding").distinct(), "queries")
    index = fit(vectors, queries, k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _stack(batch.column("embedding"))
            for t in range(TABLES) if len(own) else ():
                keys = index.key(index.cells(own, t)[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), t, np.int32)), pa.array(keys), batch.column("vec_id"),
                     pa.array(list(own), pa.list_(pa.float64()))], ["tbl", "bucket", "vec_id", "embedding"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ids = _stack(batch.column("embedding")), batch.column("vec_id").to_numpy()
            for t in range(TABLES) if len(own) else ():
                cells, places = index.cells(own, t)
                for i in range(len(own)):
                    keys = np.unique(index.key(cells[i] + np.array(index.sequence(places[i], index.probes))))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), t, np.int32)), pa.array(keys), pa.array(np.full(len(keys), ids[i])),
                         pa.array([own[i]] * len(keys), pa.list_(pa.float64()))], ["tbl", "bucket", "vec_id", "embedding"])

    schema = "tbl int, bucket long, vec_id long, embedding array<double>"
    placed = vectors.select("vec_id", "embedding").mapInArrow(place, schema)
    probes = queries.mapInArrow(probe, schema)
    found = _compare(placed, probes, k)
    enough = _top(found.distinct(), k)
    result = saved(enough.select("query_id", "rank", "vec_id", "score"), "neighbours")
    short = queries.join(result.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= k), "vec_id", "left_anti")
    if short.isEmpty():
        return result
    return result.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(
        _top(_compare(_everywhere(vectors.select("vec_id", "embedding")), _everywhere(short), k).distinct(), k).select(
            "query_id", "rank", "vec_id", "score")).select("query_id", "rank", "vec_id", "score")


def _everywhere(df: DataFrame) -> DataFrame:
    return df.select(F.lit(0).alias("tbl"), F.lit(0).cast("long").alias("bucket"), "vec_id",
                     F.col("embedding").cast("array<double>").alias("embedding"))


def _compare(placed: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """Exact distances of all probes to the vectors of their bucket, as blocks of bounded size."""
    many = lambda df, name: df.groupBy("tbl", "bucket").agg(F.count("*").alias(name)).where(F.col(name) > BLOCK_ROWS)
    hot = many(placed, "rows").join(many(probes, "asks"), ["tbl", "bucket"], "full").select(
        "tbl", "bucket", F.ceil(F.coalesce("rows", F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"),
        F.ceil(F.coalesce("asks", F.lit(1)) / BLOCK_ROWS).cast("int").alias("shares"))

    def block(df: DataFrame, own: str, other: str) -> DataFrame:
        one = F.coalesce(own, F.lit(1))
        return df.join(hot, ["tbl", "bucket"], "left").select(
            "tbl", "bucket", F.pmod(F.hash("vec_id"), one).alias(own),
            F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(other), "vec_id", "embedding")

    def meet(vectors: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(asks):
            ids, own = vectors["vec_id"].to_numpy(), _stack(vectors["embedding"])
            for query, vector in zip(asks["vec_id"], asks["embedding"], strict=True):
                found, far = nearest_of(ids, own, query, np.asarray(vector, np.float64), k)
                out.append(pd.DataFrame({"query_id": query, "vec_id": found, "score": far}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["tbl", "bucket", "parts", "shares"]
    return block(placed, "parts", "shares").groupBy(keys).cogroup(
        block(probes, "shares", "parts").groupBy(keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
