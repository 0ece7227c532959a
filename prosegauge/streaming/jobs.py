"""Streaming forms of the per-request updates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prosegauge.lexicons import WRITING_STYLES
from prosegauge.operators.submissions import month_of, quick_score
from prosegauge.session import shared_folder

c = F.col


def with_event_time(events: DataFrame, ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    """TIMESTAMP event time (watermarks refuse TIMESTAMP_NTZ) with a watermark."""
    return events.withColumn(ts, c(ts).cast("timestamp")).withWatermark(ts, lateness)


def stream_quota(requests: DataFrame, user: str = "user_id", ts: str = "ts", model: str = "model",
                 success: str = "success", lateness: str = "1 day") -> DataFrame:
    """Successful requests per (user, model, month); run it in update mode."""
    timed = with_event_time(requests, ts, lateness)
    return timed.groupBy(user, model, month_of(ts).alias("period_start")).agg(
        F.count_if(c(success)).alias("request_count"))


def stream_quota_decisions(requests: DataFrame, limit: int, user: str = "user_id", ts: str = "ts", key: str = "id",
                           model: str = "model", success: str = "success", lateness: str = "1 day") -> DataFrame:
    """A decision per request from keyed state that ends with the month.

    State is one counter of successful remote requests per (user, month), whatever their model, as in the batch form; a
    NULL success is none. Inside a micro-batch the requests of a key are taken in time order.
    """
    timed = with_event_time(requests, ts, lateness).select(
        c(user).cast("string").alias("user_id"), c(model).alias("model"), month_of(ts).alias("month"),
        c(key).alias("id"), c(ts).alias("ts"), c(success).alias("success"))

    def decide(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        used = state.get[0] if state.exists else 0
        free = (rows["model"] == "bqs").fillna(False).astype(bool)
        counted = (rows["success"].eq(True).fillna(False).astype(bool) & ~free).astype(int)
        before = used + counted.cumsum() - counted
        state.update((int(used + counted.sum()),))
        month_end = (pd.Timestamp(keys[1]) + pd.offsets.MonthBegin(1)).value // 1_000_000
        if month_end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(month_end)
        yield pd.DataFrame({"user_id": keys[0], "model": rows["model"], "id": rows["id"], "ts": rows["ts"],
                            "used_before": before, "allowed": (before < limit) | free})

    return timed.groupBy("user_id", "month").applyInPandasWithState(
        decide, "user_id string, model string, id bigint, ts timestamp, used_before bigint, allowed boolean",
        "used bigint", "append", GroupStateTimeout.EventTimeTimeout)


def stream_profiles(scores: DataFrame, user: str = "user_id", ts: str = "ts", key: str = "id",
                    styles: Sequence[str] = WRITING_STYLES) -> DataFrame:
    """Writer profiles kept up to date: count, averages, style, reputation; run it in update mode.

    Rows of a micro-batch are folded in time order; a row of an earlier time in a later micro-batch is folded when it
    comes. State is four values per user and has no timeout.
    """
    rows = scores.select(c(user).cast("string").alias("user_id"), c(ts).cast("timestamp").alias("ts"),
                         c(key).alias("id"), c("eqs_score").cast("double").alias("eqs_score"),
                         (c("stance_label") if "stance_label" in scores.columns else F.lit(None).cast("string"))
                         .alias("style"))
    known = list(styles)

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, avg, style, points = state.get if state.exists else (0, None, None, 0)
        batch = pd.concat(list(batches)).sort_values(["ts", "id"])
        place = n + np.arange(1, len(batch) + 1)
        score = batch["eqs_score"].to_numpy(float)
        given = ~np.isnan(score)
        if avg is None and given.any():
            avg, given = 0.0, given & (np.arange(len(score)) != (first := int(np.argmax(given))))
        else:
            first = -1
        # a score x at place n turns an average a into a * (n - 1) / n + x / n; the first one is the average
        log = np.cumsum(np.log(np.where(given, (place - 1) / place, 1.0)))
        add = np.where(given, score / place, 0.0)
        if first >= 0:
            add[first] = score[first]
        averages = np.exp(log) * ((avg or 0.0) + np.cumsum(add * np.exp(-log)))
        points = max(points, int(np.floor(averages * place / 10.0 + 1e-9).max()))
        avg, n = (None if avg is None else float(averages[-1])), int(place[-1])
        named = batch["style"][batch["style"].isin(known)]
        style = named.iloc[-1] if len(named) else style
        state.update((n, avg, style, points))
        yield pd.DataFrame({"user_id": [keys[0]], "total_submissions": [n], "avg_eqs_score": [avg],
                            "writing_style": [style], "reputation_points": [points]})

    return rows.groupBy("user_id").applyInPandasWithState(
        fold, "user_id string, total_submissions bigint, avg_eqs_score double, writing_style string, "
              "reputation_points bigint",
        "n bigint, avg double, style string, points bigint", "update", GroupStateTimeout.NoTimeout)


def stream_quick_scores(docs: DataFrame) -> DataFrame:
    """The quick score is stateless and runs on a stream as it is."""
    return quick_score(docs)


def stream_scores(docs: DataFrame, score: Callable[[DataFrame], DataFrame], path: str,
                  checkpoint: str) -> DataStreamWriter:
    """Score every micro-batch with a batch job (for example ``score_documents``) and append the result."""
    def write(batch: DataFrame, epoch: int) -> None:
        # the epoch is part of the path, so a repeated epoch replaces its own output
        score(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def append_history(scored: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append scored submissions of a stream to the history table; a repeated epoch replaces its own rows."""
    return scored.writeStream.foreachBatch(
        lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")).option("checkpointLocation", checkpoint)


def run_to_end(stream: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over all that is there (``availableNow``) and return its rows as a table.

    Every micro-batch is written below the shared folder under its number, so a repeated one replaces its own rows. With
    ``keys`` (update mode) the last row of each key counts.
    """
    folder = f"{shared_folder(stream.sparkSession)}/streams-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", f"{folder}/state").foreachBatch(write).start().awaitTermination()
    rows = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(
        f"{folder}/rows")
    if not keys:
        return rows.drop("epoch")
    rest = [n for n in stream.columns if n not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_last")).select(*keys, "_last.*")
