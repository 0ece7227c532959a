"""Sinks (S7-S11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from prosegauge.functions.vectors import normalize

HISTORY_COLUMNS = ["user_id", "community_id", "text", "text_length", "model_version", "bqs_score", "eqs_score",
                   "confidence", "components", "request_timestamp", "response_time_ms"]


def write_fixed_csv(df: DataFrame, path: str, cols: Sequence[str], mode: str = "overwrite") -> None:
    """CSV with a header and a fixed column order; nested columns become JSON, absent ones stay empty."""
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}

    def field(c: str):
        if c not in df.columns:
            return F.lit(None).cast("string").alias(c)
        return F.to_json(c).alias(c) if c in nested else F.col(c)

    (df.select(*[field(c) for c in cols]).write.mode(mode).option("header", True).option("escape", '"').csv(path))


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report or manifest as JSON."""
    df.write.mode(mode).json(path)


def _complete(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def materialize(df: DataFrame, path: str, version: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write the derived table once per version and read it back; an unfinished write is redone."""
    spark, target = df.sparkSession, f"{path}/v{version}"
    if not _complete(spark, target):
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    return spark.read.parquet(target)


def write_embeddings(df: DataFrame, path: str, vec: str = "embedding", mode: str = "overwrite") -> None:
    """Vectors at unit length next to their labels."""
    unit_length = normalize(F.col(vec)).cast("array<float>")
    df.withColumn(vec, unit_length).write.mode(mode).parquet(path)


def history_rows(scored: DataFrame) -> DataFrame:
    ready = scored.withColumn("text_length", F.char_length(F.coalesce("text", F.lit(""))))
    return ready.select(*[F.col(c) for c in HISTORY_COLUMNS if c in ready.columns])


def append_scores(scored: DataFrame, path: str) -> None:
    """Append scored submissions to the history, split by month of the request."""
    rows = history_rows(scored)
    if "request_timestamp" in rows.columns:
        rows = rows.withColumn("month", F.date_format("request_timestamp", "yyyy-MM"))
        rows.write.mode("append").partitionBy("month").parquet(path)
    else:
        rows.write.mode("append").parquet(path)
