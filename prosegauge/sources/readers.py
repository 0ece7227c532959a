"""Sources (S1-S4, S6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from prosegauge.functions.text import strip
from prosegauge.lexicons import TEXT_COLUMNS

BALL_LOG = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(16)])
SAMPLES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("expected_stance", T.StringType()),
    T.StructField("expected_score_band", T.ArrayType(T.DoubleType())),
    T.StructField("expected_toxicity_band", T.ArrayType(T.DoubleType())),
    T.StructField("expected_supportive_strength_band", T.ArrayType(T.DoubleType())),
    T.StructField("label_confidence", T.DoubleType()),
    T.StructField("source", T.StringType()),
])


def read_ball_log(spark: SparkSession, path: str) -> DataFrame:
    """Ragged match logs, one file per match: short rows are padded, quoted commas kept.

    ``row_order`` follows the lines of a file.
    """
    raw = (spark.read.schema(BALL_LOG).option("mode", "PERMISSIVE").option("escape", '"')
           .option("enforceSchema", "true").csv(path))
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    return raw.select("*", name.alias("match_id"), F.monotonically_increasing_id().alias("row_order"))


def pick_text_column(columns: Sequence[str], candidates: Sequence[str] = TEXT_COLUMNS) -> str:
    """First candidate among the headers, ignoring case and quotes; else the first column."""
    by_name = {c.strip().strip('"').lower(): c for c in columns}
    return next((by_name[c] for c in candidates if c in by_name), columns[0])


def read_text_csv(spark: SparkSession, path: str, candidates: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    """The text column of a CSV with a header; a missing value is the empty text."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    column = pick_text_column(raw.columns, candidates)
    return raw.select(F.coalesce(F.col(f"`{column}`"), F.lit("")).alias("text"))


def read_samples(spark: SparkSession, path: str, schema: T.StructType = SAMPLES, label: str = "expected_stance",
                 json_lines: bool = False) -> DataFrame:
    """Labelled samples from JSON arrays (or splittable JSON lines); items without text or label are dropped."""
    raw = spark.read.option("multiLine", not json_lines).schema(schema).json(path)
    return raw.filter((F.coalesce("text", F.lit("")) != "") & (F.coalesce(label, F.lit("")) != ""))


def read_delimited_docs(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Documents of text files that are cut at ``sep``; blank ones are dropped."""
    raw = spark.read.option("lineSep", sep).text(path)
    return raw.select(strip(F.col("value")).alias("text")).filter("text != ''")


def read_table(spark: SparkSession, name: str, root: str | None = None, url: str | None = None,
               properties: Mapping[str, str] | None = None, partition_column: str | None = None,
               bounds: tuple[int, int] | None = None, partitions: int = 64) -> DataFrame:
    """A relational table over JDBC (read in ``partitions`` key ranges) or a parquet copy under ``root``."""
    if url is None:
        return spark.read.parquet(f"{root}/{name}")
    options = {"url": url, "dbtable": name, "fetchsize": "10000", **(properties or {})}
    if partition_column and bounds:
        options |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]),
                    "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options).load()

