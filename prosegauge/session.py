"""Session defaults and the one place that touches the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # methods above 8000 bytes are never compiled by the JIT: let wide projections be split instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.codegen.maxFields": "60",
}
# only a new session can take these
STATIC_DEFAULTS = {
    # no call-site capture per column expression: plans here have thousands of them
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults below; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName("prosegauge")
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **STATIC_DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """UTC timestamps; AQE is on by default and picks partition counts and broadcasts by size."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it, unless the cluster ships it (--py-files)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, from ``spark.checkpoint.dir``. Only a local-mode session that
    has none (tests) gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="prosegauge-ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job in reliable shared storage (``shared_folder``)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_checkpoint(df: DataFrame) -> None:
    """Remove the files of a ``checkpointed`` frame that nothing reads any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, in files by the columns ``by``. Unlike a checkpoint's rows its
    columns are read one by one, so that later steps read only those they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/prosegauge-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Remove a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
