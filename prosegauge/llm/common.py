"""What the operators share: shared storage, reading, word spans and rolling hashes over byte buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
BLOCK = 2_000_000


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session that names none gets one of its own."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="prosegauge-shared-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` as a table in the shared folder, in files by the columns ``by``: later steps read it and survive lost
    executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/prosegauge-{uuid.uuid4().hex}/{name}"
    # the table replaces the shuffle files that it was made from
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove a ``saved`` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._table_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # workers import this package from where the driver has it, unless the cluster ships it (--py-files)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batch: pa.RecordBatch, column: str = "text", size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow batch whose texts come to about ``size`` bytes."""
    lengths = batch.column(column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset: lengths.offset + len(lengths) + 1]
    start = 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, stop
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each text starts (one more entry at the end). Null: empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: A pseudo-random 64-bit number for each byte.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
STEP = 0x2545F4914F6CDD1D


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes in a row; entry i covers data[i:i+k]."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mask = (1 << 64) - 1
    done, have, power, width = None, 0, BYTE_CODE[data], 1
    while True:  # binary powers of k: power covers `width` bytes, done covers `have`
        if k & width:
            if done is None:
                done, have = power, width
            else:
                m = min(len(power), len(done) - width)
                done = power[:m] * np.uint64(pow(STEP, have, 1 << 64) & mask) + done[width: width + m]
                have += width
        if width * 2 > k:
            return mix(done[:n])
        m = len(power) - width
        power = power[:m] * np.uint64(pow(STEP, width, 1 << 64) & mask) + power[width: width + m]
        width *= 2


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


def words_of(data: np.ndarray, starts: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word of the texts in ``data``. ``apart``: the bytes that are in no word, by
    default those outside ``[^\\x20\\x09-\\x0D]``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~apart[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = starts[:-1][starts[:-1] < starts[1:]]
    begins[first] = inside[first]
    begin = np.flatnonzero(begins)
    stops = np.zeros(len(data) + 1, bool)  # a stop at i: a word ends before i
    stops[1:-1] = inside[:-1] & ~inside[1:]
    stops[-1] = inside[-1]
    cut = first[first > 0]
    stops[cut] |= inside[cut - 1]
    end = np.flatnonzero(stops)
    return begin, end, np.searchsorted(starts, begin, "right") - 1


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[begin:end]; spans are in order, not empty and do not overlap."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    longest = int(length.max())
    powers = np.empty(longest, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(longest - 1, STEP, np.uint64), out=powers[1:]) if longest > 1 else None
    total = int(length.sum())
    within = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(length) - length, length)
    codes = BYTE_CODE[data[np.repeat(begin, length) + within]] * powers[within]
    return mix(np.add.reduceat(codes, np.cumsum(length) - length) ^ length.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
