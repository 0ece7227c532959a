"""Pipeline over documents: classify, join near copies, redact, mix, encode and decode."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import bpe, jaccard, mixing, pii, quality
from prosegauge.llm.common import saved, table


def _apart(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, and all other columns in one, so that no operator meets a name it uses itself."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias("_others")] if others else []))


def _whole(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*[F.col(c if c in ("doc_id", "text") else f"_others.{c}") for c in columns])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, does not reject. Repeated rows, and rows without id or
    text, are scored like any other; other columns stay as they are, whatever their names."""
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _whole(quality.score_quality(_apart(docs), model).where(F.col("score") >= quality.THRESHOLD), docs.columns)


def join_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near copies.

    Rows are known by a hash of id and text, so unlike texts of one id are documents of their own, and rows that agree in
    both are one. Rows without id take part and go before no other. Rows without words are in no group; of equal ones
    with the same id one stays. Other columns go with their row.
    """
    keyed = docs.withColumn("_row", F.xxhash64(F.to_json(F.struct("doc_id", "text"), {"ignoreNullFields": "false"})))
    rows = keyed.groupBy("_row").agg(F.first("doc_id").alias("_id"), F.count("*").alias("_times"))
    groups = jaccard.similar_documents(keyed.select(F.col("_row").alias("doc_id"), "text"))
    named = groups.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).distinct().join(rows, "_row")
    named = saved(named, "groups")
    kept = named.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_kept"))
    gone = named.join(kept, "_group").where("_row != _kept._row").select("_row")
    single = keyed.join(gone, "_row", "left_anti")
    # rows that are there more often: few, and only these are dealt by their hash
    twice = named.where("_times > 1").select("_row")
    folded = single.join(twice, "_row", "left_semi").dropDuplicates(["_row"])
    return single.join(twice, "_row", "left_anti").unionByName(folded).select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind, and n_chars, if there is such a column,
    counted anew. Null and empty texts stay; other columns stay as they are, whatever their names."""
    clean = _whole(pii.redact(_apart(docs), pii.fit(docs.select("doc_id", "text"))), docs.columns)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs, F.array("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and hash of each text's token ids, and the hash of what they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", join_copies),
    ("PII", hide_personal_data),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: The classifier and the joins have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, name.replace(" ", "-"))
    return docs
