"""Clean, filter, dedupe and union short-text corpora."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from prosegauge.functions import text as tx
from prosegauge.functions.numeric import any_of
from prosegauge.lexicons import LEXICON, TEXT_COLUMNS_WIDE
from prosegauge.operators.scale import first_rows

TOPIC_GROUPS = ["topical_player", "topical_selection", "topical_criticism", "topical_role", "topical_fairness",
                "topical_debate"]


def coalesce_text(df: DataFrame, cols: Sequence[str] = TEXT_COLUMNS_WIDE) -> Column:
    """First non-empty candidate column that the dataset has, else the empty text."""
    present = [F.when(F.col(c) != "", F.col(c)) for c in cols if c in df.columns]
    return F.coalesce(*present, F.lit(""))


def text_flags(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Every cleaning predicate as a column."""
    c = F.col(text)
    return docs.select(
        *keep,
        (tx.strip(c) == "").alias("is_empty"),
        tx.is_url_only(c).alias("is_url_only"),
        tx.is_hashtag_only(c).alias("is_hashtag_only"),
        tx.is_symbol_only(c).alias("is_symbol_only"),
        tx.is_emoji_only(tx.strip(c)).alias("is_emoji_only"),
        tx.is_repost(c).alias("is_repost"),
        tx.is_repost(c, True).alias("is_bare_repost"),
    )


def clean_texts(df: DataFrame, order: Sequence[str], topic: Sequence[str] = LEXICON["topical"],
                text: str = "text") -> DataFrame:
    """Trim, drop noise and off-topic rows, keep the first of each case-insensitive text."""
    c = F.col(text)
    lowered = F.lower(c)
    kept = df.withColumn(text, tx.strip(c)).filter(
        (c != "") & ~tx.is_url_only(c) & ~tx.is_hashtag_only(c) & ~tx.is_symbol_only(c) & ~tx.is_repost(c))
    if topic:
        kept = kept.filter(tx.contains_any(lowered, topic))
    return first_rows(kept, [lowered], [F.col(o) for o in order])


def collect_samples(df: DataFrame, order: Sequence[str], lex: dict[str, list[str]] = LEXICON,
                    groups: Sequence[str] = TOPIC_GROUPS, text: str = "text",
                    source: str = "twitter_like") -> DataFrame:
    """Second collection path: links are removed, reposts with a colon stay, topic groups are OR-ed."""
    c = F.col(text)
    lowered = F.lower(c)
    kept = df.withColumn(text, tx.normalize_text(c)).filter(
        (c != "") & ~tx.is_hashtag_run(c) & ~tx.is_emoji_only(c) & ~tx.is_repost(c, True))
    if groups:
        kept = kept.filter(any_of([tx.contains_any(lowered, lex[g]) for g in groups]))
    return first_rows(kept, [lowered], [F.col(o) for o in order]).withColumn("source", F.lit(source))


def dedupe_first(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    return first_rows(df, keys, order)


def union_corpora(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def strip_synthetic(df: DataFrame, order: Sequence[str], label: str = "expected_stance", text: str = "text",
                    synthetic: str = "synthetic_balance") -> DataFrame:
    """Drop generated rows, then keep the first row of each (label, text)."""
    real = df.filter(F.coalesce(F.col("source"), F.lit("")) != synthetic)
    return first_rows(real, [F.col(label), F.lower(tx.strip(F.col(text)))], [F.col(o) for o in order])


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-empty values of a column."""
    return df.select(col).filter((F.col(col).isNotNull()) & (F.col(col) != "")).distinct()


def reject_existing(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def find_existing(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new.join(existing.select(*keys).distinct(), list(keys), "left_semi")
