"""Documents to paragraph and sentence tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from prosegauge.functions import text as tx


def explode_paragraphs(docs: DataFrame, sep: str = tx.PARAGRAPH_BREAK, keep: Sequence[str] = ("doc_id",),
                       text: str = "text", outer: bool = False) -> DataFrame:
    """One row per paragraph with 1-based ``para_ix``. ``outer`` keeps empty documents (text NULL)."""
    explode = F.posexplode_outer if outer else F.posexplode
    parts = docs.select(*keep, explode(tx.paragraphs(F.col(text), sep)).alias("_pos", "text"))
    return parts.select(*keep, (F.col("_pos") + 1).alias("para_ix"), "text")


def with_split(texts: DataFrame) -> DataFrame:
    """Add what the signals share: lower-cased text, sentences, tokens per sentence, all tokens.

    A frame that has been split already is returned as it is, so operators can
    be chained without splitting a text twice.
    """
    if "_lower" in texts.columns:
        return texts
    first = texts.withColumns({"_lower": F.lower("text"), "_sents": tx.sentences(F.col("text"))})
    # sentences break at white space only, so no token crosses a break
    second = first.withColumn("_stoks", F.transform("_sents", tx.tokens))
    return second.withColumn("_toks", F.flatten("_stoks"))


SPLIT = ["_lower", "_sents", "_stoks", "_toks"]


def explode_sentences(paras: DataFrame, keep: Sequence[str] = ("doc_id", "para_ix")) -> DataFrame:
    parts = paras.select(*keep, F.posexplode(tx.sentences(F.col("text"))).alias("_pos", "sentence"))
    return parts.select(*keep, (F.col("_pos") + 1).alias("sent_ix"), "sentence")


def text_counts(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Words, distinct words, sentences and paragraphs-by-line of each text."""
    split = docs.select(*keep, F.col(text).alias("text"), tx.tokens(F.col(text)).alias("toks"))
    return split.select(
        *keep,
        F.size("toks").alias("n_tokens"),
        F.size(F.array_distinct("toks")).alias("n_distinct"),
        tx.space_word_count(F.col("text")).alias("n_space_words"),
        tx.sentence_count(F.col("text")).alias("n_sentences"),
    )


def ngram_counts(docs: DataFrame, n: int, text: str = "text", top: int | None = None) -> DataFrame:
    """Corpus-wide n-gram counts; partial aggregation happens before the shuffle."""
    grams = docs.select(F.explode(tx.ngrams(tx.tokens(F.col(text)), n)).alias("ngram"))
    counted = grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))
    return counted if top is None else counted.orderBy(F.desc("n"), "ngram").limit(top)
