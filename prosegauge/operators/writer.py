"""Writer-type classification (Q6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prosegauge.functions import text as tx
from prosegauge.functions.numeric import argmax_label, normalize_probs, r4, top_two
from prosegauge.lexicons import LEXICON, WRITER_TYPES


def writer_column(kind: str, writer: str) -> str:
    return f"{kind}_" + writer.lower().replace(" ", "_").replace("-", "_")


def _rule_hits(lowered: Column, toks: Column, terms: Sequence[str]) -> Column:
    phrases = [t for t in terms if " " in t]
    words = [t for t in terms if " " not in t]
    found = tx.keyword_hits(toks, words) if words else F.lit(0)
    return found + tx.hits(lowered, phrases) if phrases else found


def writer_type(docs: DataFrame, lex: Mapping[str, list[str]] = LEXICON, keep: Sequence[str] = ("doc_id",),
                text: str = "text") -> DataFrame:
    """Rule scores, probabilities, the type, and the gap of the two best.

    With columns ``writer_emb_<type>`` (an encoder's prototype similarities)
    the score is .65 rule + .35 embedding. Blank text is the last type.
    """
    base = docs.select("*", F.lower(text).alias("_lower"), tx.tokens(F.col(text)).alias("_toks"),
                       (~F.col(text).rlike(tx.NOT_WS)).alias("_blank"))
    scale = F.greatest(F.lit(2.0), 0.12 * F.greatest(F.lit(1), F.size("_toks")))
    ruled = base.withColumns({
        writer_column("rule", w): F.least(
            F.lit(1.0), _rule_hits(F.col("_lower"), F.col("_toks"), lex[f"writer:{w}"]) / scale)
        for w in WRITER_TYPES})

    def combined(w: str) -> Column:
        rule, emb = F.col(writer_column("rule", w)), writer_column("writer_emb", w)
        return 0.65 * rule + 0.35 * F.coalesce(F.col(emb), F.lit(0.0)) if emb in docs.columns else rule

    last = WRITER_TYPES[-1]
    probs = ruled.withColumns({
        writer_column("prob", w): F.when(F.col("_blank"), 1.0 if w == last else 0.0).otherwise(p)
        for w, p in zip(WRITER_TYPES, normalize_probs([combined(w) for w in WRITER_TYPES]))})
    cols = [F.col(writer_column("prob", w)) for w in WRITER_TYPES]
    return probs.select(
        *keep,
        argmax_label(list(zip(WRITER_TYPES, cols))).alias("writer_type"),
        top_two(cols)[2].alias("writer_gap"),
        *[r4(F.when(F.col("_blank"), 0.0).otherwise(F.col(writer_column("rule", w))))
          .alias(writer_column("rule", w)) for w in WRITER_TYPES],
        *[r4(c).alias(writer_column("prob", w)) for w, c in zip(WRITER_TYPES, cols)],
    )
