"""Writing-quality signals per paragraph and their roll-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prosegauge.functions import text as tx
from prosegauge.functions.numeric import clip, r4, total, unit
from prosegauge.functions.vectors import cosine
from prosegauge.lexicons import LEXICON
from prosegauge.operators.paragraphs import explode_paragraphs, with_split

# Weight of each signal in the quality index.
INDEX_WEIGHTS = {
    "coherence_score": 0.15, "lexical_diversity_score": 0.10, "sentence_variety_score": 0.10,
    "argument_logic_score": 0.15, "evidence_presence_score": 0.15, "counter_argument_score": 0.10,
    "completeness_score": 0.10, "information_density_score": 0.15, "repetition_penalty": -0.10,
}
SIGNALS = ["coherence_score", "lexical_diversity_score", "sentence_variety_score", "repetition_penalty",
           "position_clarity_score", "counter_argument_score", "evidence_presence_score", "completeness_score",
           "information_density_score", "argument_logic_score"]


def quality_component(cols: Mapping[str, Column]) -> Column:
    index = total([F.lit(w) * cols[s] for s, w in INDEX_WEIGHTS.items()])
    return clip(index * 22.0 - 7.0, -10.0, 15.0)


def quality_columns(text: Column, lowered: Column, toks: Column, sents: Column, sent_toks: Column,
                    coherence: Column, lex: Mapping[str, list[str]] = LEXICON) -> dict[str, Column]:
    """The ten signals over columns that are already split."""
    return {
        "coherence_score": coherence,
        "lexical_diversity_score": tx.lexical_diversity(toks),
        "sentence_variety_score": tx.sentence_variety(sents, sent_toks, lex["clause_words"]),
        "repetition_penalty": tx.repetition(toks),
        "position_clarity_score": tx.marker_score(lowered, lex["position"], 2.0),
        "counter_argument_score": tx.marker_score(lowered, lex["counter_argument"], 2.0),
        "evidence_presence_score": tx.evidence_score(text, lowered, lex["evidence"]),
        "completeness_score": tx.completeness(sents, lowered, lex["intro"], lex["argument"], lex["conclusion"]),
        "information_density_score": tx.content_ratio(toks, lex["stopwords"], lex["content_suffixes"]),
        "argument_logic_score": tx.marker_score(lowered, lex["argument_logic"], 3.0),
    }


def quality_paragraphs(paras: DataFrame, lex: Mapping[str, list[str]] = LEXICON,
                       keep: Sequence[str] = ("doc_id", "para_ix")) -> DataFrame:
    """Signals, component and weight of every paragraph. A ``coherence`` column replaces the neutral .5."""
    coherence = F.coalesce(F.col("coherence"), F.lit(0.5)) if "coherence" in paras.columns else F.lit(0.5)
    split = with_split(paras.withColumn("_coherence", coherence))
    signals = quality_columns(F.col("text"), F.col("_lower"), F.col("_toks"), F.col("_sents"), F.col("_stoks"),
                              F.col("_coherence"), lex)
    scored = split.select(*keep, F.greatest(F.lit(1), F.size("_toks")).alias("weight"),
                          *[c.alias(n) for n, c in signals.items()])
    return scored.withColumn("writing_quality_component",
                             r4(quality_component({s: F.col(s) for s in INDEX_WEIGHTS})))


def aggregate_quality(paras: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Token-weighted document means of the ten signals, and the component."""
    w = F.col("weight")
    means = paras.groupBy(*by).agg(
        *[r4(unit(F.sum(w * F.col(s)) / F.sum(w))).alias(s) for s in SIGNALS])
    return means.withColumn("writing_quality_component",
                            r4(quality_component({s: F.col(s) for s in INDEX_WEIGHTS})))


def writing_quality(docs: DataFrame, lex: Mapping[str, list[str]] = LEXICON,
                    sep: str = tx.PARAGRAPH_BREAK) -> DataFrame:
    return aggregate_quality(quality_paragraphs(explode_paragraphs(docs, sep), lex))


def coherence(sent_vecs: DataFrame, by: Sequence[str], pos: str = "pos", vec: str = "embedding") -> DataFrame:
    """Mean similarity of neighbouring sentences, mapped to 0-1.

    ``pos`` counts 1, 2, 3 ... inside ``by`` (as ``posexplode`` gives it), so
    neighbours meet in an equi-join on (by, pos): no window over a whole
    document, however long it is. One sentence scores .5.
    """
    here = sent_vecs.select(*by, F.col(pos).alias("_pos"), F.col(vec).alias("_a"))
    following = sent_vecs.select(*by, (F.col(pos) - 1).alias("_pos"), F.col(vec).alias("_b"))
    pairs = here.join(following, [*by, "_pos"], "left")
    similarity = unit((cosine(F.col("_a"), F.col("_b")) + 1.0) / 2.0)
    sim = F.when(F.col("_b").isNotNull(), similarity)
    if not by:
        return pairs.agg(unit(F.coalesce(F.avg(sim), F.lit(0.5))).alias("coherence"))
    return pairs.groupBy(*by).agg(unit(F.coalesce(F.avg(sim), F.lit(0.5))).alias("coherence"))
