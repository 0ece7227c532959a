"""Whole-document scoring (Q33).

Documents are split once. Document-level checks are computed next to the split
and travel with the paragraphs as fixed-width columns, so one hash aggregate
per document brings everything together: the only shuffle of the scoring part,
and texts are not in it. Claim verification joins by document id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from prosegauge.functions import text as tx
from prosegauge.functions.numeric import r4, unit
from prosegauge.functions.models import MODEL_COLUMNS
from prosegauge.lexicons import LEXICON, SARCASM_THRESHOLD, WRITER_TYPES
from prosegauge.operators import scoring
from prosegauge.operators.claims import finish_verdicts, stat_mentions, verdict_folds
from prosegauge.operators.fusion import fuse_scores
from prosegauge.operators.quality import INDEX_WEIGHTS, SIGNALS, quality_component, quality_paragraphs
from prosegauge.operators.paragraphs import SPLIT, with_split
from prosegauge.operators.signals import SIMILARITIES, paragraph_components, paragraph_means
from prosegauge.operators.stance import finish_stance, paragraph_stance, stance_folds
from prosegauge.operators.writer import writer_column, writer_type

CHECKS = ["rescue_reasoning_hits", "rescue_suggestion_hits", "rescue_complaint", "cap_complaint",
          "cap_reasoning_hits", "cap_suggestion_hits", "attack_severity", "dismissive_text", "ceiling_suggestion"]
REPORT = [
    "doc_id", "n_paragraphs", "stance_label", "stance_confidence", "primary_stance_label",
    "primary_stance_confidence", "style_tags", "sarcasm_gate_reason", "writer_type", "constructiveness",
    "respectfulness", "analytical_tone", "clarity", "fan_sincerity", "toxicity_penalty",
    "sarcasm_credibility_penalty", "stance_blend_adjustment", "writing_quality_component", "stats_found",
    "stats_verified", "stat_accuracy_score", "rescue_reason", "rule_score", "adjusted_score", "calibrated_score",
    "calibration_reason", "archetype_detected", "ceiling", "final_score",
]


def _model_columns(df: DataFrame) -> list[str]:
    return [n for n in df.columns if n in MODEL_COLUMNS or n in SIMILARITIES or n == "coherence"
            or n.startswith(("emb_", "bench_", "sem_"))]


def document_signals(docs: DataFrame, scores: DataFrame | None = None, lex: Mapping[str, list[str]] = LEXICON,
                     sep: str = tx.PARAGRAPH_BREAK, threshold: float = SARCASM_THRESHOLD) -> DataFrame:
    """One row per document with stance, components, quality, writer type and lexical checks."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       *[n for n in docs.columns if n.startswith("writer_emb_")])
    writers = writer_type(base, lex, keep=["doc_id", "text"])
    probs = [writer_column("prob", w) for w in WRITER_TYPES]
    split = writers.select(
        "doc_id", "text", *probs,
        F.array_position(F.array(*[F.lit(w) for w in WRITER_TYPES]), F.col("writer_type")).alias("writer_ix"),
        tx.paragraphs(F.col("text"), sep).alias("_paras"))
    lowered = split.withColumns({"_low": F.lower("text"), "_blob": F.lower(F.array_join("_paras", " "))})
    checks = scoring.text_check_columns(F.col("_blob"), F.col("_low"), lex)
    checked = lowered.select("doc_id", "writer_ix", *probs, *[e.alias(n) for n, e in checks.items()], "_paras")
    carried = ["doc_id", "writer_ix", *probs, *CHECKS]
    parts = checked.select(*carried, F.posexplode_outer("_paras").alias("_pos", "_text"))
    paras = parts.select(*carried, (F.coalesce("_pos", F.lit(0)) + 1).alias("para_ix"),
                         F.col("_pos").isNull().alias("_empty"), F.coalesce("_text", F.lit("")).alias("text"))
    if scores is not None:
        paras = paras.join(scores, ["doc_id", "para_ix"], "left")
    extra = _model_columns(paras)
    keep = [*carried, "para_ix", "_empty"]
    paras = with_split(paras)

    # each layer keeps what the next one needs, so a paragraph is processed in one pass
    st = paragraph_stance(paras, lex, threshold, keep=[*keep, "text", *SPLIT, *[e for e in extra if e[:4] not in (
        "emb_", "benc", "sem_")]])
    stance_cols = [n for n in st.columns if n not in keep and n not in ("text", *SPLIT) and n not in extra]
    st = st.withColumnsRenamed({"weight": "stance_weight"})
    stance_cols = ["stance_weight" if n == "weight" else n for n in stance_cols]
    qu = quality_paragraphs(st, lex, keep=[*keep, "text", *SPLIT, *stance_cols, *extra_kept(extra)])
    quality_cols = {"weight": "quality_weight", "writing_quality_component": "_component"}
    qu = qu.withColumnsRenamed(quality_cols)
    pc = paragraph_components(qu, lex, keep=[*keep, *stance_cols, "quality_weight", *SIGNALS])

    w = F.col("quality_weight")
    live = ~F.col("_empty")
    folds = [
        *[F.max(n).alias(n) for n in carried[1:]],
        F.count_if(live).alias("n_text_paragraphs"),
        *[r4(unit(F.coalesce(F.sum(F.when(live, w * F.col(s))) / F.sum(F.when(live, w)), F.lit(0.0)))).alias(s)
          for s in SIGNALS],
        *paragraph_means(),
        *stance_folds(),
    ]
    renamed = pc.withColumnRenamed("stance_weight", "weight")
    # a document without text has no paragraph to average: all its means are 0
    numeric = [n for n in ("constructiveness", "respectfulness", "analytical_tone", "clarity", "fan_sincerity",
                           "constructive_signal", "respect_signal", "constructiveness_score", "sentence_count")]
    renamed = renamed.withColumns({n: F.when(live, F.col(n)).otherwise(0) for n in numeric})
    folded = renamed.groupBy("doc_id").agg(*folds)
    named = finish_stance(folded)
    writer = F.get(F.array(*[F.lit(x) for x in WRITER_TYPES]), (F.col("writer_ix") - 1).cast("int"))
    return named.withColumns({
        "writer_type": writer,
        "quality_component": quality_component({s: F.col(s) for s in INDEX_WEIGHTS}),
    }).drop("writer_ix")


def extra_kept(extra: Sequence[str]) -> list[str]:
    return [e for e in extra if e in MODEL_COLUMNS or e in SIMILARITIES]


def apply_rules(signals: DataFrame) -> DataFrame:
    """The scoring chain up to ``rule_score``; column arithmetic only."""
    steps = [scoring.stance_blend, scoring.stance_weighting, scoring.adaptive_components, scoring.toxicity_penalty,
             scoring.floor_uplift, scoring.rescue, scoring.complaint_and_abuse_caps, scoring.sarcasm_penalty]
    for step in steps:
        signals = step(signals)
    return signals


def with_verdicts(scored: DataFrame, docs: DataFrame, facts: DataFrame | None) -> DataFrame:
    """Claim verification per document; without a fact table nothing is found."""
    if facts is None:
        return scored.withColumns({
            "stats_found": F.lit(False), "stats_verified": F.lit(False), "stat_accuracy_score": F.lit(0.0),
            "stat_confidence": F.lit("low"), "stat_score_adjustment": F.lit(0.0)})
    folded = stat_mentions(docs, facts).groupBy("doc_id").agg(*verdict_folds())
    return finish_verdicts(scored, folded, "doc_id", F.col("writer_type"))


def score_documents(docs: DataFrame, facts: DataFrame | None = None, scores: DataFrame | None = None,
                    lex: Mapping[str, list[str]] = LEXICON, sep: str = tx.PARAGRAPH_BREAK,
                    threshold: float = SARCASM_THRESHOLD, full: bool = False) -> DataFrame:
    """Score (doc_id, text). ``facts``: player-match table; ``scores``: model columns per paragraph."""
    signals = document_signals(docs, scores, lex, sep, threshold)
    ruled = apply_rules(signals)
    checked = with_verdicts(ruled, docs, facts)
    fused = fuse_scores(scoring.calibrate(scoring.fold_adjustments(checked)))
    return fused if full else fused.select(*REPORT)
