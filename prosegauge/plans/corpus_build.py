"""Corpus build: clean, score, estimate bands, split (the offline path without claims and fusion)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from prosegauge.functions import text as tx
from prosegauge.lexicons import LEXICON
from prosegauge.operators.clean import clean_texts
from prosegauge.operators.corpus import estimate_bands, stratified_split
from prosegauge.plans.score_documents import apply_rules, document_signals
from prosegauge.session import checkpointed


def build_corpus(raw: DataFrame, scores: DataFrame | None = None, lex: Mapping[str, list[str]] = LEXICON,
                 topic: Sequence[str] = LEXICON["topical"], ratio: float = 0.8, seed: int = 42,
                 sep: str = tx.PARAGRAPH_BREAK) -> DataFrame:
    """(doc_id, text) to labelled rows with expected bands and a train/test split."""
    cleaned = clean_texts(raw.select("doc_id", "text"), ["doc_id"], topic)
    scored = apply_rules(document_signals(cleaned, scores, lex, sep))
    banded = estimate_bands(scored.withColumn("final_score", F.col("rule_score")))
    # texts are scored once: the split reads its small input several times, and the text joins last
    labelled = checkpointed(banded.select(
        "doc_id", "stance_label", F.col("stance_confidence").alias("confidence"),
        "expected_score_band", "expected_toxicity_band", "expected_supportive_strength_band"))
    return stratified_split(labelled, "stance_label", "doc_id", ratio, seed).join(
        cleaned.select("doc_id", "text"), "doc_id")
