"""Final score by soft fusion of all signals (Q25)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from prosegauge.functions.numeric import argmax_label, clip, lookup, normalize_probs, r2, r4, top_two, total, unit
from prosegauge.lexicons import (
    ARCHETYPES, FUSION_BANDS, SENTIMENT_ANCHORS, STANCE_ANCHORS, STANCE_STRENGTH_BASE,
)
from prosegauge.operators.scoring import SCORE_MAX, SCORE_MIN, anchored, with_anchor_probs
from prosegauge.operators.stance import prob
from prosegauge.operators.writer import writer_column

c = F.col
SPAN = SCORE_MAX - SCORE_MIN


def to_range(share: Column) -> Column:
    return SCORE_MIN + SPAN * unit(share)


def fuse_scores(docs: DataFrame, archetypes: Mapping[str, tuple] = ARCHETYPES,
                bands: Mapping[str, tuple[float, float]] = FUSION_BANDS) -> DataFrame:
    """Add ``final_score`` and its parts to scored documents."""
    # archetype shares; the fifth writer type has no archetype and drops out
    shares = normalize_probs([c(writer_column("prob", w)) for w, _ in archetypes.values()])
    base = with_anchor_probs(docs, "_a_").withColumns({k: s for k, s in zip(archetypes, shares)})

    # soft stance with strength shaping
    constructive = c(prob("CONSTRUCTIVE_CRITICISM")) + 0.7 * c(prob("BALANCED_DEBATE"))
    attack, dismissive = c(prob("DIRECT_ATTACK")), c(prob("DISMISSIVE_COMPLAINT"))
    support = c("supportive_defense_strength")
    a = anchored({s: c("_a_" + s.lower()) for s in STANCE_ANCHORS})
    strength = unit(lookup(c("stance_label"), STANCE_STRENGTH_BASE, 0.55) + 0.14 * support + 0.08 * constructive
                    - 0.20 * attack - 0.12 * dismissive)
    sentiment = ["positive", "neutral", "negative"]
    known = [unit(c(f"mean_sentiment_{s}")) for s in sentiment]
    sad = unit(F.coalesce(c("mean_negativity"), F.lit(0.5)))
    derived = normalize_probs([unit(1.0 - sad), F.lit(0.0), sad], fallback="zero")
    has_sentiment = total(known) > 0
    base = base.withColumns({
        "_gap": a["gap"], "_soft": a["soft"], "_blend": a["blend"], "_strength": strength,
        "_mass": total([unit(c(prob(s))) for s in STANCE_ANCHORS]),
        **{f"_sent_{s}": F.when(has_sentiment, k).otherwise(d) for s, k, d in zip(
            sentiment, normalize_probs(known, fallback="zero"), derived)},
    })
    sent = [c(f"_sent_{s}") for s in sentiment]
    stance_score = clip(0.8 * c("_blend") + 0.2 * to_range(c("_strength")) + 20.0 * support + 10.0 * constructive
                        - 16.0 * attack - 12.0 * dismissive, SCORE_MIN, SCORE_MAX)
    quality = to_range((c("writing_quality_component") + 10.0) / 25.0)
    base = base.withColumns({
        "_stance": stance_score,
        "_sentiment": total([c(f"_sent_{s}") * SENTIMENT_ANCHORS[s] for s in sentiment]),
        "_sent_gap": top_two(sent)[2],
        "_quality": quality,
        "_accuracy": unit(c("stat_accuracy_score")),
        "toxicity_share": unit(F.abs(c("toxicity_penalty")) / 25.0),
        "originality_component": unit(0.5 * unit(c("lexical_diversity_score")) + 0.3 * unit(
            c("sentence_variety_score")) - 0.2 * unit(c("repetition_penalty"))),
    })
    parts = {
        "stance": (c("_stance") - SCORE_MIN) / SPAN,
        "stat_accuracy": c("_accuracy"),
        "writing_quality": (c("_quality") - SCORE_MIN) / SPAN,
        "argument_logic": unit(c("argument_logic_score")),
        "information_density": unit(c("information_density_score")),
        "toxicity": 1.0 - c("toxicity_share"),
        "engagement_style": unit(c("fan_sincerity") / 15.0),
        "structure": unit(c("completeness_score")),
        "coherence": unit(c("coherence_score")),
        "counter_argument": unit(c("counter_argument_score")),
    }
    fusion = total([c(k) * total([F.lit(w) * parts[p] for p, w in weights.items()])
                    for k, (_, weights) in archetypes.items()])
    core = (0.45 * c("_stance") + 0.25 * c("_sentiment") + 0.15 * c("_quality") + 0.10 * to_range(c("_accuracy"))
            + 0.05 * to_range(c("originality_component")))
    base = base.withColumns({
        "archetype_fusion": fusion, "_core": core,
        "confidence_gap_factor": F.least(c("_gap"), c("_sent_gap")),
    })
    unsure = c("confidence_gap_factor") < 0.10
    shape = (F.when(~c("stats_found"), 0.0).when(c("stats_verified"), 4.0)
             .when(c("stat_accuracy_score") >= 0.5, 2.0).otherwise(-6.0))
    base = base.withColumns({
        "confidence_factor": F.when(unsure, 0.98).otherwise(1.0),
        "core_component": F.when(unsure, 0.9 * c("_core") + 0.1 * 0.5 * (c("_soft") + c("_sentiment")))
        .otherwise(c("_core")),
    })
    base = base.withColumn("_raw", (0.80 * c("core_component") + 0.20 * to_range(c("archetype_fusion")))
                           * c("confidence_factor") + shape)
    tox = c("toxicity_share")
    attacking = (c("stance_label") == "DIRECT_ATTACK") | (c("attack_severity") >= 1)
    dismissing = (c("stance_label") == "DISMISSIVE_COMPLAINT") | c("dismissive_text")
    base = base.withColumns({
        "_raw": F.when(tox > 0.75, F.least(c("_raw"), F.lit(30.0)))
        .when(tox > 0.6, F.least(c("_raw"), F.lit(40.0))).otherwise(c("_raw")),
        "toxicity_adjustment": F.when(tox > 0.75, "cap_30").when(tox > 0.6, "cap_40").otherwise("none"),
        "ceiling": F.when(attacking, lookup(c("attack_severity"), {0: 40.0, 1: 30.0, 2: 25.0}, 20.0))
        .when(dismissing, F.when(c("ceiling_suggestion"), 50.0).otherwise(40.0)),
    })
    low = lookup(c("stance_label"), {k: b[0] for k, b in bands.items()}, SCORE_MIN)
    high = lookup(c("stance_label"), {k: b[1] for k, b in bands.items()}, SCORE_MAX)
    bounded = F.when(c("ceiling").isNotNull(), F.least(c("_raw"), c("ceiling"))).otherwise(
        F.greatest(low, F.least(high, c("_raw"))))
    warned = F.array_compact(F.array(
        F.when(c("_mass") <= 0, "missing_probability_vector")
        .when(F.abs(c("_mass") - 1.0) > 1e-6, "distribution_renormalized"),
        F.when(~has_sentiment, "sentiment_probability_fallback_from_mean_negativity")))
    out = base.withColumns({
        "final_score": r2(clip(bounded, SCORE_MIN, SCORE_MAX)),
        "archetype_detected": argmax_label([(k, c(k)) for k in archetypes]),
        "stance_strength": r4(c("_strength")),
        "fusion_warnings": warned,
        "ceiling_applied": c("ceiling").isNotNull(),
        **{n: r4(c(n)) for n in ("originality_component", "archetype_fusion", "confidence_gap_factor",
                                 "core_component", "toxicity_share")},
    })
    drop = ["_gap", "_soft", "_blend", "_strength", "_mass", "_stance", "_sentiment", "_sent_gap", "_quality",
            "_accuracy", "_core", "_raw", *[f"_sent_{s}" for s in sentiment],
            *["_a_" + s.lower() for s in STANCE_ANCHORS]]
    return out.drop(*drop)
