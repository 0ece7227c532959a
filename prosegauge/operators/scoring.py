"""From document means to a calibrated score (Q15-Q24).

Each step takes and returns one row per document with the five component
columns, ``toxicity_penalty`` and ``total``. A re-sum always starts from the
components again, so the order of the steps matters.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from prosegauge.functions import text as tx
from prosegauge.functions.numeric import argmax_label, clip, lookup, normalize_probs, r2, top_two, total, unit
from prosegauge.lexicons import (
    CALIBRATION_BANDS, COMPONENT_MAX, FLOOR_QUALITY_WEIGHTS, LEXICON, STANCE_ANCHORS, UPLIFT_WEIGHTS,
    WRITER_FLOORS, WRITER_PROFILES, WRITER_TYPES,
)
from prosegauge.operators.stance import prob
from prosegauge.operators.writer import writer_column

Lex = Mapping[str, list[str]]
COMPONENTS = list(COMPONENT_MAX)
SCORE_MIN, SCORE_MAX = 20.0, 95.0
c = F.col


def _is(label: str) -> Column:
    return c("stance_label") == label


def _writer(*names: str) -> Column:
    return c("writer_type").isin(*names)


def component_sum() -> Column:
    return total([c(k) for k in COMPONENTS]) + c("toxicity_penalty")


def text_check_columns(blob: Column, text: Column, lex: Lex = LEXICON) -> dict[str, Column]:
    """Lexical checks of the later steps. ``blob``: paragraphs joined by spaces; both lower-cased."""

    def flag(name: str) -> Column:
        return tx.contains_any(text, lex[name])

    return {
        "rescue_reasoning_hits": tx.hits(blob, lex["rescue_reasoning"]),
        "rescue_suggestion_hits": tx.hits(blob, lex["rescue_suggestion"]),
        "rescue_complaint": tx.contains_any(blob, lex["rescue_complaint"]),
        "cap_complaint": tx.contains_any(blob, lex["cap_complaint"]),
        "cap_reasoning_hits": tx.hits(blob, lex["cap_reasoning"]),
        "cap_suggestion_hits": tx.hits(blob, lex["cap_suggestion"]),
        "attack_severity": total([flag(n).cast("int") for n in ("insults", "humiliation", "group_dismissal")]),
        "dismissive_text": flag("dismissive"),
        "ceiling_suggestion": flag("ceiling_suggestion"),
    }


# --- Q15, Q16, Q17 -----------------------------------------------------------------

def anchored(probs: Mapping[str, Column]) -> dict[str, Column]:
    """Dominant, soft and blended anchor of a stance distribution over the anchored classes."""
    cols = list(probs.values())
    gap = top_two(cols)[2]
    dominant = argmax_label([(STANCE_ANCHORS[s], p) for s, p in probs.items()])
    soft = total([p * STANCE_ANCHORS[s] for s, p in probs.items()])
    blend = F.when(gap >= 0.15, 0.65 * dominant + 0.35 * soft).otherwise(0.45 * dominant + 0.55 * soft)
    return {"gap": gap, "dominant": dominant, "soft": soft, "blend": blend}


def with_anchor_probs(docs: DataFrame, prefix: str = "anchor_") -> DataFrame:
    shares = normalize_probs([unit(c(prob(s))) for s in STANCE_ANCHORS], fallback="zero")
    return docs.withColumns({prefix + s.lower(): p for s, p in zip(STANCE_ANCHORS, shares)})


def stance_blend(docs: DataFrame) -> DataFrame:
    shared = with_anchor_probs(docs)
    a = anchored({s: c("anchor_" + s.lower()) for s in STANCE_ANCHORS})
    named = shared.withColumns({
        "stance_gap": a["gap"], "dominant_stance_component": a["dominant"], "soft_stance_component": a["soft"],
        "_blend": a["blend"],
        "hard_override": c("stance_label").isin("DIRECT_ATTACK", "DISMISSIVE_COMPLAINT"),
    })
    return named.withColumn("final_stance_component", clip(F.when(
        c("hard_override"), c("dominant_stance_component")).otherwise(c("_blend")), SCORE_MIN, SCORE_MAX)).drop(
        "_blend", *["anchor_" + s.lower() for s in STANCE_ANCHORS])


def stance_weighting(docs: DataFrame) -> DataFrame:
    """Nudge mean components by stance."""
    def capped(k: str, e: Column) -> Column:
        return clip(e, 0.0, COMPONENT_MAX[k])

    kind = _is("SUPPORTIVE_DEFENSE") & (c("mean_respect") > 0.7)
    hostile = _is("DIRECT_ATTACK") & ~c("attack_rejection_detected")
    con, ana = c("constructiveness"), c("analytical_tone")
    return docs.withColumns({
        "constructiveness": F.when(kind, capped("constructiveness", con + 0.25))
        .when(_is("CONSTRUCTIVE_CRITICISM"), capped("constructiveness", con + 0.30))
        .when(_is("BALANCED_DEBATE"), capped("constructiveness", con + 2.0))
        .when(_is("DISMISSIVE_COMPLAINT"), capped("constructiveness", con * 0.82))
        .when(hostile, capped("constructiveness", con * 0.7)).otherwise(con),
        "analytical_tone": F.when(_is("CONSTRUCTIVE_CRITICISM"), capped("analytical_tone", ana + 0.20))
        .when(_is("BALANCED_DEBATE"), capped("analytical_tone", ana + 1.5)).otherwise(ana),
        "respectfulness": F.when(hostile, capped("respectfulness", c("respectfulness") * 0.65))
        .otherwise(c("respectfulness")),
        "fan_sincerity": F.when(kind, capped("fan_sincerity", c("fan_sincerity") + 0.35))
        .otherwise(c("fan_sincerity")),
    })


def _profile(field: str) -> Column:
    return lookup(c("writer_type"), {w: p[field] for w, p in WRITER_PROFILES.items()},
                  WRITER_PROFILES["All-Rounder"][field])


def adaptive_components(docs: DataFrame) -> DataFrame:
    """Multiply components by the writer profile; constructiveness grows with type confidence."""
    confidence = F.coalesce(lookup(c("writer_type"), {w: i for i, w in enumerate(WRITER_TYPES)}), F.lit(-1))
    conf = F.coalesce(F.get(F.array(*[c(writer_column("prob", w)) for w in WRITER_TYPES]), confidence), F.lit(0.0))
    con = c("constructiveness")
    scaled = {k: r2(clip(c(k) * _profile(k), 0.0, COMPONENT_MAX[k])) for k in COMPONENTS[1:]}
    return docs.withColumns({
        "constructiveness": r2(F.greatest(con, F.least(F.lit(40.0), con * (1.0 + 0.08 * conf)))), **scaled})


# --- Q18, Q19 -----------------------------------------------------------------------

def toxicity_penalty(docs: DataFrame) -> DataFrame:
    raw = unit(0.2 * c("toxicity_mean") + 0.2 * c("toxicity_max") + 0.15 * c("toxicity_ratio")
               + 0.45 * c("abuse_mean"))
    base = docs.withColumn("_raw", raw)
    attack_p, complaint_p = c(prob("DIRECT_ATTACK")), c(prob("DISMISSIVE_COMPLAINT"))
    fair = (_is("SUPPORTIVE_DEFENSE") & (c("supportive_defense_strength") >= 0.4) & (c("mean_respect") >= 0.7)
            & (c("_raw") < 0.25) & (attack_p <= 0.25) & (complaint_p <= 0.35))
    intent = (_is("SUPPORTIVE_DEFENSE") & (c("causal_defense_score") >= 0.35)
              & ~c("attack_endorsement_detected"))
    base = base.withColumns({"_fair": fair, "_intent": intent})

    def damp(cond: Column) -> Column:
        return F.when(cond, 0.2).otherwise(1.0)

    intensity = c("_raw") * damp(c("attack_rejection_detected")) * damp(c("_fair")) * damp(c("_intent"))
    strength = _profile("toxicity_strength") * clip(0.65 + 0.7 * c("abuse_mean"), 0.65, 1.35)
    floor = (F.when(c("_intent"), -1.0).when(c("attack_rejection_detected") | c("_fair"), -5.0).otherwise(-25.0))
    penalty = r2(F.greatest(floor, -25.0 * unit(F.pow(intensity, F.lit(1.22)) * strength)))
    scored = base.withColumn("toxicity_penalty", penalty).drop("_raw", "_fair", "_intent")
    return scored.withColumns({
        "stance_blend_adjustment": F.when(
            ~c("hard_override") & (c("toxicity_penalty") >= 0.0),
            0.85 * (c("final_stance_component") - c("dominant_stance_component"))).otherwise(0.0),
        "total": component_sum(),
    })


def floor_uplift(docs: DataFrame) -> DataFrame:
    """Lift coherent, respectful writing of low toxicity to the floor of its writer type."""
    def quality(weights: Mapping[str, float]) -> Column:
        return total([w * (c(k) / COMPONENT_MAX[k]) for k, w in weights.items()])

    q = F.when(_writer("Analyst"), quality(FLOOR_QUALITY_WEIGHTS["Analyst"]))
    for w in ("Storyteller", "Debater"):
        q = q.when(_writer(w), quality(FLOOR_QUALITY_WEIGHTS[w]))
    gate = (_is("SUPPORTIVE_DEFENSE") & c("attack_rejection_detected")
            & (c("supportive_defense_strength") >= 0.45) & (c("fairness_defense_score") >= 0.5)
            & (c("mean_respect") >= 0.75) & (c("abuse_mean") < 0.2) & (c("toxicity_mean") < 0.2)
            & (c(prob("DIRECT_ATTACK")) <= 0.2) & (c(prob("DISMISSIVE_COMPLAINT")) <= 0.3))
    base = docs.withColumns({"_q": q.otherwise(quality(FLOOR_QUALITY_WEIGHTS["other"])), "_gate": gate})
    pattern = c("constructive_pattern_ratio")
    ana, res, cla, fan = c("analytical_tone"), c("respectfulness"), c("clarity"), c("fan_sincerity")
    trigger = ((pattern >= 0.35) | (_writer("Analyst") & (ana >= 7.0))
               | (_writer("Debater") & (ana >= 6.5) & (res >= 13.0))
               | (_writer("Storyteller") & (cla >= 7.0) & (fan >= 7.0))
               | (_writer("Passionate Fan") & (fan >= 8.0) & (res >= 14.0)) | c("_gate"))
    patterned = (c("abuse_mean") < 0.08) & (pattern >= 0.2)
    extended = (trigger | (_writer("Analyst", "Debater") & patterned & (c("_q") >= 0.34))
                | (_writer("Storyteller") & patterned & (c("_q") >= 0.36) & (cla >= 6.0)))
    own = lookup(c("writer_type"), WRITER_FLOORS, 60.0)
    base = base.withColumn("_floor", F.when(c("_gate"), F.greatest(own, F.lit(72.0))).otherwise(own))
    base = base.withColumn("_lift", F.when(
        ((c("abuse_mean") < 0.12) | c("_gate")) & extended & (c("total") < c("_floor")), c("_floor") - c("total")))

    def share(k: str) -> Column:
        return lookup(c("writer_type"), {w: t.get(k, 0.0) for w, t in UPLIFT_WEIGHTS.items()},
                      UPLIFT_WEIGHTS["All-Rounder"][k])

    lifted = base.withColumns({k: F.when(c("_lift").isNotNull() & (share(k) > 0), r2(
        clip(c(k) + c("_lift") * share(k), 0.0, COMPONENT_MAX[k]))).otherwise(c(k)) for k in COMPONENTS})
    # what caps kept back goes to the components in order, as far as each has room
    rest = lifted.withColumn("_rest", F.when(
        c("_lift").isNotNull(), F.greatest(F.lit(0.0), c("_floor") - component_sum())).otherwise(0.0))
    used = F.lit(0.0)
    adds: dict[str, Column] = {}
    for k in COMPONENTS:
        room = F.greatest(F.lit(0.0), COMPONENT_MAX[k] - c(k))
        adds[k] = F.least(room, F.greatest(F.lit(0.0), c("_rest") - used))
        used = used + room
    filled = rest.withColumns({k: F.when(adds[k] > 0, r2(c(k) + adds[k])).otherwise(c(k)) for k in COMPONENTS})
    return filled.withColumn("total", F.when(c("_lift").isNotNull(), component_sum()).otherwise(c("total"))).drop(
        "_q", "_gate", "_floor", "_lift", "_rest")


# --- Q20 -----------------------------------------------------------------------------

def rescue(docs: DataFrame) -> DataFrame:
    """Rule-based rescue of reasoned, respectful writing that scored too low."""
    calm = (c("toxicity_mean") < 0.18) & (c("abuse_mean") < 0.08)
    civil = c("mean_respect") >= 0.65
    reasons = ((c("mean_reasoning") >= 0.08) | (c("rescue_reasoning_hits") >= 1) | (c("mean_discourse") >= 0.35)
               | (c("analytical_tone") >= 6.5))
    deep = ((c("mean_suggestion") >= 0.12) | (c("mean_depth") >= 0.2) | (c("mean_discourse") >= 0.4)
            | (c("rescue_suggestion_hits") >= 2))
    long_form = (c("mean_word_count") >= 70.0) & (c("mean_sentence_count") >= 4.0)
    complaint = (c("rescue_complaint") & (c("mean_suggestion") < 0.12) & (c("rescue_suggestion_hits") <= 1)
                 & (c("mean_reasoning") < 0.3) & (c("rescue_reasoning_hits") <= 2) & (c("mean_discourse") < 0.25))
    gates = docs.withColumns({
        "_strategic": _writer("Analyst") & calm & civil & (c("mean_strategic") >= 0.2),
        "_simple": calm & (c("toxicity_mean") < 0.05) & (c("mean_respect") > 0.7)
        & ((c("mean_reasoning") >= 0.4) | (c("mean_depth") >= 0.4)),
        "_long": calm & civil & reasons & deep & long_form,
        "_complaint": complaint,
    })
    eligible = _writer("Analyst", "Debater", "Storyteller", "All-Rounder")
    passed = c("_strategic") | c("_simple") | c("_long")
    state = gates.withColumn("rescue_activated", eligible & passed & ~c("_complaint"))
    active = c("rescue_activated")
    fair = (active & _is("SUPPORTIVE_DEFENSE") & (c("supportive_defense_strength") >= 0.4)
            & (c("mean_depth") >= 0.3) & (c("mean_respect") >= 0.7))
    boost = (active & ((c("mean_reasoning") >= 0.2) | (c("rescue_reasoning_hits") >= 4)) & (c("mean_depth") >= 0.25)
             & (c("constructive_pattern_ratio") >= 0.15) & (c("mean_respect") >= 0.72)
             & (c("toxicity_mean") < 0.12))
    state = state.withColumns({
        "_fair": fair,
        "analytical_boost_applied": boost,
        "rescue_reason": F.when(~eligible, "writer_not_eligible").when(~passed, "signal_gate_failed")
        .when(c("_complaint"), "complaint_like_blocked").when(fair, "fairness_defense_detected")
        .when(c("_simple"), "simple_reasoning_detected").otherwise("constructive_rescue"),
    })

    def add(k: str, by: float) -> Column:
        return r2(clip(c(k) + by, 0.0, COMPONENT_MAX[k]))

    def step(df: DataFrame, cond: Column, con: float, ana: float) -> DataFrame:
        moved = df.withColumns({
            "constructiveness": F.when(cond, add("constructiveness", con)).otherwise(c("constructiveness")),
            "analytical_tone": F.when(cond, add("analytical_tone", ana)).otherwise(c("analytical_tone")),
        })
        return moved.withColumn("total", F.when(cond, component_sum()).otherwise(c("total")))

    state = step(state, active & c("_simple"), 0.25, 0.35)
    state = step(state, c("_fair"), 0.2, 0.15)
    state = state.withColumns({
        "constructiveness": F.when(c("analytical_boost_applied"), add("constructiveness", 2.0))
        .otherwise(c("constructiveness")),
        "total": F.when(c("analytical_boost_applied"), c("total") + 2.0).otherwise(c("total")),
    })
    short = active & (c("constructiveness") < 24.0)
    state = state.withColumns({
        "total": F.when(short, c("total") + 24.0 - c("constructiveness")).otherwise(c("total")),
        "constructiveness": F.when(short, 24.0).otherwise(c("constructiveness")),
    })
    floor = F.when(c("_strategic"), 80.0).when(_writer("Analyst", "Debater"), 73.0).otherwise(68.0)
    state = state.withColumn("rescued_outlier", active & (c("total") < floor))
    state = state.withColumn("total", F.when(c("rescued_outlier"), floor).otherwise(c("total")))
    return state.withColumn("confidence_adjustment", F.when(active, 0.08).otherwise(0.0)).drop(
        "_strategic", "_simple", "_long", "_complaint", "_fair")


# --- Q21, Q22 ------------------------------------------------------------------------

def complaint_and_abuse_caps(docs: DataFrame) -> DataFrame:
    deep = _writer("Analyst") & (c("mean_depth") >= 0.4) & (c("mean_respect") >= 0.7)
    base = docs.withColumn("constructiveness", F.when(
        deep, F.greatest(c("constructiveness"), F.lit(24.0))).otherwise(c("constructiveness")))
    base = base.withColumn("total", F.when(deep, component_sum()).otherwise(c("total")))

    mild, complains = c("abuse_mean") < 0.12, c("cap_complaint")
    vague = c("mean_suggestion") < 0.1
    dull = c("fan_sincerity") < 6.0
    cap58 = (mild & complains & (c("mean_reasoning") < 0.1) & (c("cap_reasoning_hits") <= 1) & vague
             & ((c("mean_depth") < 0.18) | (c("cap_suggestion_hits") == 0)) & (c("mean_discourse") < 0.2)
             & (c("constructiveness") < 18.0) & dull)
    cap60 = (mild & complains & vague & (c("analytical_tone") < 4.5) & dull & (c("cap_reasoning_hits") <= 2))
    base = base.withColumn("total", F.when(cap58, F.least(c("total"), F.lit(58.0))).otherwise(c("total")))
    base = base.withColumn("total", F.when(cap60, F.least(c("total"), F.lit(60.0))).otherwise(c("total")))
    empty = (complains & (c("mean_reasoning") < 0.1) & vague & (c("mean_depth") < 0.2)
             & (c("mean_discourse") < 0.2) & mild)
    base = base.withColumn("constructiveness", F.when(
        empty, r2(c("constructiveness") * 0.78)).otherwise(c("constructiveness")))
    # this re-sum undoes the two caps above
    base = base.withColumn("total", F.when(empty, component_sum()).otherwise(c("total")))

    abusive = (c("abuse_mean") >= 0.2) & ~c("attack_rejection_detected")
    worst = F.when(c("abuse_mean") >= 0.35, -25.0).otherwise(-20.0)
    base = base.withColumn("toxicity_penalty", F.when(
        abusive, F.least(c("toxicity_penalty"), worst)).otherwise(c("toxicity_penalty")))
    return base.withColumn("total", F.when(abusive, F.least(F.lit(35.0), component_sum())).otherwise(c("total")))


def sarcasm_penalty(docs: DataFrame) -> DataFrame:
    """Blend adjustment, credibility penalty (0-42), final clip and the mid-strength support bonus."""
    adjusted = docs.withColumn("total", F.when(
        c("stance_blend_adjustment") != 0.0, clip(c("total") + c("stance_blend_adjustment"), SCORE_MIN, SCORE_MAX))
        .otherwise(c("total")))
    mocking = c("primary_stance_label") == "SARCASTIC_ATTACK"
    like = mocking | c("stance_label").isin("SARCASTIC_CRITICISM", "DIRECT_ATTACK", "DISMISSIVE_COMPLAINT")
    spared = _is("SUPPORTIVE_DEFENSE") | (c("primary_stance_label") == "SUPPORTIVE_DEFENSE")
    base = (12.0 * c("sarcasm_score") + 9.0 * c("ridicule_score") + 7.0 * c("contradiction_score")
            + 7.0 * c("context_mismatch_score") + 4.0 * c("exaggeration_score") - 4.0 * c("neutrality_score")
            + F.when((c("sarcasm_score") >= 0.5) & (c("ridicule_score") >= 0.5), 8.0).otherwise(0.0)
            + F.when(c("sarcasm_gate_reason").startswith("sarcasm_threshold_met") & mocking, 6.0).otherwise(0.0))
    penalty = F.when(like & ~spared, clip(base * (0.8 + 0.4 * unit(c("stance_confidence"))), 0.0, 42.0)).otherwise(0.0)
    cut = adjusted.withColumn("_penalty", penalty)
    cut = cut.withColumn("total", F.when(
        c("_penalty") > 0, F.greatest(F.lit(0.0), c("total") - c("_penalty"))).otherwise(c("total")))
    strength = c("supportive_defense_strength")
    middling = _is("SUPPORTIVE_DEFENSE") & (strength >= 0.25) & (strength < 0.40)
    score = r2(clip(c("total"), SCORE_MIN, SCORE_MAX))
    return cut.withColumns({
        "sarcasm_credibility_penalty": r2(-c("_penalty")),
        "rule_score": F.when(middling, r2(F.least(F.lit(82.0), score + 5.0 * strength))).otherwise(score),
    }).drop("_penalty")


# --- Q23, Q24 -------------------------------------------------------------------------

def fold_adjustments(docs: DataFrame) -> DataFrame:
    """Add the statistic adjustment (only when a claim was found) and the writing-quality component."""
    guarded = F.when(c("stance_label").isin("DIRECT_ATTACK", "DISMISSIVE_COMPLAINT"), F.least(
        c("quality_component"), F.lit(3.0))).otherwise(c("quality_component"))
    with_stats = F.when(c("stats_found"), r2(clip(
        c("rule_score") + c("stat_score_adjustment"), SCORE_MIN, SCORE_MAX))).otherwise(c("rule_score"))
    folded = docs.withColumns({
        "_component": guarded,
        "stat_accuracy_component": F.when(c("stats_found"), r2(c("stat_score_adjustment"))),
        "_score": with_stats,
    })
    return folded.withColumns({
        "adjusted_score": r2(clip(c("_score") + c("_component"), SCORE_MIN, SCORE_MAX)),
        "writing_quality_component": r2(c("_component")),
    }).drop("_component", "_score")


def calibrate(docs: DataFrame, score: str = "adjusted_score",
              bands: Mapping[str, tuple[float, float]] = CALIBRATION_BANDS) -> DataFrame:
    """Clip or pull the score towards the band of its label, by confidence."""
    low = lookup(c("stance_label"), {k: b[0] for k, b in bands.items()}, 0.0)
    high = lookup(c("stance_label"), {k: b[1] for k, b in bands.items()}, 100.0)
    base = docs.withColumns({"band_low": low, "band_high": high})
    x, lo, hi = c(score), c("band_low"), c("band_high")
    conf, strength = c("stance_confidence"), c("supportive_defense_strength")

    def outside(v: Column) -> Column:
        return F.when(v < lo, lo - v).when(v > hi, v - hi).otherwise(0.0)

    def pull(share: float) -> Column:
        return F.when(x < lo, x + share * (lo - x)).when(x > hi, x - share * (x - hi)).otherwise(x)

    inside = F.greatest(lo, F.least(hi, x))
    neutral = c("stance_label").isin("NEUTRAL_ANALYSIS", "BALANCED_DEBATE", "MIXED_STANCE")
    sup, con = _is("SUPPORTIVE_DEFENSE"), _is("CONSTRUCTIVE_CRITICISM")
    rules = [
        (sup & (strength >= 0.25) & (strength < 0.40),
         F.least(F.lit(82.0), F.greatest(x, F.lit(72.0), 70.0 + 5.0 * strength)),
         "supportive_mid_strength_passthrough"),
        (sup & (conf >= 0.55), inside, "supportive_confident_band_map"),
        (sup & (conf >= 0.35), pull(0.9), "supportive_medium_conf_pull"),
        (con & (conf >= 0.5), inside, "constructive_confident_band_map"),
        (con & (conf >= 0.32), pull(0.85), "constructive_medium_conf_pull"),
        (_is("DISMISSIVE_COMPLAINT"), F.least(x, hi), "dismissive_cap"),
        (_is("DIRECT_ATTACK"), F.least(x, hi), "direct_attack_cap"),
        (neutral & (conf >= 0.45), inside, "neutral_family_band_map"),
        (neutral & (conf >= 0.25), pull(0.85), "neutral_family_medium_conf_pull"),
    ]
    value, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for cond, new, why in rules[1:]:
        value, reason = value.when(cond, new), reason.when(cond, why)
    done = base.withColumns({
        "calibrated_score": r2(clip(value.otherwise(x), 0.0, 100.0)),
        "calibration_reason": reason.otherwise("no_change"),
    })
    return done.withColumns({
        "calibration_applied": c("calibrated_score") != x,
        "band_deviation_before": r2(outside(x)),
        "band_deviation_after": r2(outside(c("calibrated_score"))),
    }).drop("band_low", "band_high")
