"""Stance of paragraphs and documents.

A paragraph keeps one DOUBLE column per class, so every rule is plain column
arithmetic. The document roll-up only sums and maximises fixed-width columns:
it is a hash aggregate that folds map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prosegauge.functions import text as tx
from prosegauge.functions.numeric import argmax_label, normalize_probs, r4, total, unit
from prosegauge.lexicons import LEXICON, NEEDED, PATTERNS, PRIMARY_STANCES, SARCASM_THRESHOLD, STANCES, STYLE_TAGS
from prosegauge.operators.paragraphs import SPLIT, with_split

Lex = Mapping[str, list[str]]
KEYS = ("doc_id", "para_ix")
METRICS = ["sarcasm_score", "contradiction_score", "exaggeration_score", "context_mismatch_score", "ridicule_score",
           "directness_score", "certainty_score", "hostility_score", "neutrality_score"]
DEFENCES = ["fairness_defense_score", "reputation_defense_score", "criticism_reference_score",
            "context_change_score", "evaluation_redirection_score", "credibility_restoration_score",
            "contrast_structure_score", "causal_defense_score", "credibility_defense_score",
            "supportive_defense_strength"]
FLAGS = ["quoted_attack_detected", "attack_endorsement_detected", "attack_rejection_detected",
         "contrast_rejection_detected"]
GATE_REASONS = [
    "score_below_threshold", "blocked_by_stronger_explicit_supportive_context",
    "sarcasm_threshold_met_and_no_stronger_supportive_context", "empty_text",
]
PRIMARY_REASONS = [
    "max_primary_probability", "sarcasm_gate_forced_sarcastic_attack", "close_support_and_criticism_balance",
    "criticism_signal_near_or_above_support", "supportive_signal_above_criticism_margin",
    "dominant_supportive_signal", "dominant_direct_criticism_signal", "balanced_support_and_criticism",
    "close_polarity_signals", "low_polarity_commentary", "legacy_critical_route_alignment",
    "contrastive_mixed_intent_pattern",
]


def prob(label: str) -> str:
    return f"prob_{label.lower()}"


def primary_prob(label: str) -> str:
    return f"primary_prob_{label.lower()}"


def _optional(df: DataFrame, name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


# --- sarcasm (Q7) ---------------------------------------------------------------

def with_sarcasm(df: DataFrame, lex: Lex = LEXICON, lowered: str = "_lower") -> DataFrame:
    """Five features and the weighted sarcasm score, from a lower-cased column."""
    low, c = F.col(lowered), F.col
    cues = df.withColumns({
        "_metaphor": tx.contains_any(low, lex["sarcasm_metaphors"]),
        "_absurd": tx.contains_any(low, lex["sarcasm_comparisons"]),
        "_praise": tx.contains_any(low, lex["sarcasm_praise"]),
        "_mismatch": tx.contains_any(low, lex["sarcasm_mismatch"]),
        "_delayed": tx.contains_any(low, lex["sarcasm_delayed"]),
        "_apparently": low.contains("apparently"),
    })
    cues = cues.withColumn("_praise_fails", tx.regex_any_with(low, PATTERNS["praise_mismatch"], NEEDED["praise_mismatch"]))

    def count(*conds: Column) -> Column:
        return total([x.cast("int") for x in conds])

    features = cues.withColumns({
        "exaggeration_score": F.least(F.lit(1.0), count(
            c("_metaphor"), c("_absurd"), tx.contains_any(low, lex["sarcasm_grief"])) / 2.0),
        "contradiction_score": F.least(F.lit(1.0), count(
            c("_praise_fails"), tx.regex_any_with(low, PATTERNS["praise_contradiction"], NEEDED["praise_contradiction"]),
            tx.regex_any_with(low, PATTERNS["mocking_tail"], NEEDED["mocking_tail"]), c("_praise") & low.contains("?"),
            c("_praise") & c("_apparently"), c("_praise") & c("_mismatch")) / 2.0),
        "context_mismatch_score": (c("_praise") & (c("_mismatch") | c("_metaphor") | c("_absurd")
                                                   | c("_apparently"))).cast("double"),
        "mocking_praise_score": F.least(F.lit(1.0), count(
            c("_praise") & c("_metaphor"), c("_praise") & c("_absurd"), c("_praise_fails")) / 2.0),
        "delayed_negative_score": c("_delayed").cast("double"),
    })
    scored = features.withColumn("sarcasm_score", unit(
        0.2 * c("exaggeration_score") + 0.3 * c("contradiction_score") + 0.2 * c("context_mismatch_score")
        + 0.2 * c("mocking_praise_score") + 0.1 * c("delayed_negative_score")))
    return scored.drop("_metaphor", "_absurd", "_praise", "_mismatch", "_delayed", "_apparently", "_praise_fails")


def sarcasm(paras: DataFrame, lex: Lex = LEXICON, keep: Sequence[str] = KEYS) -> DataFrame:
    scored = with_sarcasm(paras.select(*keep, F.lower("text").alias("_lower")), lex)
    return scored.select(*keep, "exaggeration_score", "contradiction_score", "context_mismatch_score",
                         "mocking_praise_score", "delayed_negative_score", "sarcasm_score")


# --- defence and quotes (Q8, Q9) ---------------------------------------------------

def with_defence(df: DataFrame, lex: Lex = LEXICON, lowered: str = "_lower") -> DataFrame:
    low, c = F.col(lowered), F.col
    reference = tx.marker_score(low, lex["criticism_reference"], 3.0)
    contrast = tx.marker_score(low, lex["contrast_structure"], 2.0)
    named = df.withColumns({
        "fairness_defense_score": tx.marker_score(low, lex["fairness_defense"], 3.0),
        "reputation_defense_score": tx.marker_score(low, lex["reputation_defense"], 2.0),
        "criticism_reference_score": F.greatest(
            reference, F.when(tx.contains_any(low, lex["criticism_strong"]), 0.4).otherwise(0.0)),
        "context_change_score": tx.marker_score(low, lex["context_change"], 3.0),
        "evaluation_redirection_score": tx.marker_score(low, lex["evaluation_redirection"], 2.5),
        "credibility_restoration_score": tx.marker_score(low, lex["credibility_restoration"], 2.0),
        "contrast_structure_score": F.when(
            tx.contains_any(low, lex["disagreement_context"]) & (contrast > 0),
            F.greatest(F.lit(0.6), contrast)).otherwise(0.0),
    })
    joint = named.withColumns({
        "causal_defense_score": unit(0.40 * c("criticism_reference_score") + 0.30 * c("context_change_score")
                                     + 0.30 * c("evaluation_redirection_score")),
        "credibility_defense_score": unit(0.60 * c("credibility_restoration_score")
                                          + 0.40 * c("contrast_structure_score")),
    })
    return joint.withColumn("rule_strength", unit(
        0.30 * c("fairness_defense_score") + 0.20 * c("reputation_defense_score")
        + 0.30 * c("causal_defense_score") + 0.20 * c("credibility_defense_score")))


def defence_scores(paras: DataFrame, lex: Lex = LEXICON, keep: Sequence[str] = KEYS) -> DataFrame:
    scored = with_defence(paras.select(*keep, F.lower("text").alias("_lower")), lex)
    return scored.drop("_lower")


def with_quotes(df: DataFrame, lex: Lex = LEXICON, lowered: str = "_lower") -> DataFrame:
    low, c = F.col(lowered), F.col
    found = df.withColumns({
        "quoted_attack_detected": tx.contains_any(low, lex["quote_context"]) & tx.contains_any(low, lex["attack"]),
        "contrast_rejection_detected": tx.regex_any(low, PATTERNS["contrast_rejection"]),
    })
    said = low.contains("people say")
    rejects = tx.contains_any(low, lex["rejection"]) | (said & tx.regex_any(low, PATTERNS["rejection_structure"]))
    endorses = (tx.contains_any(low, lex["endorsement"])
                | (said & tx.regex_any(low, PATTERNS["endorsement_structure"])))
    return found.withColumns({
        "attack_rejection_detected": c("quoted_attack_detected") & rejects,
        "attack_endorsement_detected": c("quoted_attack_detected") & endorses,
    })


def quote_flags(paras: DataFrame, lex: Lex = LEXICON, keep: Sequence[str] = KEYS) -> DataFrame:
    return with_quotes(paras.select(*keep, F.lower("text").alias("_lower")), lex).select(*keep, *FLAGS)


def explanation_depth(text: Column, lowered: Column, lex: Lex = LEXICON) -> Column:
    # one match per run between sentence marks that holds more than white space
    n_parts = F.regexp_count(text, F.lit(tx.NOT_WS.replace("]", ".!?]") + "[^.!?]*"))
    spread = F.least(F.lit(1.0), F.greatest(F.lit(1), n_parts) / 4.0)
    return unit(0.7 * tx.marker_score(lowered, lex["stance_reasoning"], 4.0) + 0.3 * spread)


def feature_vector(lowered: Column, text: Column, lex: Lex = LEXICON) -> Column:
    """Ten rule features that describe a text next to its embedding."""
    contrast = tx.marker_score(lowered, lex["contrast_structure"], 2.0)
    reference = tx.marker_score(lowered, lex["criticism_reference"], 3.0)
    return F.array(
        F.greatest(reference, F.when(tx.contains_any(lowered, lex["criticism_strong"]), 0.4).otherwise(0.0)),
        tx.marker_score(lowered, lex["context_change"], 3.0),
        tx.marker_score(lowered, lex["evaluation_redirection"], 2.5),
        tx.marker_score(lowered, lex["credibility_restoration"], 2.0),
        F.when(tx.contains_any(lowered, lex["disagreement_context"]) & (contrast > 0),
               F.greatest(F.lit(0.6), contrast)).otherwise(0.0),
        tx.marker_score(lowered, lex["suggestion"], 3.0),
        tx.marker_score(lowered, lex["complaint"], 2.0),
        tx.marker_score(lowered, lex["attack"], 2.0),
        explanation_depth(text, lowered, lex),
        tx.marker_score(lowered, lex["contrast"] + lex["discourse_extra"], 4.0),
    )


# --- one paragraph (Q10-Q13) --------------------------------------------------------

def paragraph_stance(paras: DataFrame, lex: Lex = LEXICON, threshold: float = SARCASM_THRESHOLD,
                     keep: Sequence[str] = KEYS) -> DataFrame:
    """Stance, primary stance, tone metrics, style tags and flags of every paragraph.

    Model inputs are optional columns: ``emb_<label>`` (prototype similarity,
    else 0), ``bench_<label>`` (benchmark probability, else uniform) and
    ``sem_supportive`` / ``sem_constructive`` / ``sem_balanced`` (else 0).
    """
    c = F.col
    model = {f"emb_{s.lower()}": _optional(paras, f"emb_{s.lower()}") for s in STANCES}
    model |= {f"bench_{s.lower()}": _optional(paras, f"bench_{s.lower()}", 1.0 / len(STANCES)) for s in STANCES}
    model |= {n: _optional(paras, n) for n in ("sem_supportive", "sem_constructive", "sem_balanced")}
    kept = [k for k in keep if k != "text"]
    split = with_split(paras)
    base = split.select(*[k for k in kept if k not in SPLIT], "text", *SPLIT, *[v.alias(k) for k, v in model.items()])
    base = base.withColumn("_depth", explanation_depth(c("text"), c("_lower"), lex))
    low = c("_lower")
    base = with_quotes(with_defence(with_sarcasm(base, lex), lex), lex)

    def score(name: str, norm: float) -> Column:
        return tx.marker_score(low, lex[name], norm)

    def some(name: str) -> Column:
        return tx.contains_any(low, lex[name])

    base = base.withColumns({
        "_blank": ~low.rlike(tx.NOT_WS),
        "_words": F.size("_toks"),
        "_sup0": score("supportive", 2.5),
        "con": score("constructive", 2.5),
        "sug": score("suggestion", 3.0),
        "cmp": F.greatest(score("complaint", 2.0), F.when(some("frustration"), 0.65).otherwise(0.0)),
        "_att0": F.greatest(score("attack", 2.0), F.when(some("selection_attack"), 0.65).otherwise(0.0)),
        "deb": score("debate_balance", 2.0),
        "dis": tx.marker_score(low, lex["contrast"] + lex["discourse_extra"], 4.0),
        "_direct_words": score("directness", 2.0),
        "certainty_score": score("certainty", 2.0),
        "_neutral_words": score("neutrality", 2.0),
        "_mixed_intent": F.lit(True) if not lex["mixed_intent"] else
        F.forall(F.array(*[F.lit(m) for m in lex["mixed_intent"]]), lambda m: low.contains(m)),
        # what the style tags need of the text
        "_asks": low.contains("?"),
        "_verbs": tx.regex_any(low, PATTERNS["direct_verbs"]),
        "_rhetorical": some("tag_rhetorical"),
        "_quoted": low.contains('"') | low.contains("'") | some("tag_quoted"),
        "_reported": some("tag_reported"),
        "_conversational": some("tag_conversational"),
        # strength from similarity to labelled texts; zero without an encoder
        "_semantic": unit(c("sem_supportive") * (
            0.4 * F.greatest(c("criticism_reference_score"), c("sem_constructive"))
            + 0.4 * F.greatest(c("_depth"), c("sem_balanced"))
            + 0.2 * F.greatest(score("supportive", 2.5),
                               c("sem_supportive") + c("sem_balanced") + c("sem_constructive")))),
    }).drop(*({"text", *SPLIT} - set(keep)))

    base = base.withColumns({
        "supportive_defense_strength": unit(0.5 * c("_semantic") + 0.5 * c("rule_strength")),
        "attack_rejection_detected": c("attack_rejection_detected")
        | (c("contrast_rejection_detected") & (c("fairness_defense_score") >= 0.4)),
    })
    base = base.withColumns({
        "sup": F.least(F.lit(1.0), F.when(c("attack_rejection_detected"),
                                          F.least(F.lit(1.0), c("_sup0") + 0.25)).otherwise(c("_sup0"))
                       + 0.25 * c("supportive_defense_strength")),
        "_att1": F.when(c("attack_rejection_detected"), c("_att0") * 0.25).otherwise(c("_att0")),
    })
    base = base.withColumn("att", F.when(c("attack_endorsement_detected"),
                                         F.least(F.lit(1.0), c("_att1") + 0.4)).otherwise(c("_att1")))

    def emb(label: str) -> Column:
        return c(f"emb_{label.lower()}")

    base = base.withColumns({
        "_raw_sup": 0.55 * c("sup") + 0.3 * emb("SUPPORTIVE_DEFENSE") + 0.15 * c("dis"),
        "_raw_con": 0.55 * c("con") + 0.3 * emb("CONSTRUCTIVE_CRITICISM") + 0.15 * c("dis"),
        "_raw_neu": 0.45 * F.greatest(F.lit(0.0), 1.0 - (c("sup") + c("con") + c("cmp") + c("att")) / 3.0)
        + 0.4 * emb("NEUTRAL_ANALYSIS") + 0.15 * (1.0 - c("deb")),
        "_raw_deb": 0.55 * c("deb") + 0.3 * emb("BALANCED_DEBATE") + 0.15 * c("dis"),
        "_raw_cmp": 0.6 * c("cmp") + 0.3 * emb("DISMISSIVE_COMPLAINT") + 0.1 * (1.0 - c("dis")),
        "_raw_att": 0.6 * c("att") + 0.3 * emb("DIRECT_ATTACK") + 0.1 * c("cmp"),
        "_raw_sar": 0.45 * c("sarcasm_score") + 0.25 * c("att") + 0.15 * c("cmp") + 0.15 * (1.0 - c("sup")),
        "_raw_mix": 0.35 * (c("sup") + c("con") + c("deb")) / 3.0 + 0.35 * emb("MIXED_STANCE") + 0.3 * c("dis"),
        "_credibility": c("credibility_defense_score"),
    })

    # sarcasm shifts, then the sarcasm gate
    mocking = c("sarcasm_score") >= 0.4
    base = base.withColumns({
        "_raw_sup": F.when(mocking, F.greatest(F.lit(0.0), c("_raw_sup") - 0.2)).otherwise(c("_raw_sup")),
        "_raw_att": F.when(mocking, F.least(F.lit(1.0), c("_raw_att") + 0.15)).otherwise(c("_raw_att")),
        "credibility_defense_score": F.when(
            mocking, F.greatest(F.lit(0.0), c("_credibility") - 0.1)).otherwise(c("_credibility")),
    })
    base = base.withColumn("_explicit", F.greatest(
        c("sup"), c("rule_strength"), c("fairness_defense_score"), c("reputation_defense_score"),
        c("causal_defense_score"), c("credibility_defense_score")) >= 0.72)
    base = base.withColumn("_gate", (c("sarcasm_score") >= threshold) & ~c("_explicit"))
    base = base.withColumns({
        "gate_ix": F.when(c("_blank"), 3).when(c("_gate"), 2)
        .when(c("sarcasm_score") >= threshold, 1).otherwise(0),
        "_raw_sup": F.when(c("_gate"), F.greatest(F.lit(0.0), c("_raw_sup") - 0.25)).otherwise(c("_raw_sup")),
        "_raw_sar": F.when(c("_gate"), F.greatest(c("_raw_sar"), 0.55 + 0.35 * c("sarcasm_score")))
        .otherwise(c("_raw_sar")),
        "_raw_att": F.when(c("_gate"), F.greatest(c("_raw_att"), 0.25 + 0.5 * c("sarcasm_score")))
        .otherwise(c("_raw_att")),
        # tone metrics (Q13)
        "ridicule_score": unit(0.4 * c("sarcasm_score") + 0.3 * c("exaggeration_score")
                               + 0.3 * c("mocking_praise_score")),
        "directness_score": unit(0.7 * c("att") + 0.3 * c("_direct_words")),
        "hostility_score": unit(0.65 * c("att") + 0.35 * c("cmp")),
        "neutrality_score": unit(0.3 * (1.0 - F.greatest(c("sup"), c("att"), c("cmp"), c("sarcasm_score")))
                                 + 0.7 * c("_neutral_words")),
    })

    # support boosts; each is capped at 1, so capping the sum is the same
    causal, credible = c("causal_defense_score") >= 0.35, c("credibility_defense_score") >= 0.35
    base = base.withColumn("_forced", causal & (c("context_change_score") >= 0.3)
                           & (c("evaluation_redirection_score") >= 0.3))

    def boost(cond: Column, by: float) -> Column:
        return F.when(cond, by).otherwise(0.0)

    boosts = (boost((c("fairness_defense_score") >= 0.4) | (c("reputation_defense_score") >= 0.4), 0.25)
              + boost(causal, 0.25) + boost(credible, 0.20)
              + boost((c("evaluation_redirection_score") >= 0.35) & credible, 0.15)
              + boost(c("_forced"), 0.20))
    base = base.withColumn("_boost", boosts)
    base = base.withColumn("_raw_sup", F.when(
        c("_boost") > 0, F.least(F.lit(1.0), c("_raw_sup") + c("_boost"))).otherwise(c("_raw_sup")))

    raw = dict(zip(STANCES, ["_raw_sup", "_raw_con", "_raw_neu", "_raw_deb", "_raw_cmp", "_raw_att", "_raw_sar",
                             "_raw_mix"]))
    base = base.withColumns({f"_mix{i}": 0.35 * c(raw[s]) + 0.65 * c(f"bench_{s.lower()}")
                             for i, s in enumerate(STANCES)})
    mixes = [c(f"_mix{i}") for i in range(len(STANCES))]
    at = {s: i for i, s in enumerate(STANCES)}
    endorsed, rejected = c("attack_endorsement_detected"), c("attack_rejection_detected")
    best = F.greatest(*mixes)
    # label ladder: index of the label and the lowest value its class must get
    base = base.withColumns({
        "_rung": F.when(c("_gate"), 1).when(endorsed, 2).when(c("att") >= 0.85, 3)
        .when(rejected & (c("causal_defense_score") >= 0.3), 4).otherwise(0),
        "_top": F.when(best < 0.28, at["MIXED_STANCE"]).otherwise(argmax_label(list(enumerate(mixes)))),
    })
    rung = c("_rung")
    base = base.withColumns({
        "_label0": F.when(rung == 1, at["SARCASTIC_CRITICISM"]).when(rung.isin(2, 3), at["DIRECT_ATTACK"])
        .when(rung == 4, at["SUPPORTIVE_DEFENSE"]).otherwise(c("_top")),
        f"_mix{at['SARCASTIC_CRITICISM']}": F.when(rung == 1, F.greatest(
            c(f"_mix{at['SARCASTIC_CRITICISM']}"), F.lit(0.78))).otherwise(c(f"_mix{at['SARCASTIC_CRITICISM']}")),
        f"_mix{at['DIRECT_ATTACK']}": F.when(rung == 2, F.greatest(c(f"_mix{at['DIRECT_ATTACK']}"), F.lit(0.9)))
        .when(rung == 3, F.greatest(c(f"_mix{at['DIRECT_ATTACK']}"), F.lit(0.85)))
        .otherwise(c(f"_mix{at['DIRECT_ATTACK']}")),
        f"_mix{at['SUPPORTIVE_DEFENSE']}": F.when(rung == 4, F.greatest(
            c(f"_mix{at['SUPPORTIVE_DEFENSE']}"), F.lit(0.8))).otherwise(c(f"_mix{at['SUPPORTIVE_DEFENSE']}")),
    })
    base = base.withColumns({prob(s): r4(p) for s, p in zip(STANCES, normalize_probs(mixes))})
    probs = [c(prob(s)) for s in STANCES]

    def prob_at(ix: Column) -> Column:
        return F.get(F.array(*probs), ix)

    mild = (c("att") < 0.40) & (c("cmp") < 0.40)
    base = base.withColumn("_conf0", prob_at(c("_label0")))
    base = base.withColumn("_precedence", ~c("_gate") & (c("supportive_defense_strength") >= 0.30)
                           & (c("sem_supportive") >= c("sem_constructive") - 0.03) & mild)
    base = base.withColumn("_routing", ~c("_gate") & ~c("_precedence") & (c("_conf0") < 0.55)
                           & (c("_semantic") >= 0.25) & (c("supportive_defense_strength") >= 0.25) & mild
                           & (c("sem_constructive") - 0.002 < c("sem_supportive")))
    base = base.withColumn("stance_ix", F.when(c("_precedence") | c("_routing"), at["SUPPORTIVE_DEFENSE"])
                           .otherwise(c("_label0")))
    support_prob, is_support = c(prob("SUPPORTIVE_DEFENSE")), c("stance_ix") == at["SUPPORTIVE_DEFENSE"]
    confidence = (F.when(c("_forced") & is_support, F.greatest(support_prob, F.lit(0.6)))
                  .when(c("_routing"), F.greatest(support_prob, F.lit(0.55)))
                  .when(c("_precedence"), F.greatest(c("_conf0"), support_prob, F.lit(0.55)))
                  .otherwise(prob_at(c("stance_ix"))))

    # primary stance (Q11)
    base = base.withColumns({
        "stance_confidence": r4(confidence),
        "_s": unit(0.5 * c("_raw_sup") + 0.2 * c("supportive_defense_strength") + 0.3 * c("sem_supportive")),
        "_k": F.greatest(c("_raw_att"), c("_raw_cmp"), 0.85 * c("_raw_con"), 0.7 * c("att") + 0.3 * c("cmp")),
        "_x": F.greatest(c("_raw_sar"), c("sarcasm_score")),
    })
    s, k, x, n = c("_s"), c("_k"), c("_x"), c("neutrality_score")
    doubtful = ((c("sarcasm_score") >= threshold) & (c("contradiction_score") >= 0.35)
                & (c("context_mismatch_score") >= 0.35))
    primary_raw = [
        F.when(doubtful, F.greatest(F.lit(0.0), s - 0.35)).otherwise(s),
        k,
        F.when(c("_gate"), F.greatest(x, F.lit(0.78))).otherwise(x),
        n,
        F.greatest(F.lit(0.0), 1.0 - F.abs(s - k) - 0.2),
    ]
    base = base.withColumns({f"_p{i}": e for i, e in enumerate(primary_raw)})
    base = base.withColumns({primary_prob(lab): r4(e) for lab, e in zip(
        PRIMARY_STANCES, normalize_probs([c(f"_p{i}") for i in range(5)]))})
    gap, quiet = F.abs(s - k), x < 0.35
    ladder = [  # condition, primary label, reason
        (~c("_gate") & (s >= 0.3) & (k >= 0.2) & c("_mixed_intent"), 4, 11),
        (~c("_gate") & (c("sarcasm_score") < threshold) & (s < 0.45)
         & c("stance_ix").isin(at["DIRECT_ATTACK"], at["DISMISSIVE_COMPLAINT"], at["CONSTRUCTIVE_CRITICISM"]), 1, 10),
        (c("_gate"), 2, 1),
        ((s >= 0.28) & (k >= 0.28) & (gap <= 0.15), 4, 2),
        ((k >= 0.34) & (k >= s - 0.02) & quiet, 1, 3),
        ((s >= 0.33) & (s >= k + 0.08) & quiet, 0, 4),
        ((s >= 0.42) & (k < 0.35) & quiet, 0, 5),
        ((k >= 0.4) & quiet, 1, 6),
        ((s >= 0.45) & (k >= 0.45) & (gap <= 0.15), 4, 7),
        ((s >= 0.35) & (k >= 0.35) & (gap <= 0.2), 4, 8),
        ((n >= 0.45) & (s < 0.35) & (k < 0.35) & quiet, 3, 9),
    ]
    rule = F.when(ladder[0][0], 0)
    for i, (cond, _, _) in enumerate(ladder[1:], start=1):
        rule = rule.when(cond, i)
    base = base.withColumn("_rule", rule.otherwise(len(ladder)))
    primaries = [c(primary_prob(lab)) for lab in PRIMARY_STANCES]
    labels = F.array(*[F.lit(lab) for _, lab, _ in ladder], F.lit(-1))
    reasons = F.array(*[F.lit(r) for _, _, r in ladder], F.lit(0))
    base = base.withColumns({
        "primary_ix": F.when(c("_rule") == len(ladder), argmax_label(list(enumerate(primaries))))
        .otherwise(F.get(labels, c("_rule"))),
        "primary_reason": F.get(F.array(*[F.lit(r) for r in PRIMARY_REASONS]), F.get(reasons, c("_rule"))),
    })
    hot = c("sarcasm_score") >= threshold
    tags = [
        (c("directness_score") >= 0.45) | (~c("_asks") & c("_verbs")),
        hot | (c("contradiction_score") >= 0.5),
        c("exaggeration_score") >= 0.5,
        c("_asks") | c("_rhetorical"),
        c("_quoted"),
        c("_reported"),
        hot & (c("directness_score") < 0.45),
        c("_conversational"),
    ]

    # a blank paragraph is neutral by definition
    blank = c("_blank")

    def unless_blank(e: Column, value: float | bool | int) -> Column:
        return F.when(blank, F.lit(value)).otherwise(e)

    weight = F.greatest(F.lit(1), c("_words")) * F.greatest(F.lit(0.05), c("_depth"))
    fields = {
        "weight": weight,
        "explanation_depth": r4(c("_depth")),
        "stance_ix": unless_blank(c("stance_ix"), at["NEUTRAL_ANALYSIS"]),
        "stance_confidence": unless_blank(c("stance_confidence"), 1.0),
        **{prob(lab): unless_blank(c(prob(lab)), 1.0 if lab == "NEUTRAL_ANALYSIS" else 0.0) for lab in STANCES},
        "primary_ix": unless_blank(c("primary_ix"), 3),
        **{primary_prob(lab): unless_blank(c(primary_prob(lab)), 1.0 if lab == "NEUTRAL_COMMENTARY" else 0.0)
           for lab in PRIMARY_STANCES},
        **{m: unless_blank(r4(c(m)), 1.0 if m == "neutrality_score" else 0.0) for m in METRICS},
        **{d: unless_blank(r4(c(d)), 0.0) for d in DEFENCES},
        **{f: unless_blank(c(f), False) for f in FLAGS},
        **{f"tag_{t.lower()}": unless_blank(cond, False) for t, cond in zip(STYLE_TAGS, tags)},
        "gate_ix": c("gate_ix"),
        "primary_reason": c("primary_reason"),
    }
    return base.select(*keep, *[e.alias(name) for name, e in fields.items()])


def named(ix: str, labels: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), F.col(ix))


def style_tags(prefix: str = "tag_") -> Column:
    """The tags that apply, in their fixed order."""
    return F.array_compact(F.array(*[F.when(F.col(prefix + t.lower()), F.lit(t)) for t in STYLE_TAGS]))


def stance_report(stances: DataFrame, keep: Sequence[str] = KEYS) -> DataFrame:
    """Readable form of ``paragraph_stance``: labels, probability maps and tag arrays."""
    c = F.col
    return stances.select(
        *keep,
        named("stance_ix", STANCES).alias("stance_label"), "stance_confidence",
        named("primary_ix", PRIMARY_STANCES).alias("primary_stance_label"), "primary_reason",
        named("gate_ix", GATE_REASONS).alias("sarcasm_gate_reason"),
        style_tags().alias("style_tags"),
        F.map_from_arrays(F.array(*[F.lit(s) for s in STANCES]), F.array(*[c(prob(s)) for s in STANCES]))
        .alias("stance_probabilities"),
        F.map_from_arrays(F.array(*[F.lit(s) for s in PRIMARY_STANCES]),
                          F.array(*[c(primary_prob(s)) for s in PRIMARY_STANCES]))
        .alias("primary_stance_probabilities"),
        "weight", *METRICS, *DEFENCES, *FLAGS,
    )


# --- documents (Q14, A7, A22) ----------------------------------------------------------

def stance_folds() -> list[Column]:
    """Aggregates over paragraph stances; all inputs and outputs are fixed-width."""
    w = F.col("weight")
    means = [prob(s) for s in STANCES] + [primary_prob(s) for s in PRIMARY_STANCES] + DEFENCES
    return [
        F.count(F.lit(1)).alias("n_paragraphs"),
        *[(F.sum(w * F.col(n)) / F.sum(w)).alias(n) for n in means],
        *[F.avg(m).alias(m) for m in METRICS],
        *[F.bool_or(f).alias(f) for f in FLAGS],
        *[F.count_if(f"tag_{t.lower()}").alias(f"_n_{t.lower()}") for t in STYLE_TAGS],
        # used where a document has one paragraph, whose result passes through
        F.max("stance_ix").alias("_stance1"), F.max("stance_confidence").alias("_conf1"),
        F.max("primary_ix").alias("_primary1"), F.max("gate_ix").alias("_gate1"),
    ]


def finish_stance(folded: DataFrame) -> DataFrame:
    """Labels, confidences and tags from the folded paragraph columns."""
    c = F.col
    single = c("n_paragraphs") == 1
    rounded = folded.withColumns({
        **{prob(s): r4(c(prob(s))) for s in STANCES},
        **{primary_prob(s): r4(c(primary_prob(s))) for s in PRIMARY_STANCES},
        **{n: r4(c(n)) for n in METRICS + DEFENCES},
    })
    renormed = rounded.withColumns({
        **{prob(s): F.when(single, c(prob(s))).otherwise(r4(p))
           for s, p in zip(STANCES, normalize_probs([c(prob(s)) for s in STANCES]))},
        **{primary_prob(s): F.when(single, c(primary_prob(s))).otherwise(r4(p))
           for s, p in zip(PRIMARY_STANCES, normalize_probs([c(primary_prob(s)) for s in PRIMARY_STANCES]))},
    })
    probs = [c(prob(s)) for s in STANCES]
    primaries = [c(primary_prob(s)) for s in PRIMARY_STANCES]
    counted = F.filter(
        F.array(*[F.struct((-c(f"_n_{t.lower()}")).alias("rank"), F.lit(t).alias("tag"),
                           F.lit(i).alias("place")) for i, t in enumerate(STYLE_TAGS)]), lambda e: e["rank"] < 0)
    in_order = F.transform(counted, lambda e: e["tag"])
    by_count = F.transform(F.array_sort(counted), lambda e: e["tag"])
    out = renormed.withColumns({
        "_stance": F.when(single, c("_stance1")).otherwise(argmax_label(list(enumerate(probs)))),
        "_primary": F.when(single, c("_primary1")).otherwise(argmax_label(list(enumerate(primaries)))),
        "style_tags": F.when(single, in_order).otherwise(by_count),
        "sarcasm_gate_reason": F.when(single, named("_gate1", GATE_REASONS)).otherwise("paragraph_aggregated"),
    })
    out = out.withColumns({
        "stance_label": named("_stance", STANCES),
        "stance_confidence": F.when(single, c("_conf1")).otherwise(F.get(F.array(*probs), c("_stance"))),
        "primary_stance_label": named("_primary", PRIMARY_STANCES),
        "primary_stance_confidence": F.get(F.array(*primaries), c("_primary")),
    })
    return out.drop("_stance", "_primary", "_stance1", "_conf1", "_primary1", "_gate1",
                    *[f"_n_{t.lower()}" for t in STYLE_TAGS])


def document_stance(stances: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document; several paragraphs are averaged by length x depth."""
    return finish_stance(stances.groupBy(*by).agg(*stance_folds()))


def tag_counts(stances: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Tag frequency per document, most frequent first."""
    tags = stances.select(*by, F.explode(style_tags()).alias("tag"))
    counts = tags.groupBy(*by, "tag").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct((-F.col("n")).alias("neg"), F.col("tag"), F.col("n"))
    # at most one entry per tag of the fixed tag set
    return counts.groupBy(*by).agg(F.transform(
        F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["tag"].alias("tag"), e["n"].alias("n"))).alias("tags"))
