"""Discourse, constructiveness, toxicity and component signals per paragraph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prosegauge.functions import numeric as nu, text as tx
from prosegauge.functions.models import MODEL_COLUMNS, join_scores
from prosegauge.functions.numeric import unit
from prosegauge.lexicons import COMPONENT_MAX, LEXICON, PATTERNS
from prosegauge.operators.paragraphs import SPLIT, with_split

Lex = Mapping[str, list[str]]
DETECTOR = ["constructiveness_score", "reasoning_marker_score", "suggestion_score", "explanation_depth_score",
            "strategic_score", "discourse_score", "debate_style_score"]
SIMILARITIES = ["constructive_similarity", "non_constructive_similarity", "debate_similarity",
                "sincerity_similarity"]


def _input(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """Optional model column, or its no-model value."""
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def abuse_indicator(lowered: Column, lex: Lex = LEXICON) -> Column:
    attacks = sum((lowered.rlike(p).cast("int") for p in PATTERNS["personal_attack"]), F.lit(0))
    return unit(0.7 * tx.phrase_ratio(lowered, lex["abuse_words"]) + 0.3 * F.least(F.lit(1.0), attacks / 2.0))


def discourse_columns(lowered: Column, n_sentences: Column, lex: Lex = LEXICON) -> dict[str, Column]:
    arc = (tx.contains_any(lowered, lex["discourse_events"])
           & tx.contains_any(lowered, lex["discourse_interpretation"])
           & tx.contains_any(lowered, lex["discourse_impact"]))
    score = (0.3 * tx.marker_score(lowered, lex["discourse_contrast"], 2.0)
             + 0.2 * tx.marker_score(lowered, lex["discourse_frames"], 2.0)
             + 0.35 * arc.cast("double")
             + 0.15 * unit((n_sentences - 3) / 4.0))
    return {
        "discourse_score": F.when(n_sentences > 0, unit(score)).otherwise(0.0),
        "debate_style_score": tx.marker_score(lowered, lex["debate_balance"], 2.0),
    }


def discourse(paras: DataFrame, lex: Lex = LEXICON, keep: Sequence[str] = ("doc_id", "para_ix")) -> DataFrame:
    base = paras.select(*keep, F.lower("text").alias("_lower"), tx.sentence_count(F.col("text")).alias("_n"))
    return base.select(*keep, *[c.alias(n) for n, c in discourse_columns(F.col("_lower"), F.col("_n"), lex).items()])


def constructiveness(paras: DataFrame, lex: Lex = LEXICON, keep: Sequence[str] = ("doc_id", "para_ix")) -> DataFrame:
    """Detector score, its parts and confidence.

    Optional columns ``constructive_similarity`` and
    ``non_constructive_similarity`` carry an encoder's best prototype
    similarities; without them the margin is 0.
    """
    base = with_split(paras).withColumn("_n", F.size("_sents"))
    low, n = F.col("_lower"), F.col("_n")
    explained = (tx.contains_any(low, lex["reasoning"]) | tx.contains_any(low, lex["explanation_connectors"])
                 | (low.contains("then") & low.rlike(r"(?dU)\bif\b.*\bthen\b")))
    chain = tx.contains_any(low, lex["problem"]) & explained & tx.contains_any(low, lex["implication"])
    short_chain = tx.contains_any(low, lex["simple_problem"]) & tx.contains_any(low, lex["simple_consequence"])
    bonus = unit((n - 2) / 3.0)
    # a chain alone gives .7, so the .6 minimum only matters for the short form
    depth = F.greatest(0.7 * chain.cast("double") + 0.3 * bonus, F.when(chain | short_chain, 0.6).otherwise(0.0))
    parts = base.withColumns({
        "constructive_similarity": _input(paras, "constructive_similarity"),
        "non_constructive_similarity": _input(paras, "non_constructive_similarity"),
        "reasoning_marker_score": tx.marker_score(low, lex["reasoning"], 4.0),
        "suggestion_score": tx.marker_score(low, lex["constructive_suggestion"], 3.0),
        "explanation_depth_score": F.when(n > 0, unit(depth)).otherwise(0.0),
        "strategic_score": tx.marker_score(low, lex["strategic"], 3.0),
        **discourse_columns(low, n, lex),
        "_respectful": tx.contains_any(low, lex["respectful"]) & ~tx.contains_any(low, lex["constructiveness_abuse"]),
    })
    c = F.col
    margin = c("constructive_similarity") - c("non_constructive_similarity")
    score = (0.3 / (1.0 + F.exp(-8.0 * margin))
             + 0.16 * c("reasoning_marker_score") + 0.16 * c("suggestion_score")
             + 0.14 * c("explanation_depth_score") + 0.14 * c("discourse_score") + 0.1 * c("strategic_score")
             + F.when(c("debate_style_score") >= 0.4, 0.05 * c("debate_style_score")).otherwise(0.0)
             + F.when((c("reasoning_marker_score") >= 0.2) & c("_respectful"), 0.12).otherwise(0.0))
    confidence = (F.abs(margin) * 2.0 + 0.25 * c("reasoning_marker_score") + 0.2 * c("explanation_depth_score")
                  + 0.2 * c("discourse_score") + 0.15 * c("debate_style_score") + 0.2 * c("strategic_score"))
    return parts.select(
        *keep,
        F.when(n > 0, unit(score)).otherwise(0.0).alias("constructiveness_score"),
        "constructive_similarity", "non_constructive_similarity", "reasoning_marker_score", "suggestion_score",
        "explanation_depth_score", "strategic_score", "discourse_score", "debate_style_score",
        F.when(n > 0, F.least(F.lit(1.0), confidence)).otherwise(0.0).alias("constructiveness_confidence"),
    )


def toxicity(paras: DataFrame, lex: Lex = LEXICON, scores: DataFrame | None = None,
             keep: Sequence[str] = ("doc_id", "para_ix")) -> DataFrame:
    """Abuse indicator, effective toxicity and negativity."""
    base = join_scores(paras, scores, keep)
    scored = base.withColumn("abuse_signal", abuse_indicator(F.lower("text"), lex))
    c = F.col
    return scored.select(
        *keep, unit(c("toxic")).alias("model_toxicity"), "abuse_signal",
        unit(0.25 * unit(c("toxic")) + 0.75 * c("abuse_signal")).alias("effective_toxicity"),
        unit(0.3 * c("anger") + 0.2 * c("sadness") + 0.15 * c("fear") + 0.35 * c("negative")).alias("negativity"),
    )


def paragraph_components(paras: DataFrame, lex: Lex = LEXICON, scores: DataFrame | None = None,
                         keep: Sequence[str] = ("doc_id", "para_ix")) -> DataFrame:
    """The five components (maxima 40/20/15/10/15) and every signal behind them, per paragraph."""
    given = join_scores(paras, scores, keep)
    extra = [c for c in given.columns if c not in (*keep, "text", *SPLIT)]
    split = with_split(given)
    detected = constructiveness(split, lex, keep=[*keep, *[e for e in extra if e not in SIMILARITIES[:2]],
                                                  *[x for x in SPLIT if x in split.columns]])
    base = detected.withColumn("sentence_count", F.size("_sents"))
    low, toks, c = F.col("_lower"), F.col("_toks"), F.col
    reasoning_words = lex["analytical_reasoning_terms"] + lex["analytical_terms"]

    step1 = base.withColumns({
        "word_count": F.size(toks),
        "abuse_signal": abuse_indicator(low, lex),
        "negativity": unit(0.3 * c("anger") + 0.2 * c("sadness") + 0.15 * c("fear") + 0.35 * c("negative")),
        "clarity_signal": tx.clarity(F.size(toks), c("sentence_count"), tx.syllable_count(low)),
        "_analysis_words": unit(tx.keyword_ratio(toks, reasoning_words) * 14.0),
        "_analysis_phrases": unit(tx.phrase_ratio(low, lex["analytical_phrases"]) * 2.2),
        "_debate": tx.phrase_ratio(low, lex["debate_terms"]),
        "_civil": unit(tx.keyword_ratio(toks, lex["civility_terms"]) * 20.0),
        "_fan": unit(tx.keyword_ratio(toks, lex["fan_terms"]) * 10.0),
    })
    step2 = step1.withColumns({
        "effective_toxicity": unit(0.25 * unit(c("toxic")) + 0.75 * c("abuse_signal")),
        "analytical_signal": unit(0.48 * c("_analysis_words") + 0.24 * c("_analysis_phrases")
                                  + 0.28 * c("strategic_score")),
        "debate_balance_signal": unit(1.2 * c("_debate") + 0.4 * _input(paras, "debate_similarity")),
        "_blend": unit(0.5 * c("constructiveness_score") + 0.25 * c("reasoning_marker_score")
                       + 0.15 * c("explanation_depth_score") + 0.10 * c("discourse_score")),
    })
    calm = c("effective_toxicity") <= 0.12
    step3 = step2.withColumns({
        "respect_signal": unit(0.78 * (1.0 - c("effective_toxicity")) + 0.12 * c("_civil")
                               + 0.1 * (1.0 - c("abuse_signal"))),
        "_constructive0": F.when(c("explanation_depth_score") >= 0.4, F.greatest(c("_blend"), F.lit(0.55)))
        .otherwise(c("_blend")),
    })
    step4 = step3.withColumn("fan_sincerity_signal", unit(
        0.52 * c("_fan") + 0.23 * unit(c("joy") + c("love") + 0.7 * c("positive"))
        + 0.15 * c("_constructive0") + 0.1 * _input(paras, "sincerity_similarity")))
    # protection floors: each applies on top of the others, so the greatest one wins
    reasoned = ((c("reasoning_marker_score") >= 0.14) & (c("explanation_depth_score") >= 0.2)
                & (c("respect_signal") >= 0.65) & calm)
    helpful = (c("suggestion_score") >= 0.5) & (c("respect_signal") >= 0.72) & calm
    narrated = ((c("discourse_score") >= 0.45) & (c("sentence_count") >= 4)
                & (c("explanation_depth_score") >= 0.3) & calm & (c("fan_sincerity_signal") >= 0.3))
    floored = F.greatest(c("_constructive0"), F.when(reasoned, 0.65).otherwise(0.0),
                         F.when(narrated, 0.6).otherwise(0.0), F.when(helpful, 0.58).otherwise(0.0))
    debated = ((c("debate_style_score") >= 0.4) & (c("respect_signal") >= 0.68)
               & (c("effective_toxicity") <= 0.15))
    step5 = step4.withColumn("constructive_signal", F.when(
        debated, unit(floored + 0.05 * c("debate_style_score"))).otherwise(floored))
    pattern = (((c("reasoning_marker_score") >= 0.12) | (c("analytical_signal") >= 0.45)
                | (c("explanation_depth_score") >= 0.5))
               & ((c("suggestion_score") >= 0.15) | (c("constructiveness_score") >= 0.48))
               & (c("respect_signal") >= 0.68) & (c("effective_toxicity") <= 0.15))
    bonus = F.least(F.lit(0.2), c("negativity") * c("constructive_signal") * 0.28)
    body = unit(0.44 * c("constructive_signal") + 0.24 * unit(0.55 * c("respect_signal") + 0.45 * c("clarity_signal"))
                + 0.2 * c("analytical_signal") + 0.12 * bonus)
    return step5.select(
        *keep, "sentence_count", "word_count",
        *[F.col(m) for m in MODEL_COLUMNS],
        unit(c("toxic")).alias("model_toxicity"), "abuse_signal", "effective_toxicity", "negativity",
        *DETECTOR, "constructive_signal", "analytical_signal", "debate_balance_signal", "respect_signal",
        "clarity_signal", "fan_sincerity_signal", pattern.alias("constructive_pattern"),
        (COMPONENT_MAX["constructiveness"] * body).alias("constructiveness"),
        (COMPONENT_MAX["respectfulness"] * c("respect_signal")).alias("respectfulness"),
        (COMPONENT_MAX["analytical_tone"]
         * unit(0.85 * c("analytical_signal") + 0.15 * c("debate_balance_signal"))).alias("analytical_tone"),
        (COMPONENT_MAX["clarity"] * c("clarity_signal")).alias("clarity"),
        (COMPONENT_MAX["fan_sincerity"] * c("fan_sincerity_signal")).alias("fan_sincerity"),
    )


def paragraph_means() -> list[Column]:
    """Aggregates that fold paragraph components into document means."""
    mean = {
        **{k: k for k in COMPONENT_MAX},
        "mean_negativity": "negativity", "mean_sentiment_positive": "positive",
        "mean_sentiment_neutral": "neutral", "mean_sentiment_negative": "negative",
        "mean_reasoning": "reasoning_marker_score", "mean_suggestion": "suggestion_score",
        "mean_depth": "explanation_depth_score", "mean_strategic": "strategic_score",
        "mean_discourse": "discourse_score", "mean_debate_style": "debate_style_score",
        "mean_respect": "respect_signal", "mean_word_count": "word_count",
        "mean_sentence_count": "sentence_count", "mean_constructive": "constructive_signal",
        "toxicity_mean": "effective_toxicity", "abuse_mean": "abuse_signal",
    }
    return [
        *[F.coalesce(F.avg(src), F.lit(0.0)).alias(name) for name, src in mean.items()],
        F.coalesce(F.max("effective_toxicity"), F.lit(0.0)).alias("toxicity_max"),
        F.coalesce(F.avg((F.col("effective_toxicity") > 0.55).cast("double")), F.lit(0.0)).alias("toxicity_ratio"),
        F.coalesce(F.avg(F.col("constructive_pattern").cast("double")), F.lit(0.0))
        .alias("constructive_pattern_ratio"),
        # diagnostics keep four digits, and the detector mean is taken over those
        F.coalesce(F.avg(nu.rounded(F.col("constructiveness_score"), 4)), F.lit(0.0)).alias("detector_mean"),
    ]


def aggregate_paragraphs(components: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    return components.groupBy(*by).agg(*paragraph_means())
