"""Submissions, quotas and writer profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prosegauge.functions import text as tx
from prosegauge.functions.numeric import clip
from prosegauge.lexicons import LEXICON, WRITING_STYLES
from prosegauge.operators.scale import chunked, join_null_safe, running, top_per_group
from prosegauge.session import checkpointed

c = F.col
MODELS = ["eqs", "bqs", "hybrid"]


# --- validation and scoring ---------------------------------------------------------

def validate_submissions(df: DataFrame, text: str = "text", model: str = "model") -> DataFrame:
    """Add ``reject_reason`` (NULL = accepted): length 10-5000 and a known model."""
    n = F.char_length(F.coalesce(c(text), F.lit("")))
    return df.withColumn("reject_reason", F.when(n < 10, "text_too_short").when(n > 5000, "text_too_long")
                         .when(~F.coalesce(c(model), F.lit("eqs")).isin(*MODELS), "unknown_model"))


def quick_score(docs: DataFrame, lex: Mapping[str, list[str]] = LEXICON, text: str = "text") -> DataFrame:
    """Keyword score around 50 with its component map; stateless, so it runs on streams too."""
    low = F.lower(F.coalesce(c(text), F.lit("")))

    def when(name: str, points: float) -> Column:
        return F.when(tx.contains_any(low, lex[name]), points).otherwise(0.0)

    raw = (50.0 + when("quick_positive", 12.0) - when("quick_negative", 12.0) + when("quick_topic", 4.0)
           - when("quick_abuse", 10.0))
    scored = docs.withColumn("score", clip(raw, 20.0, 95.0))
    return scored.withColumns({
        "confidence": F.lit(0.72),
        "components": F.struct(
            F.lit("balanced").alias("stance_label"), c("score").alias("stance_score"),
            F.lit(0.72).alias("stance_confidence"), F.lit(False).alias("stats_verified"),
            F.least(F.lit(100.0), c("score") + 3.0).alias("writing_quality_score"),
            F.lit(0.0).alias("toxicity_score"),
            F.least(F.lit(100.0), c("score") + 2.0).alias("constructiveness_score")),
    })


def route_scores(subs: DataFrame, remote: DataFrame | None, key: str = "id", model: str = "model",
                 lex: Mapping[str, list[str]] = LEXICON, remote_version: str = "EQS-remote-v1") -> DataFrame:
    """Local score for ``bqs`` requests, the remote result for others, the local one where that is missing."""
    local = quick_score(subs, lex)
    if remote is None:
        local = local.withColumns({"remote_score": F.lit(None).cast("double"),
                                   "remote_confidence": F.lit(None).cast("double")})
    else:
        local = local.join(remote.select(key, "remote_score", "remote_confidence"), key, "left")
    use_local = F.coalesce(c(model) == "bqs", F.lit(False))
    answered = ~use_local & c("remote_score").isNotNull()
    return local.select(
        *subs.columns,
        F.when(use_local, "EQS-local").when(answered, remote_version).otherwise("EQS-local-fallback")
        .alias("model_version"),
        F.when(answered, clip(c("remote_score"), 20.0, 95.0)).otherwise(c("score")).alias("eqs_score"),
        F.when(answered, F.coalesce(c("remote_confidence"), F.lit(0.5))).otherwise(c("confidence"))
        .alias("confidence"),
        (~use_local & c("remote_score").isNull()).alias("fallback"),
    )


def explain(df: DataFrame) -> DataFrame:
    """Arrays of strengths, concerns and penalties behind a score."""
    confident = F.coalesce(c("stance_confidence") >= 0.5, F.lit(False))
    found = F.coalesce(c("stats_found"), F.lit(False))
    verified = F.coalesce(c("stats_verified"), F.lit(False))
    stat = c("stat_accuracy_component")

    # Sentences of the explanation.
    strengths = [
        F.when(confident, F.format_string("Stance detection is confident (%.2f) with label %s.",
                                          c("stance_confidence"), c("stance_label"))),
        F.when(found & verified, "Statistical claims were verified against historical match data."),
        F.when(c("argument_logic_score") >= 0.5, "Argument logic connectors are strong."),
        F.when(c("evidence_presence_score") >= 0.5, "Evidence and numeric grounding are present."),
        F.when(stat > 0, "Stats component added score due to verified/partially verified claims."),
    ]
    concerns = [
        F.when(~confident, "Stance confidence is moderate/low, so interpretation may be less stable."),
        F.when(found & ~verified, "Statistical claims were found but not fully verified."),
        F.when(~found, "No verifiable numeric stats detected in the text."),
        F.when(c("coherence_score") < 0.4, "Coherence is relatively weak between ideas."),
        F.when(c("repetition_penalty") >= 0.6, "High repetition lowers writing originality."),
    ]
    penalties = [
        F.when(c("toxicity_penalty") < 0, F.format_string(
            "Toxicity penalty applied (%.2f).", c("toxicity_penalty"))),
        F.when(stat < 0, "Stats component reduced score due to incorrect claims."),
    ]

    def listed(items: list[Column], default: str) -> Column:
        kept = F.array_compact(F.array(*items))
        return F.when(F.size(kept) == 0, F.array(F.lit(default))).otherwise(kept)

    return df.withColumns({
        "strengths": listed(strengths, "Writing shows mixed traits without a dominant positive signal."),
        "concerns": listed(concerns, "No major concerns were detected by the current deterministic rules."),
        "penalties": listed(penalties, "No explicit penalties applied beyond baseline shaping."),
    })


# --- quotas -----------------------------------------------------------------------------

def month_of(ts: str) -> Column:
    return F.date_trunc("month", c(ts))


def quota_state(used: Column, limit: int, warn: float = 0.8) -> Column:
    return (F.when(used >= limit, "blocked")
            .when((used / limit * 100.0 if limit else F.lit(0.0)) >= warn * 100, "warning").otherwise("active"))


def quota_status(requests: DataFrame, limit: int, users: DataFrame | None = None, warn: float = 0.8,
                 days: int = 30, user: str = "user_id", ts: str = "ts", success: str = "success",
                 model: str = "model") -> DataFrame:
    """Use per (user, model, calendar month). With ``users`` everyone gets a row per seen (model, month)."""
    counted = requests.groupBy(user, model, month_of(ts).alias("period_start")).agg(
        F.count_if(c(success)).alias("request_count"))
    if users is not None:
        periods = requests.select(model, month_of(ts).alias("period_start")).distinct()
        # a handful of (model, month) periods per user: explode a constant array instead of joining
        listed = periods.select(F.collect_set(F.struct(model, "period_start")).alias("p"))
        everyone = users.select(c(user), F.inline(listed.scalar()))
        counted = join_null_safe(everyone, counted, [user, model, "period_start"], "left").withColumn(
            "request_count", F.coalesce("request_count", F.lit(0)))
    used = c("request_count")
    return counted.select(
        user, model, "period_start", (c("period_start") + F.expr(f"INTERVAL {days} DAYS")).alias("period_end"),
        used, F.lit(limit).alias("max_requests"),
        (used / limit * 100.0 if limit else F.lit(0.0)).alias("usage_percentage"),
        (limit - used).alias("requests_remaining"),
        quota_state(used, limit, warn).alias("status"))


def quota_decisions(requests: DataFrame, limit: int, user: str = "user_id", ts: str = "ts", key: str = "id",
                    success: str = "success", model: str = "model") -> DataFrame:
    """Per request: successful remote requests earlier in the month, and whether it may go on.

    Counting successes that come after a user was blocked changes nothing: the
    count has reached the limit by then and never falls inside the month.
    """
    month = requests.withColumns({"_month": month_of(ts), "_counts": (
        c(success) & (F.coalesce(c(model), F.lit("eqs")) != "bqs")).cast("int")})
    placed = running(month, [user, "_month"], [ts, key], sums={"used_before": c("_counts")}, inclusive=False)
    free = F.coalesce(c(model) == "bqs", F.lit(False))
    return placed.withColumn("allowed", free | (c("used_before") < limit)).drop("_month", "_counts")


# --- running averages and profiles ---------------------------------------------------------

def running_average(scores: DataFrame, cols: Sequence[str], user: str = "user_id", ts: str = "ts",
                    key: str = "id", weight: Column | int = 1) -> DataFrame:
    """Add ``n`` and ``avg_<col>`` after every submission. A row of another ``weight`` stands for so many, whose average
    it holds; it must come before all others of its user.

    A NULL score leaves the average but still counts as a submission, so a later
    score x at place n gives avg * (n-1)/n + x/n. That is an affine map; maps
    are composed inside (user, chunk), and the few chunk maps across a user.
    """
    counts = {f"_k_{s}": c(s).isNotNull().cast("int") for s in cols}
    base = running(chunked(scores, [user], [ts, key]), [user], [ts, key], sums={
        "n": weight if isinstance(weight, Column) else F.lit(weight), **counts})
    here = W.partitionBy(user, "_chunk").orderBy(ts, key).rowsBetween(W.unboundedPreceding, 0)
    logs, adds = {}, {}
    for s in cols:
        given, first = c(s).isNotNull(), c(f"_k_{s}") == 1
        step = F.when(given & ~first, F.ln((c("n") - 1) / c("n"))).otherwise(0.0)
        logs[f"_log_{s}"] = F.sum(step).over(here)
        adds[f"_add_{s}"] = F.when(given & first, c(s).cast("double")).when(given, c(s) / c("n")).otherwise(0.0)
    # log of the product of the factors so far, then the discounted sum
    base = base.withColumns({**logs, **adds})
    inside = checkpointed(base.withColumns({f"_sum_{s}": F.sum(c(f"_add_{s}") * F.exp(-c(f"_log_{s}"))).over(here) for s in cols}))
    last = F.struct(ts, key)
    maps = inside.groupBy(user, "_chunk").agg(
        *[F.max_by(f"_log_{s}", last).alias(f"_l_{s}") for s in cols], *[F.max_by(f"_sum_{s}", last).alias(f"_s_{s}") for s in cols])
    earlier = W.partitionBy(user).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    maps = maps.withColumns({f"_before_{s}": F.coalesce(F.sum(f"_l_{s}").over(earlier), F.lit(0.0)) for s in cols})
    maps = maps.select(user, "_chunk", *[f"_before_{s}" for s in cols], *[
        F.coalesce(F.sum(c(f"_s_{s}") * F.exp(-c(f"_before_{s}"))).over(earlier), F.lit(0.0)).alias(f"_carry_{s}") for s in cols])
    base = join_null_safe(inside, maps, [user, "_chunk"])
    out = {f"avg_{s}": F.when(c(f"_k_{s}") > 0, (c(f"_carry_{s}") + c(f"_sum_{s}") * F.exp(-c(f"_before_{s}")))
                              * F.exp(c(f"_log_{s}") + c(f"_before_{s}"))) for s in cols}
    return base.select(*scores.columns, "n", *[e.alias(n) for n, e in out.items()])


def with_reputation(averaged: DataFrame, avg: str = "avg_eqs_score", user: str = "user_id", ts: str = "ts",
                    key: str = "id") -> DataFrame:
    """Running maximum of int(average * submissions / 10)."""
    # nudge by 1e-9 so that floating noise below a whole number does not cost a point
    points = F.floor(F.coalesce(c(avg), F.lit(0.0)) * c("n") / 10.0 + 1e-9)
    return running(averaged, [user], [ts, key], maxima={"reputation_points": points})


def writer_profiles(scores: DataFrame, user: str = "user_id", ts: str = "ts", key: str = "id",
                    style: str = "stance_label", styles: Sequence[str] = WRITING_STYLES,
                    null_free: bool = False) -> DataFrame:
    """Profile per user: submissions, averages, latest recognised style, reputation.

    ``null_free`` promises that no score is NULL; the averages are then plain
    means and one hash aggregate after the prefix sums is enough.
    """
    cols = [x for x in ("eqs_score", "bqs_score") if x in scores.columns]
    if null_free:
        averaged = running(scores, [user], [ts, key], sums={"n": F.lit(1), **{f"_s_{x}": c(x).cast("double") for x in cols}})
        averaged = averaged.withColumns({f"avg_{x}": c(f"_s_{x}") / c("n") for x in cols})
    else:
        averaged = running_average(scores, cols, user, ts, key)
    order = F.struct(ts, key)
    points = F.floor(F.coalesce(c("avg_eqs_score"), F.lit(0.0)) * c("n") / 10.0 + 1e-9)
    known = F.when(c(style).isin(*styles), c(style)) if style in scores.columns else F.lit(None).cast("string")
    return averaged.groupBy(user).agg(
        F.max("n").alias("total_submissions"),
        *[F.max_by(f"avg_{x}", order).alias(f"avg_{x}") for x in cols],
        F.max_by(known, F.when(known.isNotNull(), order)).alias("writing_style"),
        F.max(points).alias("reputation_points"),
        F.max(ts).alias("last_scored_at"),
    )


def profile_state(scores: DataFrame, before: DataFrame | None = None, user: str = "user_id", ts: str = "ts",
                  key: str = "id", style: str = "stance_label", styles: Sequence[str] = WRITING_STYLES) -> DataFrame:
    """Profiles after ``scores``, from the profiles ``before`` them, without the rows these were made of.

    The columns of ``writer_profiles``, and with ``last_key`` all that the next call needs: a user's history goes on as
    one row that holds count and average, from which the new rows' affine maps are composed, and the greatest reputation
    so far. New rows must be later, by time and key, than the user's last one; an earlier one is an error. Users without
    new rows keep their row as it is, and it is not looked into.
    """
    cols = [x for x in ("eqs_score", "bqs_score") if x in scores.columns]
    named = c(style) if style in scores.columns else F.lit(None).cast("string")
    rows = scores.select(user, ts, key, named.alias("_style"), *cols, F.lit(1).cast("long").alias("_times"), F.lit(None).cast("long").alias("_most"))
    idle = None
    if before is not None:
        users = scores.select(user).distinct()
        idle = before.join(users, before[user].eqNullSafe(users[user]), "left_anti")
        kept = before.join(users, before[user].eqNullSafe(users[user]), "left_semi").select(
            user, c("last_scored_at").alias(ts), c("last_key").alias(key), c("writing_style").alias("_style"), *[c(f"avg_{x}").alias(x) for x in cols],
            c("total_submissions").cast("long").alias("_times"), c("reputation_points").alias("_most"))
        rows = rows.unionByName(kept)
    averaged = running_average(rows, cols, user, ts, key, c("_times"))
    order = F.struct(ts, key)
    points = F.floor(F.coalesce(c("avg_eqs_score"), F.lit(0.0)) * c("n") / 10.0 + 1e-9)
    known = F.when(c("_style").isin(*styles), c("_style"))
    early = c("_most").isNotNull() & (c("n") != c("_times"))
    count = F.when(F.max(early), F.raise_error(F.lit("a new row is earlier than its user's profile"))).otherwise(F.max("n"))
    out = averaged.groupBy(user).agg(
        count.alias("total_submissions"), *[F.max_by(f"avg_{x}", order).alias(f"avg_{x}") for x in cols],
        F.max_by(known, F.when(known.isNotNull(), order)).alias("writing_style"),
        F.max(F.greatest(points, "_most")).alias("reputation_points"), F.max(ts).alias("last_scored_at"),
        F.max_by(key, order).alias("last_key"))
    return out if idle is None else out.unionByName(idle.select(*out.columns))


def topic_affinity(submissions: DataFrame, communities: DataFrame, user: str = "user_id", ts: str = "ts",
                   key: str = "id", keep: int = 5) -> DataFrame:
    """First ``keep`` topics per user in order of first appearance in their communities."""
    listed = communities.select(
        c("id").alias("community_id"),
        F.array_compact(F.concat(F.array("primary_topic"), F.coalesce(
            "secondary_topics", F.array().cast("array<string>")))).alias("_topics"))
    # a community has few topics: first sightings per (user, community) shrink the data before the join
    sighted = submissions.filter(c("community_id").isNotNull()).groupBy(user, "community_id").agg(
        F.min(F.struct(ts, key)).alias("_at"))
    topics = sighted.join(listed, "community_id").select(user, "_at", F.posexplode("_topics").alias("_pos", "topic"))
    first = topics.groupBy(user, "topic").agg(F.min(F.struct("_at", "_pos")).alias("_first"))
    best = top_per_group(first, [user], [c("_first").asc()], keep)
    # at most ``keep`` rows per user are left to collect
    return best.groupBy(user).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_rank", "topic"))), lambda e: e["topic"]).alias("primary_topics"))


def scoring_history(scores: DataFrame, user_id: object, limit: int = 20, offset: int = 0, user: str = "user_id",
                    ts: str = "ts", key: str = "id") -> DataFrame:
    """Newest-first page of one user's history; take-ordered, not a full sort."""
    return (scores.filter(c(user) == user_id).orderBy(c(ts).desc(), c(key)).offset(offset).limit(limit))


def history_summary(scores: DataFrame, user: str = "user_id") -> DataFrame:
    return scores.groupBy(user).agg(
        F.count(F.lit(1)).alias("total_submissions"), F.avg("eqs_score").alias("avg_eqs_score"),
        F.avg("confidence").alias("avg_confidence"))
