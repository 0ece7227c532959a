"""Submissions: validate, decide quotas, route scores, summarise writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prosegauge.operators.submissions import quota_decisions, route_scores, validate_submissions


def process_submissions(subs: DataFrame, remote: DataFrame | None, limit: int) -> DataFrame:
    """(id, user_id, ts, text, model) to scored rows; rejected and blocked ones keep a reason."""
    checked = validate_submissions(subs)
    valid = checked.filter("reject_reason IS NULL").drop("reject_reason")
    asked = valid.withColumn("success", F.lit(False)) if remote is None else valid.join(
        remote.select("id", F.col("remote_score").isNotNull().alias("success")), "id", "left").withColumn(
        "success", F.coalesce("success", F.lit(False)))
    decided = quota_decisions(asked, limit)
    allowed = decided.filter("allowed").drop("allowed", "used_before", "success")
    blocked = decided.filter("NOT allowed").drop("allowed", "used_before", "success")
    scored = route_scores(allowed, remote).withColumn("reject_reason", F.lit(None).cast("string"))
    refused = checked.filter("reject_reason IS NOT NULL").unionByName(
        blocked.withColumn("reject_reason", F.lit("quota_exceeded")))
    return scored.unionByName(refused, allowMissingColumns=True)
