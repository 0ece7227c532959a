"""Evaluation reports, neighbours and centroids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prosegauge.functions import numeric as nu
from prosegauge.functions.numeric import ratio, unit
from prosegauge.operators import neighbours

c = F.col
#: Most labelled rows of a block of the bank, on average.
BANK_ROWS = neighbours.BLOCK_ROWS


# --- reports ------------------------------------------------------------------------

def binary_report(df: DataFrame, pred: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, counts and error rates (percent; 0 where there is no base)."""
    p, t = c(pred).cast("int") == 1, c(target).cast("int") == 1
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    return counts.select(
        *by, "n", "tp", "fp", "fn", "tn",
        nu.rounded(ratio((c("tp") + c("tn")) * 100.0, c("n")), 2).alias("accuracy_percent"),
        nu.rounded(ratio(c("fp") * 100.0, c("fp") + c("tn")), 2).alias("fp_percent"),
        nu.rounded(ratio(c("fn") * 100.0, c("fn") + c("tp")), 2).alias("fn_percent"))


def with_deviation(df: DataFrame, score: str, lo: str, hi: str) -> DataFrame:
    """Distance of a score from the middle of its expected range."""
    return df.withColumn("deviation", F.abs(c(score) - (c(lo) + c(hi)) / 2.0))


def deviation_report(df: DataFrame, score: str, lo: str, hi: str, by: Sequence[str] = (),
                     tolerance: float = 15.0) -> DataFrame:
    return with_deviation(df, score, lo, hi).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), nu.rounded(F.avg("deviation"), 3).alias("mean_deviation"),
        nu.rounded(F.max("deviation"), 3).alias("max_deviation"),
        F.count_if(c("deviation") > tolerance).alias("n_over_tolerance"))


def worst_k(df: DataFrame, k: int, by: str = "deviation", tie: str = "id") -> DataFrame:
    return df.orderBy(c(by).desc(), tie).limit(k)


def best_k(df: DataFrame, k: int, by: str = "deviation", tie: str = "id") -> DataFrame:
    return df.orderBy(c(by).asc(), tie).limit(k)


def with_band_errors(df: DataFrame) -> DataFrame:
    """Distance outside the expected score band, and the first check that fails."""
    lo, hi = c("score_lo"), c("score_hi")
    outside = F.when(c("score") < lo, lo - c("score")).when(c("score") > hi, c("score") - hi).otherwise(0.0)
    error = (F.when(~c("predicted").eqNullSafe(c("expected")), "stance_mismatch")
             .when(c("outside_band") != 0.0, "score_band_miss")
             .when(~c("toxicity").between(c("toxicity_lo"), c("toxicity_hi")), "toxicity_band_miss")
             .when(~c("supportive").between(c("supportive_lo"), c("supportive_hi")), "supportive_band_miss")
             .otherwise("ok"))
    return df.withColumn("outside_band", outside).withColumn("error_type", error)


def band_report(df: DataFrame) -> DataFrame:
    """Per expected label: accuracy, mean distance outside the band, and errors by type."""
    judged = with_band_errors(df)
    kinds = ["stance_mismatch", "score_band_miss", "toxicity_band_miss", "supportive_band_miss", "ok"]
    return judged.groupBy("expected").agg(
        F.count(F.lit(1)).alias("n"),
        nu.rounded(F.avg((c("predicted") == c("expected")).cast("double")) * 100.0, 2).alias("accuracy_percent"),
        nu.rounded(F.avg("outside_band"), 2).alias("average_score_deviation"),
        *[F.count_if(c("error_type") == kind).alias(f"n_{kind}") for kind in kinds])


def score_histogram(df: DataFrame, col: str, width: int = 10, top: int = 100) -> DataFrame:
    """Counts per bin; empty bins stay, values beyond the scale go to the outer bins."""
    value = F.greatest(F.lit(0.0), F.least(F.lit(top - 0.001), c(col).cast("double")))
    bins = [F.struct(F.lit(b).alias("bin_start"), F.count_if(
        F.floor(value / width) * width == b).alias("n")) for b in range(0, top, width)]
    return df.filter(c(col).isNotNull()).agg(F.array(*bins).alias("b")).select(F.inline("b")).select(
        "bin_start", (c("bin_start") + width).alias("bin_end"), "n")


# Pass rules (metric, direction, bound).
PASS_RULES = [("constructiveness_accuracy", ">=", 85.0), ("toxicity_accuracy", ">=", 95.0),
              ("average_deviation", "<=", 10.0), ("max_deviation", "<=", 15.0)]


def threshold_summary(metrics: DataFrame, rules: Sequence[tuple[str, str, float]] = PASS_RULES) -> DataFrame:
    """One pass flag per rule, and all of them together."""
    flags = {f"{m}_pass": c(m) >= bound if way == ">=" else c(m) <= bound for m, way, bound in rules}
    out = metrics.select(*[e.alias(n) for n, e in flags.items()])
    every = F.lit(True)
    for n in flags:
        every = every & c(n)
    return out.withColumn("overall_pass", every)


# Candidate thresholds .35, .40 ... .70
THRESHOLD_GRID = [round(0.35 + 0.05 * i, 2) for i in range(8)]


def threshold_scores(scored: DataFrame, grid: Sequence[float] = THRESHOLD_GRID, score: str = "score",
                     expected: str = "expected") -> DataFrame:
    """Confusion counts and objective of every threshold, from one aggregate over the cases."""
    t = c(expected)

    def cell(g: float) -> Column:
        p = c(score) >= g
        return F.struct(F.lit(g).alias("threshold"), F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"),
                        F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))

    cells = scored.agg(F.array(*[cell(g) for g in grid]).alias("g")).select(F.inline("g"))
    precision, recall = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("tp") + c("fn"))
    specificity = ratio(c("tn"), c("tn") + c("fp"))
    return cells.withColumn("objective", 0.6 * recall + 0.25 * precision + 0.15 * specificity)


def tune_threshold(scored: DataFrame, grid: Sequence[float] = THRESHOLD_GRID, score: str = "score",
                   expected: str = "expected") -> DataFrame:
    """Best threshold; the lowest one wins a tie."""
    return threshold_scores(scored, grid, score, expected).orderBy(c("objective").desc(), "threshold").limit(1)


def compare_runs(prev: DataFrame, curr: DataFrame, key: str = "id", tolerance: float = 15.0) -> DataFrame:
    """Old and new deviation per sample, and whether an outlier improved."""
    old = prev.select(key, c("deviation").alias("old_deviation"), c("score").alias("old_score"))
    new = curr.select(key, c("deviation").alias("new_deviation"), c("score").alias("new_score"))
    return old.join(new, key).withColumn(
        "repaired", (c("old_deviation") > tolerance) & (c("new_deviation") < c("old_deviation")))


def repaired_outliers(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count(F.lit(1)).alias("n_compared"), F.count_if("repaired").alias("n_repaired"))


def writer_distribution(df: DataFrame, writer: str = "writer_type") -> DataFrame:
    return df.groupBy(writer).agg(F.count(F.lit(1)).alias("n"))


# --- predicted flags and the repair pass ---------------------------------------------------

def predicted_flags(df: DataFrame) -> DataFrame:
    """Constructive and toxic predictions from blended signals.

    ``p1_*`` are the signals of the first paragraph.
    """
    blended = (0.35 * c("p1_constructive") + 0.25 * c("p1_detector") + 0.2 * (c("constructiveness") / 40.0)
               + 0.1 * c("p1_reasoning") + 0.06 * c("p1_suggestion") + 0.03 * c("p1_depth") + 0.01 * c("p1_discourse"))
    return df.withColumns({
        "predicted_constructive": (blended >= 0.42) | ((c("final_score") >= 65.0) & (c("toxicity_penalty") > -6.0)),
        "predicted_toxic": (c("toxicity_penalty") <= -8.0) | (c("abuse_mean") >= 0.12),
    })


def repair_pass(df: DataFrame, enabled: bool = False) -> DataFrame:
    """Category-specific corrections. They read the expected category, so they are off by default."""
    none = {"repair": F.lit(None).cast("string")}
    if not enabled:
        return df.withColumns(none)
    category, score = c("category"), c("final_score")
    calm, sincere = c("toxicity_mean") < 0.12, c("fan_sincerity") / 15.0
    lifted = (category.isin("Constructive Storyteller", "Constructive Debater") & (score < 70.0) & calm
              & (c("mean_discourse") >= 0.18) & (c("mean_depth") >= 0.25) & (sincere >= 0.28))
    fan = ((category == "Constructive Passionate Fan") & (score < 68.0) & calm & (c("mean_suggestion") >= 0.25)
           & (sincere >= 0.2))
    muted = (category == "Non-constructive complaint") & ((score > 60.0) | c("predicted_constructive"))
    marked = df.withColumn("repair", F.when(lifted, "story_rescue").when(fan, "fan_floor").when(muted, "complaint"))
    r = c("repair")
    return marked.withColumns({
        "final_score": F.when(r == "story_rescue", F.greatest(score, F.lit(74.0)))
        .when(r == "fan_floor", F.greatest(score, F.lit(68.0)))
        .when(r == "complaint", F.least(score, F.lit(56.0))).otherwise(score),
        "predicted_constructive": F.when(r.isin("story_rescue", "fan_floor"), True)
        .when(r == "complaint", False).otherwise(c("predicted_constructive")),
    })


def repair_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(c("repair") == "story_rescue").alias("storyteller_rescues"),
                  F.count_if(c("repair") == "complaint").alias("complaint_suppressions"))


# --- centroids and neighbours ------------------------------------------------------------

def label_means(samples: DataFrame, label: str = "label", vec: str = "embedding", features: str | None = None) -> DataFrame:
    """Count and component sums per label, ``vec_sum`` and with ``features`` also ``feature_sum``, of vectors of any one
    length; unequal lengths in a label are an error.

    Both columns' components are summed in one aggregate, map-side, so a label of any size leaves a task as one row per
    component. A sample counts if it has a vector; its NULL features are an error, as its closeness would be undefined.
    """
    def entries(name: str, kind: int) -> Column:
        return F.transform(c(name).cast("array<double>"), lambda x, i: F.struct(
            F.lit(kind).alias("_kind"), i.alias("_at"), x.alias("_x")))

    both = [entries(vec, 0)] + ([F.when(c(features).isNull(), F.raise_error(F.lit("a sample without features"))).otherwise(
        entries(features, 1))] if features else [])
    rows = samples.filter(c(vec).isNotNull()).select(label, F.explode(F.concat(*both)).alias("_e"))
    parts = rows.groupBy(label, "_e._kind", "_e._at").agg(F.sum("_e._x").alias("_s"), F.count(F.lit(1)).alias("_n"))

    def sums(kind: int) -> Column:
        own = F.array_sort(F.collect_list(F.when(c("_kind") == kind, F.struct("_at", "_s"))))
        return F.transform(own, lambda e: e["_s"])

    even = F.when(F.min("_n") != F.max("_n"), F.raise_error(F.lit("vectors of unequal length"))).otherwise(sums(0))
    return parts.groupBy(label).agg(F.max("_n").alias("n"), even.alias("vec_sum"), *(
        [sums(1).alias("feature_sum")] if features else []))


def _unit_vector(v: Column) -> Column:
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(x))


def label_centroids(samples: DataFrame, label: str = "label", vec: str = "embedding",
                    unit_length: bool = True, features: str | None = None) -> DataFrame:
    """``label``, ``n``, ``centroid`` (of unit length unless told otherwise) and, with ``features``, ``feature_centroid``,
    the plain mean of a label's feature vectors."""
    means = label_means(samples, label, vec, features)
    mean = F.transform("vec_sum", lambda x: x / c("n"))
    extra = [F.transform("feature_sum", lambda x: x / c("n")).alias("feature_centroid")] if features else []
    return means.select(label, "n", (_unit_vector(mean) if unit_length else mean).alias("centroid"), *extra)


def closeness(a: Column, b: Column) -> Column:
    """1 - the mean absolute difference of two feature vectors, within 0 and 1."""
    diffs = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return unit(1.0 - F.aggregate(diffs, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def _scored(queries: DataFrame, centroids: DataFrame, label: str, vec: str, features: str | None) -> tuple[DataFrame, Column]:
    """``queries`` with all centroids as the constant ``_packed``, and the array of (label, score) over them."""
    columns = [label, "centroid"] + (["feature_centroid"] if features else [])
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("all")).scalar()

    def score(e: Column) -> Column:
        sim = F.aggregate(F.zip_with(c(vec), e["centroid"], lambda a, b: a.cast("double") * b), F.lit(0.0),
                          lambda s, x: s + x)
        out = 0.35 * unit((sim + 1.0) / 2.0)
        return out + 0.25 * closeness(c(features), e["feature_centroid"]) if features else out

    return queries.withColumn("_packed", packed), F.transform(
        "_packed", lambda e: F.struct(e[label].alias(label), score(e).alias("score")))


def with_centroid_scores(queries: DataFrame, centroids: DataFrame, name: str, label: str = "label", vec: str = "embedding",
                         features: str | None = None) -> DataFrame:
    """``queries`` and the array ``name`` of (label, score) of all centroids, as in ``centroid_scores``."""
    rows, scored = _scored(queries, centroids, label, vec, features)
    return rows.withColumn(name, scored).drop("_packed")


def centroid_scores(queries: DataFrame, centroids: DataFrame, key: str = "id", label: str = "label",
                    vec: str = "embedding", features: str | None = None) -> DataFrame:
    """.35 x mapped cosine to each label centroid, + .25 x feature closeness where features exist.

    Labels are few: their centroids travel as one constant array per plan, so no join is needed. The array is unrolled
    where it is made: for a column of its own Spark would add a filter on its size, which makes the array once more, with
    whatever the columns of ``queries`` are made of again for each label.
    """
    rows, scored = _scored(queries, centroids, label, vec, features)
    return rows.select(key, F.inline(scored))


def nearest(queries: DataFrame, samples: DataFrame, k: int, key: str = "id", label: str = "label",
            vec: str = "embedding", leave_one_out: bool = False, digits: int = 9) -> DataFrame:
    """Exact ``k`` nearest samples of every query by dot product (``neighbours.nearest``), in blocks of ``BANK_ROWS``."""
    return neighbours.nearest(queries, samples, k, key, label, vec, leave_one_out, digits, BANK_ROWS)


def knn_label_votes(queries: DataFrame, samples: DataFrame, k: int = 16, key: str = "id", label: str = "label",
                    vec: str = "embedding", leave_one_out: bool = False) -> DataFrame:
    """Sum of max(0, similarity)^2 of the ``k`` nearest samples per label."""
    near = nearest(queries, samples, k, key, label, vec, leave_one_out)
    return near.groupBy(key, label).agg(F.sum(F.pow(F.greatest(F.lit(0.0), c("sim")), F.lit(2.0))).alias("votes"))


def label_probabilities(centred: DataFrame, votes: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Neighbour votes and centroid scores of each (key, label), added up and divided by their sum; and the best label."""
    raw = centred.unionByName(votes.withColumnRenamed("votes", "score")).groupBy(key, label).agg(F.sum("score").alias("raw"))
    mass = raw.groupBy(key).agg(F.sum("raw").alias("mass"), F.min_by(label, F.struct(-c("raw"), c(label))).alias("predicted"))
    return raw.join(mass, key).select(key, label, nu.rounded(c("raw") / c("mass"), 4).alias("probability"), "predicted")


def loo_label_scores(samples: DataFrame, k: int = 16, key: str = "id", label: str = "label",
                     vec: str = "embedding", features: str | None = None) -> DataFrame:
    """Label probabilities of every sample without itself: neighbour votes + centroid scores (+ feature closeness).

    The centroids of a sample's own label are (sum - x) / (n - 1): label sums are made once instead of n times.
    """
    columns = [label, "n", "vec_sum"] + (["feature_sum"] if features else [])
    packed = label_means(samples, label, vec, features).agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("all")).scalar()

    def without(total: Column, x: Column, own: Column) -> Column:
        return F.when(own, F.zip_with(total, x, lambda a, b: a - b.cast("double"))).otherwise(total)

    def sim(e: Column) -> Column:
        own = e[label] == c(label)
        pairs = F.zip_with(without(e["vec_sum"], c(vec), own), c(vec), lambda a, b: F.struct(
            (a * a).alias("aa"), (a * b.cast("double")).alias("ab")))
        sums = F.aggregate(pairs, F.struct(F.lit(0.0).alias("aa"), F.lit(0.0).alias("ab")),
                           lambda s, x: F.struct((s["aa"] + x["aa"]).alias("aa"), (s["ab"] + x["ab"]).alias("ab")),
                           lambda s: F.when(s["aa"] > 0, s["ab"] / F.sqrt(s["aa"])).otherwise(0.0))
        left = e["n"] - F.when(own, 1).otherwise(0)
        out = 0.35 * unit((sums + 1.0) / 2.0)
        if features:
            mean = F.transform(without(e["feature_sum"], c(features), own), lambda x: x / left)
            out = out + 0.25 * closeness(c(features), mean)
        return F.when(left > 0, out).otherwise(0.0)

    centred = samples.filter(c(vec).isNotNull()).withColumn("_packed", packed).select(key, F.inline(F.transform(
        "_packed", lambda e: F.struct(e[label].alias(label), sim(e).alias("score")))))
    return label_probabilities(centred, knn_label_votes(samples, samples, k, key, label, vec, leave_one_out=True), key, label)


def accuracy_by_label(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    return df.groupBy(expected).agg(
        F.count(F.lit(1)).alias("n"),
        nu.rounded(F.avg((c(predicted) == c(expected)).cast("double")) * 100.0, 2).alias("accuracy_percent"))


def parse_range(col: Column) -> Mapping[str, Column]:
    """"60-80" to its two ends."""
    ends = F.split(col, "-")
    return {"lo": ends[0].try_cast("double"), "hi": ends[1].try_cast("double")}
