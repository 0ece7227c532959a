"""Label, split, rebalance and describe corpora."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prosegauge.functions import text as tx
from prosegauge.functions.numeric import any_of, r2, r4
from prosegauge.lexicons import (
    LABEL_BANDS, LEXICON, PATTERNS, REBALANCE_VARIANTS, STANCES, TARGET_SENTIMENT_BASE,
)
from prosegauge.operators.scale import group_rank, hash_order, join_null_safe


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)


def stratified_split(df: DataFrame, label: str, key: str, ratio: float = 0.8, seed: int = 42,
                     digits: int = 3) -> DataFrame:
    """Add ``split`` in {train, test} with exact per-class counts.

    A class is shuffled by hash. Only the one hash prefix per class that holds
    the cut has to be ranked; every other row is decided by comparing its
    prefix, without a shuffle of its own.
    """
    base = (df.withColumn("_hash", hash_order(F.col(key), seed))
            .withColumn("_prefix", F.substring("_hash", 1, digits)))
    counts = base.groupBy(label, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    name = F.coalesce(F.col(label).cast("string"), F.lit("\u0000"))
    by_label = W.partitionBy(label)
    size = F.sum("_n").over(by_label)
    upto = F.sum("_n").over(by_label.orderBy("_prefix").rowsBetween(W.unboundedPreceding, 0))
    # round() of a positive half goes to the even neighbour, as bround does
    wanted = F.when(size > 1, F.least(F.greatest(F.bround(size * ratio).cast("bigint"), F.lit(1)), size - 1))
    cuts = (counts.select(label, "_prefix", "_n", upto.alias("_upto"), F.coalesce(wanted, F.lit(1)).alias("_want"))
            .filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
            .select(name.alias("_key"), F.struct(F.col("_prefix").alias("cut"), (
                F.col("_want") - F.col("_upto") + F.col("_n")).alias("take")).alias("_at")))
    # one entry per class: looked up as a constant, so that rows are not shuffled by a class that may be hot
    table = cuts.agg(F.map_from_entries(F.collect_list(F.struct("_key", "_at")))).scalar()
    placed = base.withColumn("_at", F.element_at(table, name)).select(
        *base.columns, F.col("_at.cut").alias("_cut"), F.col("_at.take").alias("_take"))
    at_cut = placed.filter(F.col("_prefix") == F.col("_cut"))
    inside = W.partitionBy(label, "_prefix").orderBy("_hash", key)
    ranked = at_cut.withColumn("split", F.when(F.row_number().over(inside) <= F.col("_take"), "train")
                               .otherwise("test"))
    clear = (placed.filter(F.col("_prefix") != F.col("_cut"))
             .withColumn("split", F.when(F.col("_prefix") < F.col("_cut"), "train").otherwise("test")))
    return clear.unionByName(ranked).select(*df.columns, "split")


def split_manifest(df: DataFrame, label: str, split: str = "split", seed: int = 42) -> DataFrame:
    """One row: totals, and label -> count maps of both splits (one entry per class)."""
    per_class = df.groupBy(label).agg(
        F.count_if(F.col(split) == "train").alias("n_train"), F.count_if(F.col(split) == "test").alias("n_test"))

    def as_map(n: str) -> Column:
        entry = F.when(F.col(n) > 0, F.struct(F.col(label), F.col(n)))
        return F.map_from_entries(F.sort_array(F.collect_list(entry)))

    return per_class.agg(
        (F.sum("n_train") + F.sum("n_test")).alias("total_rows"),
        F.sum("n_train").alias("train_rows"),
        F.sum("n_test").alias("test_rows"),
        as_map("n_train").alias("class_distribution_train"),
        as_map("n_test").alias("class_distribution_test"),
        F.lit(seed).alias("random_seed_used"),
    )


def class_split_counts(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    return df.groupBy(label).agg(
        F.count_if(F.col(split) == "train").alias("n_train"), F.count_if(F.col(split) == "test").alias("n_test"))


def rebalance(df: DataFrame, label: str, key: str, target: int, text: str = "text",
              labels: Sequence[str] | None = STANCES, seed: int = 42,
              variants: Sequence[tuple[str, str]] = REBALANCE_VARIANTS) -> DataFrame:
    """Exactly ``target`` rows per class that occurs: hash-sampled or topped up with text variants.

    ``id`` numbers rows class by class, in the declared label order if given.
    """
    ordered = df.withColumn("_hash", F.concat(hash_order(F.col(key), seed), F.col(key).cast("string")))
    ranked = group_rank(ordered, label, "_hash", upto=target)
    size = F.col("_size")
    # copy number j fills place j (0-based); a row of rank r supplies places r + n, r + 2n, ...
    place = F.col("_rank") - 1
    copies = F.when(place + size < target, F.sequence(place + size, F.lit(target - 1).cast("bigint"), size))
    spread = ranked.withColumn("_place", F.explode(F.concat(F.array(place), F.coalesce(
        copies, F.array().cast("array<bigint>")))))
    extra = F.col("_place") >= size
    variant = F.pmod(F.col("_place"), F.lit(len(variants)))
    before = F.element_at(F.array(*[F.lit(b) for b, _ in variants]), (variant + 1).cast("int"))
    after = F.element_at(F.array(*[F.lit(a) for _, a in variants]), (variant + 1).cast("int"))
    varied = F.concat(before, tx.strip(F.col(text)), after)
    source = F.col("source") if "source" in df.columns else F.lit("original")
    made = spread.select(
        *[c for c in df.columns if c not in (text, "source", "id")],
        F.when(extra, varied).otherwise(F.col(text)).alias(text),
        F.when(extra, "synthetic_balance").otherwise(source).alias("source"),
        F.col("_place"),
    )
    # class sizes after balancing are min(n, target) topped up to target: always target rows
    names = df.select(label).distinct() if labels is None else df.select(label).distinct().filter(
        F.col(label).isin(*labels))
    position = F.col(label) if labels is None else F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label))
    offsets = names.select(label, ((F.row_number().over(W.orderBy(position)) - 1) * target).alias("_offset"))
    return (join_null_safe(made, offsets, [label])
            .withColumn("id", F.col("_offset") + F.col("_place") + 1).drop("_offset", "_place"))


def heuristic_label(docs: DataFrame, lex: Mapping[str, list[str]] = LEXICON, text: str = "text",
                    bands: Mapping[str, tuple] = LABEL_BANDS) -> DataFrame:
    """Rule label with confidence and the expected bands of its class."""
    lowered = F.lower(F.col(text))
    score = {n: tx.marker_score(lowered, lex[f"label_{n}"], norm) for n, norm in
             [("supportive", 3.0), ("constructive", 3.0), ("complaint", 2.0), ("attack", 2.0), ("debate", 2.0)]}
    scored = docs.withColumns({f"_{n}": c for n, c in score.items()})
    sup, con, cmp, att, deb = (F.col(f"_{n}") for n in score)
    rules = [
        (att >= 0.5, "DIRECT_ATTACK", 0.85),
        ((sup >= 0.45) & (cmp >= 0.25), "MIXED_STANCE", 0.65),
        (sup >= 0.45, "SUPPORTIVE_DEFENSE", 0.75),
        (cmp >= 0.5, "DISMISSIVE_COMPLAINT", 0.7),
        (con >= 0.45, "CONSTRUCTIVE_CRITICISM", 0.7),
        (deb >= 0.45, "BALANCED_DEBATE", 0.7),
    ]

    def first_match(pick) -> Column:
        out = F.when(rules[0][0], F.lit(pick(rules[0])))
        for rule in rules[1:]:
            out = out.when(rule[0], F.lit(pick(rule)))
        return out

    labelled = scored.select(
        *docs.columns,
        first_match(lambda r: r[1]).otherwise("NEUTRAL_ANALYSIS").alias("expected_stance"),
        first_match(lambda r: r[2]).otherwise(0.6).alias("label_confidence"),
    )

    def band(i: int) -> Column:
        out = None
        for name, table in bands.items():
            lit = F.array(*[F.lit(v) for v in table[i]])
            cond = F.col("expected_stance") == name
            out = F.when(cond, lit) if out is None else out.when(cond, lit)
        return out

    return labelled.withColumns({
        "expected_score_band": band(0),
        "expected_toxicity_band": band(1),
        "expected_supportive_strength_band": band(2),
    })


def heuristic_targets(docs: DataFrame, lex: Mapping[str, list[str]] = LEXICON, text: str = "text",
                      sentiment: str | None = None) -> DataFrame:
    """Expected constructive and toxic flags from surface cues, and the expected score."""
    lowered = F.lower(F.col(text))
    cues = [tx.contains_any(lowered, lex[f"target_{n}"]) for n in ("reasoning", "suggestion", "comparison")]
    cues.append(tx.regex_any(lowered, PATTERNS["target_connector"]))
    toxic = any_of([tx.contains_any(lowered, lex["target_abuse"]),
                    tx.regex_any(lowered, PATTERNS["target_attack"])])
    n_cues = sum((c.cast("int") for c in cues[1:]), cues[0].cast("int"))
    out = docs.withColumns({"constructive_target": (n_cues >= 2).cast("int"), "toxic_target": toxic.cast("int")})
    if sentiment is None:
        return out
    s = F.col(sentiment)
    base = (F.when(s == "positive", TARGET_SENTIMENT_BASE["positive"])
            .when(s == "neutral", TARGET_SENTIMENT_BASE["neutral"])
            .otherwise(TARGET_SENTIMENT_BASE["negative"]))
    expected = base + 10.0 * F.col("constructive_target") - 22.0 * F.col("toxic_target")
    return out.withColumn("expected_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), expected)))


def estimate_bands(df: DataFrame, score: str = "final_score", toxicity: str = "toxicity_mean",
                   supportive: str = "supportive_defense_strength") -> DataFrame:
    """Expected bands around measured values: +-6, +-.08, +-.15, clamped to the scale."""

    def around(c: str, width: float, top: float, rnd) -> Column:
        return F.array(rnd(F.greatest(F.lit(0.0), F.col(c) - width)), rnd(F.least(F.lit(top), F.col(c) + width)))

    return df.withColumns({
        "expected_score_band": around(score, 6.0, 100.0, r2),
        "expected_toxicity_band": around(toxicity, 0.08, 1.0, r4),
        "expected_supportive_strength_band": around(supportive, 0.15, 1.0, r4),
    })
