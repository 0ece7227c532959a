"""Stand-in views over the driver tables: the same operators on generic data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prosegauge.lexicons import LEXICON
from prosegauge.session import configure

c = F.col
SEP = "\n"
WORDS = ["the", "of", "and", "with", "that", "for", "was", "on", "die", "und", "der", "ein", "la", "de", "que",
         "en", "les", "et", "del", "los", "un", "to", "is", "by"]


def demo_lexicon() -> dict[str, list[str]]:
    """A lexicon of words that do occur in the invented texts: three per list, by rule."""
    n = len(WORDS)
    return {name: [WORDS[i % n], WORDS[(5 * i + 1) % n], WORDS[(7 * i + 2) % n]]
            for i, name in enumerate(sorted(LEXICON))}


DEMO = demo_lexicon()
ABUSE = ["idiot", "moron", "stupid", "trash", "pathetic", "loser", "disgusting", "clown", "scum", "worthless"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as short texts with a row id."""
    return turn_rows(table(spark, d, "conversations"))


def turn_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        (c("conv_id") * 1000 + c("turn")).alias("doc_id"), "conv_id", "turn", "role", "text")


def letters(n: Column) -> Column:
    return F.translate(n.cast("string"), "0123456789", "abcdefghij")


def player_name(n: Column) -> Column:
    return F.concat(F.lit("Mo S"), letters(n))


def ball_log(spark: SparkSession, d: str) -> DataFrame:
    """A raw match log: orders are matches, lineitem rows are deliveries and squad entries."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    out = F.when(c("l_returnflag").isin("R", "A"), player_name(c("l_suppkey"))).otherwise("")
    kind = (F.when(c("l_returnflag") == "R", "bowled")
            .when((c("l_returnflag") == "A") & (c("l_linenumber") > 3), "run out")
            .when(c("l_returnflag") == "A", "retired hurt").otherwise(""))

    def bit(n: int) -> Column:
        return F.when(c("l_linenumber") == n, "1").otherwise("")

    def rows(df: DataFrame, key: str, order: Column, **cells: Column) -> DataFrame:
        full = {f"c{i}": cells.get(f"c{i}", F.lit(None)) for i in range(16)}
        return df.select(c(key).cast("string").alias("match_id"), *[v.cast("string").alias(k) for k, v in full.items()],
                         order.cast("bigint").alias("row_order"))

    # one branch per row kind: a filter on the kind drops the other branches at planning time
    balls = rows(li, "l_orderkey", 100 + c("l_linenumber"), c0=F.lit("ball"), c4=player_name(c("l_suppkey")),
                 c6=F.concat(F.lit("Jo B"), letters(c("l_partkey") % 50)), c7=c("l_quantity").cast("int"),
                 c8=F.lit("0"), c9=bit(5), c10=bit(6), c13=bit(7), c14=kind, c15=out)
    side = F.pmod(c("l_orderkey") + c("l_linenumber") % 2, F.lit(5))
    log = balls.unionByName(rows(li, "l_orderkey", 10 + c("l_linenumber"), c0=F.lit("info"), c1=F.lit("player"),
                                 c2=F.concat(F.lit("T"), letters(side)), c3=player_name(c("l_suppkey"))))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    year = (F.year("o_orderdate") + 28).cast("string")
    heads = [
        ("team", F.concat(F.lit("T"), letters(F.pmod(c("o_orderkey"), F.lit(5)))), 0),
        ("team", F.concat(F.lit("T"), letters(F.pmod(c("o_orderkey") + 1, F.lit(5)))), 1),
        ("date", F.concat(year, F.date_format("o_orderdate", "/MM/dd")), 2),
        ("season", F.when(F.pmod(c("o_orderkey"), F.lit(7)) == 0, "").otherwise(year), 3),
        ("venue", c("o_orderpriority"), 4)]
    for key, value, order in heads:
        log = log.unionByName(rows(orders, "o_orderkey", F.lit(order), c0=F.lit("info"), c1=F.lit(key), c2=value))
    return log


def claim_texts(spark: SparkSession, d: str) -> DataFrame:
    """A short article per supplier with three numeric claims."""
    s = c("s_suppkey")
    text = F.concat(
        F.lit("In the last "), (s % 7 + 1).cast("string"), F.lit(" matches "), player_name(s), F.lit(" has runs of "),
        (s % 90 + 20).cast("string"), F.lit("; M S"), letters(s + 1), F.lit(" has balls and a strike rate of "),
        F.lit("2550.5 this season against T"), letters(s % 5), F.lit(". The batting average is "),
        (s % 30 + 15).cast("string"), F.lit(" from 2026 to 2021."))
    return table(spark, d, "supplier").select(s.alias("doc_id"), text.alias("text"))


def submissions(spark: SparkSession, d: str) -> DataFrame:
    """Events as scored submissions and quota requests."""
    return submission_rows(table(spark, d, "events"))


def live(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table, one file or a folder of files, as a stream; a stream reads a single file only by a pattern."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def submission_rows(e: DataFrame) -> DataFrame:
    score = F.when(c("event_type") != "error", F.least(F.lit(95.0), c("value")))
    style = F.element_at(F.array(*[F.lit(x) for x in ("analytical", "balanced", "other", "emotional", "unknown")]),
                         (c("event_id") % 5 + 1).cast("int"))
    return e.select(
        c("event_id").alias("id"), "user_id", c("ts").cast("timestamp").alias("ts"), "event_type", "value",
        (c("user_id") % 25).alias("community_id"), F.when(c("event_type") == "view", "bqs").otherwise("eqs").alias("model"),
        (c("event_type") != "error").alias("success"), score.alias("eqs_score"), F.lit(0.72).alias("confidence"),
        style.alias("stance_label"))


def communities(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    topics = F.array(*[F.lit(t) for t in ("click", "view", "purchase", "signup", "error")])

    def at(k: Column) -> Column:
        return F.get(topics, F.pmod(k, F.lit(5)))

    k = c("n_nationkey")
    return n.select(
        k.cast("bigint").alias("id"), c("n_name").alias("name"), F.lower("n_name").alias("slug"),
        F.concat(F.lit("Group "), c("n_name")).alias("description"), at(k).alias("primary_topic"),
        F.array(at(k + 1), at(k * 2)).alias("secondary_topics"),
        F.when(k % 4 == 3, "private").otherwise("public").alias("visibility"),
        (k * 7 % 11).cast("bigint").alias("member_count"), k.alias("created_at"))


def users(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id").distinct()
    u = c("user_id")
    return e.select(u.alias("id"), F.concat(F.lit("user"), u.cast("string")).alias("username"),
                    (u % 11 != 0).alias("is_active"), (u % 13 != 0).alias("email_verified"),
                    F.lit(None).cast("string").alias("avatar_url"))


def writers(spark: SparkSession, d: str) -> DataFrame:
    """Writers whose topics are the event types of their larger events."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(
        F.array_sort(F.collect_set(F.when(c("value") > 150 + c("user_id") % 3 * 50, c("event_type")))).alias("primary_topics"),
        F.count(F.lit(1)).alias("total_submissions"), F.floor(F.max("value")).alias("reputation_points")).withColumn(
        "writing_style", F.when(c("user_id") % 3 == 0, "analytical").otherwise("balanced"))


def membership_commands(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter(c("event_type").isin("signup", "error"))
    return e.select(c("event_id").alias("cmd_id"), c("ts").cast("timestamp").alias("ts"),
                    (c("event_id") % 27).alias("community_id"), (c("user_id") % 20).alias("user_id"),
                    F.when(c("event_type") == "signup", "join").otherwise("leave").alias("command"))


def initial_members(spark: SparkSession, d: str) -> DataFrame:
    k = c("n_nationkey").cast("bigint")
    rows = F.array(F.struct((k % 20).alias("user_id"), F.lit("owner").alias("role")),
                   F.struct(((k + 7) % 20).alias("user_id"), F.lit("member").alias("role")))
    return table(spark, d, "nation").select(k.alias("community_id"), F.inline(rows))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(c("vec_id").alias("id"), "embedding", "label")


def bank(spark: SparkSession, d: str) -> DataFrame:
    """``vectors`` with the text of the document of the same number, if there is one."""
    return vectors(spark, d).join(table(spark, d, "documents").select(c("doc_id").alias("id"), "text"), "id", "left")


def stance_bank(spark: SparkSession, d: str) -> DataFrame:
    """``bank`` labelled by stance; numbers that are multiples of five are kept out, to be scored."""
    from prosegauge.lexicons import STANCES

    names = F.array(*map(F.lit, STANCES))
    return bank(spark, d).filter("id % 5 != 0").withColumn("label", F.get(names, c("label") % len(STANCES)))


def calibration_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events as calibration samples: signals of the first paragraph, means, scores and an expected category, by arithmetic."""
    i = c("event_id")
    part = lambda mod, of: (i % mod) / F.lit(float(of))
    names = ["Constructive Storyteller", "Constructive Debater", "Constructive Passionate Fan", "Non-constructive complaint",
             "Toxic attack", "Neutral"]
    return table(spark, d, "events").select(
        i.alias("id"), F.element_at(F.array(*map(F.lit, names)), (i % 6 + 1).cast("int")).alias("category"),
        part(11, 10).alias("p1_constructive"), part(13, 12).alias("p1_detector"), (part(41, 1)).alias("constructiveness"),
        part(7, 6).alias("p1_reasoning"), part(5, 4).alias("p1_suggestion"), part(3, 2).alias("p1_depth"), part(17, 16).alias("p1_discourse"),
        part(97, 1).alias("final_score"), (-part(23, 2)).alias("toxicity_penalty"), part(19, 90).alias("abuse_mean"),
        part(29, 140).alias("toxicity_mean"), part(31, 60).alias("mean_discourse"), part(37, 70).alias("mean_depth"),
        part(16, 1).alias("fan_sincerity"), part(43, 80).alias("mean_suggestion"))


def scored_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events as documents in the middle of scoring: every input of the rule chain and the fusion, by arithmetic."""
    from prosegauge.lexicons import COMPONENT_MAX, STANCES, WRITER_TYPES
    from prosegauge.operators.stance import prob
    from prosegauge.operators.writer import writer_column

    i = c("id")

    def part(mod: int, den: float) -> Column:
        return (i % mod) / F.lit(den)

    def pick(names: list[str], n: int) -> Column:
        return F.get(F.array(*[F.lit(x) for x in names]), (i % n).cast("int"))

    cols = {prob(s): ((i * (k + 3)) % 11) / F.lit(40.0) for k, s in enumerate(STANCES)}
    cols |= {writer_column("prob", w): part(k + 2, 10.0) for k, w in enumerate(WRITER_TYPES)}
    cols |= {k: F.least(F.lit(m), c("value") / F.lit(240.0 / m)) for k, m in COMPONENT_MAX.items()}
    cols |= {
        "stance_label": pick(STANCES, 8), "writer_type": pick(WRITER_TYPES, 5),
        "attack_rejection_detected": i % 5 == 0, "attack_endorsement_detected": i % 7 == 0,
        "supportive_defense_strength": part(10, 12.0), "causal_defense_score": part(9, 12.0),
        "mean_respect": part(6, 6.0), "toxicity_mean": part(13, 20.0), "toxicity_max": part(17, 17.0),
        "toxicity_ratio": part(3, 4.0), "abuse_mean": part(19, 40.0), "stats_found": i % 3 == 0,
        "stats_verified": i % 6 == 0, "stat_accuracy_score": part(4, 3.0), "writing_quality_component": part(23, 1.0) - 9.0,
        "toxicity_penalty": -part(26, 1.0), "mean_sentiment_positive": part(3, 3.0), "mean_sentiment_neutral": part(2, 4.0),
        "mean_sentiment_negative": part(3, 5.0), "mean_negativity": part(8, 8.0), "attack_severity": F.when(
            i % 10 == 1, (i % 4).cast("int")).otherwise(0), "dismissive_text": i % 12 == 2, "ceiling_suggestion": i % 2 == 0,
        "fairness_defense_score": part(4, 4.0), "constructive_pattern_ratio": part(7, 14.0),
        "mean_reasoning": part(11, 22.0), "mean_suggestion": part(9, 30.0), "mean_depth": part(13, 24.0),
        "mean_strategic": part(5, 12.0), "mean_discourse": part(8, 16.0), "mean_word_count": 20.0 + part(90, 1.0),
        "mean_sentence_count": part(9, 1.0), "rescue_reasoning_hits": (i % 6).cast("int"),
        "rescue_suggestion_hits": (i % 4).cast("int"), "rescue_complaint": i % 3 == 1, "cap_complaint": i % 4 != 1,
        "cap_reasoning_hits": (i % 5).cast("int"), "cap_suggestion_hits": (i % 3).cast("int"),
        "sarcasm_score": part(11, 10.0), "ridicule_score": part(7, 7.0), "contradiction_score": part(5, 5.0),
        "context_mismatch_score": part(2, 1.0), "exaggeration_score": part(3, 3.0), "neutrality_score": part(12, 12.0),
        "stance_confidence": part(16, 16.0), "primary_stance_label": F.when(i % 3 == 0, "SARCASTIC_ATTACK").otherwise(
            "DIRECT_CRITICISM"),
        "sarcasm_gate_reason": F.when(i % 4 == 0, "sarcasm_threshold_met_and_no_stronger_supportive_context").otherwise(
            "score_below_threshold"),
        "stance_blend_adjustment": part(7, 1.0) - 3.0,
        **{n: part(m, 10.0) for n, m in [
            ("lexical_diversity_score", 10), ("sentence_variety_score", 9), ("repetition_penalty", 8),
            ("argument_logic_score", 7), ("information_density_score", 11), ("coherence_score", 6),
            ("counter_argument_score", 5), ("completeness_score", 4)]},
    }
    rows = submissions(spark, d).select("id", *[e.alias(n) for n, e in cols.items()])
    return rows.withColumn("total", sum((c(k) for k in COMPONENT_MAX), c("toxicity_penalty")))
