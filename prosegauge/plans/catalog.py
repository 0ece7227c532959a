"""The queries of the package over the driver tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from prosegauge.functions import numeric as nu, text as tx
from prosegauge.lexicons import LEXICON, STANCES
from prosegauge.operators import (
    benchmark as bm,
    claims as cl, clean, corpus, evaluate as ev, facts as fa, fusion as fu, paragraphs as pa, quality as qu, scoring as sc,
    signals as si, social as so, stance as st, submissions as su, writer as wr,
)
from prosegauge.plans import demo as dm
from prosegauge.plans.corpus_build import build_corpus
from prosegauge.plans.score_documents import score_documents
from prosegauge.session import checkpointed, stored
from prosegauge.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
c = F.col
L, D = LEXICON, dm.DEMO


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(col: F.Column) -> F.Column:
    return nu.rounded(col, 6)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[nu.rounded(c(n), digits).alias(n) if t == "double" else c(n) for n, t in df.dtypes])


def paras(s: SparkSession, d: str) -> DataFrame:
    return pa.explode_paragraphs(dm.documents(s, d), dm.SEP)


def split_docs(s: SparkSession, d: str) -> DataFrame:
    return pa.with_split(dm.documents(s, d))


# --- splitting and text signals ---------------------------------------------------

@query
def paragraph_split(s, d):
    return paras(s, d).select("doc_id", "para_ix", F.char_length("text").alias("n_chars"), F.md5("text").alias("h"))


@query
def sentence_split(s, d):
    return pa.explode_sentences(paras(s, d)).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.max(F.char_length("sentence")).alias("longest"),
        F.min(F.md5("sentence")).alias("h"))


@query
def clause_split(s, d):
    lexical = F.regexp_replace(c("text"), " the ", " but ")
    parts = dm.turns(s, d).select("doc_id", tx.clauses(lexical).alias("p"))
    return parts.select("doc_id", F.size("p").alias("n_clauses"), F.md5(F.array_join("p", "|")).alias("h"))


@query
def token_counts(s, d):
    return pa.text_counts(dm.documents(s, d))


@query
def ngram_counts(s, d):
    return pa.ngram_counts(dm.turns(s, d), 2)


@query
def marker_scores(s, d):
    low = dm.documents(s, d).select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", *[tx.hits(c("low"), D[n]).cast("bigint").alias(f"h_{n}") for n in
                                  ("supportive", "attack", "evidence")],
                      r6(tx.marker_score(c("low"), L["reasoning"], 4.0)).alias("reasoning"),
                      r6(tx.phrase_ratio(c("low"), dm.ABUSE)).alias("abuse_share"))


@query
def keyword_ratio(s, d):
    toks = dm.documents(s, d).select("doc_id", tx.tokens(c("text")).alias("t"))
    return toks.select("doc_id", r6(tx.keyword_ratio(c("t"), dm.WORDS)).alias("common"),
                       r6(tx.keyword_ratio(c("t"), L["stopwords"])).alias("stop"))


@query
def evidence(s, d):
    base = dm.documents(s, d).select("doc_id", "text", F.lower("text").alias("low"))
    return base.select("doc_id", r6(tx.evidence_score(c("text"), c("low"), D["evidence"])).alias("evidence"))


@query
def lexical_diversity(s, d):
    return split_docs(s, d).select("doc_id", r6(tx.lexical_diversity(c("_toks"))).alias("diversity"))


@query
def repetition(s, d):
    return split_docs(s, d).select("doc_id", r6(tx.repetition(c("_toks"))).alias("repetition"))


@query
def sentence_variety(s, d):
    return split_docs(s, d).select("doc_id", r6(tx.sentence_variety(
        c("_sents"), c("_stoks"), dm.WORDS[:5])).alias("variety"))


@query
def completeness(s, d):
    return split_docs(s, d).select("doc_id", r6(tx.completeness(
        c("_sents"), c("_lower"), D["intro"], D["argument"], D["conclusion"])).alias("completeness"))


@query
def content_ratio(s, d):
    return split_docs(s, d).select("doc_id", r6(tx.content_ratio(
        c("_toks"), L["stopwords"], L["content_suffixes"])).alias("content"))


@query
def clarity(s, d):
    return split_docs(s, d).select("doc_id", r6(tx.clarity(
        F.size("_toks"), F.size("_sents"), tx.syllable_count(c("_lower")))).alias("clarity"))


@query
def writing_quality_doc(s, d):
    return rounded(qu.writing_quality(dm.documents(s, d), D, dm.SEP), 3)


# --- cleaning and corpora -----------------------------------------------------------

@query
def text_flags(s, d):
    noisy = dm.turns(s, d).unionByName(dm.turns(s, d).select(
        (c("doc_id") + 10_000_000).alias("doc_id"), "conv_id", "turn", "role",
        F.element_at(F.array(F.lit("  "), F.lit("https://a.b/c www.x.y"), F.lit("#one #two"), F.lit("RT @you hi"),
                             F.lit("☀ !? @me #x"), F.lit("rt @you: hi"), F.lit("#a#b"), F.lit("Été")),
                     (c("turn") % 8 + 1).cast("int")).alias("text")))
    return clean.text_flags(noisy)


@query
def clean_corpus(s, d):
    kept = clean.clean_texts(dm.table(s, d, "documents").select("doc_id", "text"), ["doc_id"], dm.WORDS[:4])
    return kept.select("doc_id", F.md5("text").alias("h"))


@query
def collect_samples(s, d):
    lex = L | {g: dm.WORDS[i:i + 2] for i, g in enumerate(clean.TOPIC_GROUPS)}
    kept = clean.collect_samples(dm.turns(s, d).select("doc_id", "text"), ["doc_id"], lex)
    return kept.select("doc_id", "source", F.md5("text").alias("h"))


@query
def dedupe_first(s, d):
    docs = dm.table(s, d, "documents").select("doc_id", "lang", "text")
    return clean.dedupe_first(docs, [c("lang"), F.lower("text")], [c("doc_id")]).select("doc_id", "lang")


@query
def strip_synthetic(s, d):
    docs = dm.table(s, d, "documents").select("doc_id", "lang", "text", F.when(
        c("source") == "src3", "synthetic_balance").otherwise(c("source")).alias("source"))
    return clean.strip_synthetic(docs, ["doc_id"], "lang").select("doc_id", "source")


@query
def union_corpora(s, d):
    parts = [dm.table(s, d, "documents").select(F.lit("d").alias("origin"), "text"),
             dm.table(s, d, "benchmark").select(F.lit("b").alias("origin"), "text"),
             dm.table(s, d, "conversations").select(F.lit("c").alias("origin"), "text", "role")]
    return clean.union_corpora(*parts).groupBy("origin", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query
def normalized_names(s, d):
    name = F.concat_ws(" ", F.lit(" O'Neil"), c("p_name"), c("p_brand"), F.lit(" & co. "))
    return dm.table(s, d, "part").select(
        "p_partkey", tx.normalize_name(name).alias("name_key"), tx.normalize_team(name).alias("team"),
        tx.slugify(name).alias("slug"), tx.normalize_text(name).alias("plain"))


@query
def distinct_values(s, d):
    return clean.distinct_values(dm.table(s, d, "part"), "p_brand")


@query
def class_distribution(s, d):
    return corpus.class_distribution(dm.table(s, d, "documents"), "lang")


@query
def stratified_split(s, d):
    return corpus.stratified_split(dm.table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query
def split_manifest(s, d):
    split = corpus.stratified_split(dm.table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.7, 7)
    return corpus.class_split_counts(split, "lang")


@query
def split_manifest_report(s, d):
    """The manifest of a split: totals, and the classes of both parts."""
    split = corpus.stratified_split(dm.table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.7, 7)
    named = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(
        e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias(m)
    return corpus.split_manifest(split, "lang", seed=7).select(
        "total_rows", "train_rows", "test_rows", "random_seed_used", named("class_distribution_train"), named("class_distribution_test"))


@query
def rebalance(s, d):
    docs = dm.table(s, d, "documents").select("doc_id", "lang", "text")
    made = corpus.rebalance(docs, "lang", "doc_id", 150, labels=None)
    return made.select("id", "doc_id", "lang", "source", F.md5("text").alias("h"))


@query
def heuristic_label(s, d):
    out = corpus.heuristic_label(dm.turns(s, d), D)
    return out.select("doc_id", "expected_stance", "label_confidence", *[
        F.get(f"expected_{b}_band", F.lit(i)).alias(f"{b}_{e}") for b in ("score", "toxicity", "supportive_strength")
        for i, e in enumerate(("lo", "hi"))])


@query
def heuristic_targets(s, d):
    turns = dm.turns(s, d).withColumn("sentiment", F.when(c("turn") % 3 == 0, "positive").when(
        c("turn") % 3 == 1, "neutral").otherwise("negative"))
    return corpus.heuristic_targets(turns, D, sentiment="sentiment").select(
        "doc_id", "constructive_target", "toxic_target", "expected_score")


@query
def estimate_bands(s, d):
    base = dm.submissions(s, d).select("id", c("value").alias("final_score"), (c("value") / 500).alias(
        "toxicity_mean"), (c("value") / 400).alias("supportive_defense_strength"))
    out = corpus.estimate_bands(base)
    return out.select("id", *[F.get(f"expected_{b}_band", F.lit(i)).alias(f"{b}_{e}") for b in (
        "score", "toxicity", "supportive_strength") for i, e in enumerate(("lo", "hi"))])


# --- paragraph signals -------------------------------------------------------------------

@query
def abuse_report(s, d):
    low = dm.documents(s, d).select("doc_id", F.lower("text").alias("low"))
    flagged = low.select("doc_id", (tx.phrase_ratio(c("low"), dm.ABUSE) > 0).alias("pred"))
    return ev.binary_report(flagged.join(dm.table(s, d, "labels"), "doc_id"), "pred", "toxic")


@query
def toxicity(s, d):
    return rounded(si.toxicity(paras(s, d), D | {"abuse_words": dm.ABUSE}))


@query
def toxicity_default(s, d):
    """The default lists over texts into which their markers are put."""
    lists = F.array(*[F.lit(x) for x in (*L["abuse_words"], "You are", "he is", "They are", "that player is")])
    marked = paras(s, d).withColumn("text", F.concat_ws(" ", "text", F.get(
        lists, F.pmod(c("doc_id") + c("para_ix"), F.size(lists)).cast("int")), F.get(
        lists, F.pmod(c("doc_id") * 7 + c("para_ix") * 3, F.size(lists)).cast("int"))))
    return rounded(si.toxicity(marked, L))


@query
def discourse(s, d):
    return rounded(si.discourse(paras(s, d), D))


@query
def constructiveness(s, d):
    return rounded(si.constructiveness(paras(s, d), D))


@query
def writer_type(s, d):
    return rounded(wr.writer_type(dm.documents(s, d), D).drop("writer_gap"), 3)


@query
def sarcasm(s, d):
    return rounded(st.sarcasm(paras(s, d), D))


@query
def defence_scores(s, d):
    return rounded(st.defence_scores(paras(s, d), D))


@query
def quote_flags(s, d):
    return st.quote_flags(paras(s, d), D)


@query
def paragraph_components(s, d):
    means = si.aggregate_paragraphs(si.paragraph_components(paras(s, d), D))
    return rounded(means.select("doc_id", "constructiveness", "respectfulness", "analytical_tone", "clarity",
                                "fan_sincerity", "toxicity_mean", "toxicity_max", "abuse_mean"), 3)


@query
def paragraph_stance(s, d):
    out = st.stance_report(st.paragraph_stance(paras(s, d), D))
    return out.select("doc_id", "para_ix", "stance_label", "primary_stance_label", "primary_reason",
                      "sarcasm_gate_reason", F.array_join("style_tags", ",").alias("tags"))


@query
def tone_metrics(s, d):
    """The five tone metrics of every paragraph."""
    return rounded(st.paragraph_stance(paras(s, d), D).select("doc_id", "para_ix", *st.METRICS), 3)


@query
def conversation_stance(s, d):
    lines = dm.turns(s, d).select("conv_id", "turn", "text")
    stances = st.paragraph_stance(lines, D, keep=["conv_id", "turn"])
    return st.document_stance(stances, ["conv_id"]).select(
        "conv_id", "n_paragraphs", "stance_label", "primary_stance_label",
        F.array_join("style_tags", ",").alias("tags"), *[nu.rounded(c(st.prob(x)), 3).alias(st.prob(x)) for x in STANCES])


@query
def tag_counts(s, d):
    stances = st.paragraph_stance(paras(s, d), D)
    return st.tag_counts(stances).select("doc_id", F.array_join(F.transform(
        "tags", lambda t: F.concat(t["tag"], F.lit(":"), t["n"].cast("string"))), ",").alias("tags"))


# --- match facts ---------------------------------------------------------------------------

@query
def batting(s, d):
    return fa.batting(fa.ball_events(dm.ball_log(s, d)))


@query
def bowling(s, d):
    return fa.bowling(fa.ball_events(dm.ball_log(s, d)))


@query
def dismissals(s, d):
    return fa.dismissals(fa.ball_events(dm.ball_log(s, d)))


@query
def match_info(s, d):
    return fa.match_info(dm.ball_log(s, d)).withColumn("match_date", F.date_format("match_date", "yyyy-MM-dd"))


@query
def player_match(s, d):
    return fa.player_match(dm.ball_log(s, d)).withColumn("match_date", F.date_format("match_date", "yyyy-MM-dd"))


@query
def player_stats(s, d):
    return rounded(fa.player_stats(fa.player_match(dm.ball_log(s, d))))


@query
def last_n_stat(s, d):
    return rounded(fa.player_stats(fa.last_n(fa.player_match(dm.ball_log(s, d)), 5)))


@query
def this_season_stat(s, d):
    return rounded(fa.this_season_stats(fa.player_match(dm.ball_log(s, d))))


# --- claims ----------------------------------------------------------------------------------

@query
def claims_extract(s, d):
    out = cl.extract_claims(dm.claim_texts(s, d))
    whole = ("window_size", "year_lo", "year_hi")
    return out.select("doc_id", *[c(n).cast("double").alias(n) if n in whole else c(n) for n in cl.ATTRIBUTES],
                      F.md5("sentence").alias("h"))


@query
def extract_mentions(s, d):
    names = stored(fa.players(dm.ball_log(s, d)))
    return cl.extract_mentions(dm.claim_texts(s, d), names).select("doc_id", "player")


@query
def fallback_mentions(s, d):
    names = dm.table(s, d, "supplier").select(dm.player_name(c("s_suppkey")).alias("player"))
    lowered = dm.claim_texts(s, d).withColumn("text", F.lower("text"))
    return cl.extract_mentions(lowered, names).select("doc_id", "player")


@query
def fuzzy_dimension(s, d):
    asked = dm.table(s, d, "customer").select("c_custkey", F.concat(F.lit("nation_"), (
        c("c_nationkey") % 30).cast("string"), F.when(c("c_custkey") % 2 == 0, " side").otherwise("")).alias("team"))
    return cl.resolve_dimension(asked, "team", dm.table(s, d, "nation"), "n_name")


@query
def claim_verdict(s, d):
    li = dm.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("computed_value"))
    sup = dm.table(s, d, "supplier").select(c("s_suppkey").alias("id"), (
        24 + c("s_suppkey") % 5).cast("double").alias("claimed_value"))
    judged = cl.claim_verdict(sup.join(li, sup["id"] == li["l_suppkey"], "left").drop("l_suppkey"))
    return rounded(judged)


@query
def stat_mentions(s, d):
    facts = stored(fa.player_match(dm.ball_log(s, d)))
    out = cl.stat_mentions(dm.claim_texts(s, d), facts)
    return rounded(out.select("doc_id", "player", "stat_type", c("window_size").cast("double").alias("window_size"), "season", "opposition", "claimed_value",
                              "computed_value", "stats_found", "stats_verified", "stat_accuracy_score",
                              "stat_confidence"), 4)


@query
def verify_documents(s, d):
    facts = stored(fa.player_match(dm.ball_log(s, d)))
    out = cl.verify_documents(dm.claim_texts(s, d), facts)
    return rounded(out.select("doc_id", "stats_found", "stats_verified", "stat_accuracy_score", "stat_confidence",
                              "stat_score_adjustment", "n_stat_mentions"), 4)


@query
def verify_by_writer(s, d):
    """Verdicts whose adjustment depends on the writer type, each type in turn."""
    from prosegauge.lexicons import WRITER_TYPES

    facts = stored(fa.player_match(dm.ball_log(s, d)))
    docs = dm.claim_texts(s, d).withColumn("writer", F.get(F.array(*map(F.lit, WRITER_TYPES)), (c("doc_id") % len(WRITER_TYPES)).cast("int")))
    return cl.verify_documents(docs, facts, writer="writer").select("doc_id", "stats_found", "stat_score_adjustment")


# --- submissions, quotas, profiles --------------------------------------------------------------

@query
def validate_submissions(s, d):
    subs = dm.turns(s, d).withColumn("model", F.when(c("turn") == 5, "other").otherwise("eqs"))
    return su.validate_submissions(subs).select("doc_id", "reject_reason")


@query
def quick_score(s, d):
    out = su.quick_score(dm.turns(s, d), D)
    return out.select("doc_id", "score", "confidence", c("components.writing_quality_score").alias("quality"))


@query
def route_scores(s, d):
    subs = dm.turns(s, d).select(c("doc_id").alias("id"), "text", F.when(
        c("turn") == 1, "bqs").otherwise("eqs").alias("model"))
    remote = dm.turns(s, d).filter(c("turn") % 3 == 0).select(
        c("doc_id").alias("id"), (F.char_length("text") % 100).cast("double").alias("remote_score"),
        F.lit(0.9).alias("remote_confidence"))
    return su.route_scores(subs, remote, lex=D).drop("text")


@query
def quota_status(s, d):
    subs = dm.submissions(s, d)
    out = su.quota_status(subs, 55, users=dm.table(s, d, "events").select("user_id").distinct())
    return rounded(out.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in ("period_start", "period_end")}))


@query
def quota_decisions(s, d):
    return su.quota_decisions(dm.submissions(s, d), 20).select("id", "user_id", "used_before", "allowed")


@query
def running_average(s, d):
    return rounded(su.running_average(dm.submissions(s, d), ["eqs_score"]).select("id", "n", "avg_eqs_score"))


@query
def running_reputation(s, d):
    averaged = su.running_average(dm.submissions(s, d), ["eqs_score"])
    return su.with_reputation(averaged).select("id", "n", "reputation_points")


@query
def writer_profiles(s, d):
    out = su.writer_profiles(dm.submissions(s, d)).drop("last_scored_at")
    return rounded(out)


@query
def profiles_by_day(s, d):
    """``writer_profiles`` in three steps, each from the profiles of the one before and the rows of its own time."""
    rows = dm.submissions(s, d)
    low, high = rows.agg(F.expr("percentile_approx(unix_timestamp(cast(ts AS timestamp)), array(0.3, 0.7))")).first()[0]
    at = F.unix_timestamp(c("ts").cast("timestamp"))
    state = None
    for part in (at <= low, (at > low) & (at <= high), at > high):
        state = checkpointed(su.profile_state(rows.filter(part), state))
    return rounded(state.drop("last_scored_at", "last_key"))


@query
def topic_affinity(s, d):
    out = su.topic_affinity(dm.submissions(s, d), dm.communities(s, d))
    return out.select("user_id", F.array_join("primary_topics", ",").alias("topics"))


@query
def scoring_history(s, d):
    return su.scoring_history(dm.submissions(s, d), 7, 20, 5).select("id", "user_id", "eqs_score")


@query
def history_summary(s, d):
    return rounded(su.history_summary(dm.submissions(s, d)))


@query
def score_bands(s, d):
    text = F.when(c("id") % 9 == 0, "n/a").otherwise(c("value").cast("string"))
    return dm.submissions(s, d).select(
        "id", nu.score_band(c("value")).alias("band"), r6(nu.score_percent(c("value"))).alias("percent"),
        r6(nu.clamp(text, 20.0, 95.0, 50.0)).alias("clamped"), r6(nu.to_float0(text)).alias("lenient"),
        nu.to_int0(text).alias("whole"))


@query
def explain_scores(s, d):
    base = dm.submissions(s, d).select(
        "id", (c("value") / 200).alias("stance_confidence"), F.lit("MIXED_STANCE").alias("stance_label"),
        (c("event_type") == "click").alias("stats_found"), (c("id") % 2 == 0).alias("stats_verified"),
        (c("value") / 300).alias("argument_logic_score"), (c("value") / 100).alias("evidence_presence_score"),
        (c("value") / 90).alias("coherence_score"), (c("value") / 400).alias("repetition_penalty"),
        (c("value") - 150).alias("toxicity_penalty"), (c("value") - 100).alias("stat_accuracy_component"))
    out = su.explain(base)
    return out.select("id", *[F.size(n).alias(f"n_{n}") for n in ("strengths", "concerns", "penalties")],
                      F.get("concerns", F.lit(0)).alias("first_concern"))


# --- communities ------------------------------------------------------------------------------------

@query
def list_communities(s, d):
    return so.list_communities(dm.communities(s, d), "click", "public", "nation_1", 5, 1).select("id", "name")


@query
def community_page(s, d):
    """Second page of a directory: total, page and the cursor of the third."""
    all_ = dm.communities(s, d)
    first = so.community_page(all_, 4, visibility="public").select("next_created_at", "next_id").first()
    out = so.community_page(all_, 4, tuple(first) if first else None, visibility="public")
    return out.select("id", "name", "total", c("next_id").alias("next_id"))


@query
def like_minded_writers(s, d):
    out = so.like_minded_writers(dm.writers(s, d), dm.users(s, d), style="analytical", k=5)
    return out.select("target_id", "place", "user_id", "match_score", "match_reason")


@query
def like_minded_by_topic(s, d):
    out = so.like_minded_writers(dm.writers(s, d), dm.users(s, d), topic="click", k=5)
    return out.select("target_id", "place", "user_id", "match_score", "match_reason")


@query
def discover_communities(s, d):
    return so.discover_communities(dm.writers(s, d), dm.communities(s, d), 5)


@query
def community_members(s, d):
    return so.community_members(dm.initial_members(s, d).withColumn("joined_at", F.lit(1)), dm.users(s, d)).select(
        "community_id", "user_id", "username", "role")


@query
def user_communities(s, d):
    return so.user_communities(dm.communities(s, d), dm.initial_members(s, d)).select("user_id", "id", "name")


@query
def membership_replay(s, d):
    return so.apply_membership(dm.membership_commands(s, d), dm.initial_members(s, d), dm.communities(s, d))\
        .select("cmd_id", "accepted", "reason")


@query
def member_counts(s, d):
    replayed = so.apply_membership(dm.membership_commands(s, d), dm.initial_members(s, d), dm.communities(s, d))
    return so.member_counts(replayed, dm.communities(s, d))


@query
def first_creations(s, d):
    cmds = dm.submissions(s, d).select(c("id").alias("cmd_id"), "ts", F.concat(F.lit("nation_"), (
        c("id") % 400).cast("string")).alias("slug"))
    return so.first_creations(cmds, dm.communities(s, d)).select("cmd_id", "slug")


@query
def apply_creations(s, d):
    cmds = dm.submissions(s, d).select(
        c("id").alias("cmd_id"), "ts", F.concat(F.lit("nation_"), (c("id") % 300).cast("string")).alias("slug"),
        F.concat(F.lit("N"), (c("id") % 300 * 7 % 290).cast("string")).alias("name"))
    return so.apply_creations(cmds, dm.communities(s, d)).select("cmd_id", "slug", "name")


@query
def reject_existing(s, d):
    cust = dm.table(s, d, "customer").select(c("c_custkey").alias("key"))
    urgent = dm.table(s, d, "orders").filter(c("o_orderpriority") == "1-URGENT")
    return clean.reject_existing(cust, urgent.select(c("o_custkey").alias("key")), ["key"])


# --- evaluation -----------------------------------------------------------------------------------------

def _predictions(s, d):
    v = c("value")
    return dm.submissions(s, d).select(
        "id", c("event_type").alias("expected"), F.when(c("id") % 3 == 0, "click").otherwise(c("event_type")).alias(
            "predicted"), F.least(F.lit(120.0), v).alias("score"), F.lit(20.0).alias("score_lo"),
        F.lit(70.0).alias("score_hi"), (v / 500).alias("toxicity"), F.lit(0.0).alias("toxicity_lo"),
        F.lit(0.2).alias("toxicity_hi"), (v / 400).alias("supportive"), F.lit(0.05).alias("supportive_lo"),
        F.lit(1.0).alias("supportive_hi"))


@query
def band_report(s, d):
    return rounded(ev.band_report(_predictions(s, d)))


@query
def deviation_report(s, d):
    return rounded(ev.deviation_report(_predictions(s, d), "score", "score_lo", "score_hi", ["expected"]))


@query
def worst_samples(s, d):
    return rounded(ev.worst_k(ev.with_deviation(_predictions(s, d), "score", "score_lo", "score_hi"), 12).select(
        "id", "deviation"))


@query
def best_samples(s, d):
    return rounded(ev.best_k(ev.with_deviation(_predictions(s, d), "score", "score_lo", "score_hi"), 12).select(
        "id", "deviation"))


@query
def score_histogram(s, d):
    return ev.score_histogram(dm.submissions(s, d), "value")


@query
def threshold_grid(s, d):
    cases = dm.submissions(s, d).select((c("value") / 100).alias("score"), (c("event_type") == "click").alias("expected"))
    return rounded(ev.threshold_scores(cases))


@query
def tune_threshold(s, d):
    cases = dm.submissions(s, d).select((c("value") / 100).alias("score"), (c("event_type") == "click").alias("expected"))
    return rounded(ev.tune_threshold(cases))


@query
def threshold_summary(s, d):
    m = _predictions(s, d).agg(
        F.avg((c("predicted") == c("expected")).cast("double") * 100).alias("constructiveness_accuracy"),
        F.avg((c("toxicity") < 0.9).cast("double") * 100).alias("toxicity_accuracy"),
        F.avg(F.abs(c("score") - 45)).alias("average_deviation"), F.max(F.abs(c("score") - 45)).alias("max_deviation"))
    return ev.threshold_summary(m)


@query
def compare_runs(s, d):
    base = ev.with_deviation(_predictions(s, d), "score", "score_lo", "score_hi")
    curr = base.withColumn("deviation", F.abs(c("deviation") - 3.0))
    return ev.repaired_outliers(ev.compare_runs(base, curr))


@query
def writer_distribution(s, d):
    return ev.writer_distribution(wr.writer_type(dm.documents(s, d), D))


@query
def predicted_flags(s, d):
    out = ev.repair_pass(ev.predicted_flags(dm.calibration_rows(s, d)), False)
    return out.select("id", "predicted_constructive", "predicted_toxic", "repair", nu.rounded(c("final_score"), 4).alias("final_score"))


@query
def repaired_scores(s, d):
    out = ev.repair_pass(ev.predicted_flags(dm.calibration_rows(s, d)), True)
    return out.select("id", "predicted_constructive", "predicted_toxic", "repair", nu.rounded(c("final_score"), 4).alias("final_score"))


@query
def repair_counts(s, d):
    return ev.repair_counts(ev.repair_pass(ev.predicted_flags(dm.calibration_rows(s, d)), True))


@query
def label_centroids(s, d):
    out = ev.label_centroids(bm.with_features(dm.bank(s, d), D), features="features")
    both = [out.select("label", "n", F.lit(kind).alias("kind"), F.posexplode(name).alias("dim", "x"))
            for kind, name in (("embedding", "centroid"), ("features", "feature_centroid"))]
    return both[0].unionByName(both[1]).withColumn("x", r6(c("x")))


@query
def centroid_scores(s, d):
    # read for the centroids and for the scores
    v = stored(bm.with_features(dm.bank(s, d), D).select("id", "label", "embedding", "features"))
    return rounded(ev.centroid_scores(v, ev.label_centroids(v, features="features"), features="features"), 5)


@query
def benchmark_probabilities(s, d):
    """Label probabilities of the documents left out of the bank, and of some without a vector."""
    queries = dm.documents(s, d).select(c("doc_id").alias("id"), "text").join(dm.vectors(s, d).select("id", "embedding"), "id", "left")
    return rounded(bm.probabilities(queries.filter("id % 5 = 0"), bm.fit(dm.stance_bank(s, d), D)), 3)


@query
def benchmark_stance(s, d):
    """Stance of all paragraphs, with the benchmark half of every mix filled from a labelled bank."""
    lines = paras(s, d).join(dm.vectors(s, d).select(c("id").alias("doc_id"), "embedding"), "doc_id", "left")
    out = st.paragraph_stance(bm.with_benchmark(lines, bm.fit(dm.stance_bank(s, d), D)), D)
    return out.select("doc_id", "para_ix", st.named("stance_ix", STANCES).alias("stance_label"), *[nu.rounded(c(st.prob(x)), 2).alias(st.prob(x)) for x in STANCES])


@query
def knn_votes(s, d):
    v = dm.vectors(s, d)
    return rounded(ev.knn_label_votes(v, v), 5)


@query
def loo_scores(s, d):
    return rounded(ev.loo_label_scores(bm.with_features(dm.bank(s, d), D), features="features").drop("predicted"), 3)


@query
def coherence_adjacent(s, d):
    v = dm.vectors(s, d).select((c("id") / 25).cast("bigint").alias("doc_id"), (c("id") % 25 + 1).alias("pos"), "embedding")
    return rounded(qu.coherence(v, ["doc_id"]), 5)


# --- bounded streams ----------------------------------------------------------------------------------------

@query
def stream_quota_use(s, d):
    live = jobs.stream_quota(dm.submission_rows(dm.live(s, d, "events")))
    out = jobs.run_to_end(live, "update", ["user_id", "model", "period_start"])
    return out.withColumn("period_start", F.date_format("period_start", "yyyy-MM-dd"))


@query
def stream_quota_decisions(s, d):
    out = jobs.run_to_end(jobs.stream_quota_decisions(dm.submission_rows(dm.live(s, d, "events")), 20))
    return out.select("id", c("user_id").cast("long").alias("user_id"), "used_before", "allowed")


@query
def stream_profiles(s, d):
    out = jobs.run_to_end(jobs.stream_profiles(dm.submission_rows(dm.live(s, d, "events"))), "update", ["user_id"])
    return rounded(out.withColumn("user_id", c("user_id").cast("long")))


@query
def stream_quick_scores(s, d):
    out = jobs.run_to_end(su.quick_score(dm.turn_rows(dm.live(s, d, "conversations")), D).select("doc_id", "score", "confidence", "components"))
    return out.select("doc_id", "score", "confidence", c("components.writing_quality_score").alias("quality"))


# --- whole scoring ------------------------------------------------------------------------------------------

@query
def calibrated_scores(s, d):
    labels = F.array(*[F.lit(x) for x in STANCES])
    base = dm.submissions(s, d).select(
        "id", F.get(labels, (c("id") % 8).cast("int")).alias("stance_label"), (c("value") / 300).alias("stance_confidence"),
        (c("id") % 10 / 20).alias("supportive_defense_strength"), F.least(F.lit(95.0), c("value")).alias("adjusted_score"))
    out = sc.calibrate(base)
    return rounded(out.select("id", "calibrated_score", "calibration_reason", "calibration_applied",
                              "band_deviation_before", "band_deviation_after"))


@query
def score_documents_job(s, d):
    return score_documents(dm.documents(s, d), lex=D, sep=dm.SEP)


@query
def score_with_claims(s, d):
    """Whole scoring of texts with claims, against a fact table and with model scores: the verdicts that enter the score."""
    facts = stored(fa.player_match(dm.ball_log(s, d)))
    docs = dm.claim_texts(s, d)
    part = lambda mod: (c("doc_id") % mod) / F.lit(float(mod))
    scores = docs.select("doc_id", F.lit(1).alias("para_ix"), part(10).alias("toxic"), part(7).alias("anger"), part(3).alias("joy"),
                         part(5).alias("negative"), part(4).alias("positive"))
    out = score_documents(docs.select("doc_id", "text"), facts, scores, lex=D, sep=dm.SEP)
    return out.select("doc_id", "stats_found", "stats_verified", nu.rounded(c("stat_accuracy_score"), 4).alias("stat_accuracy_score"))


@query
def corpus_build(s, d):
    out = build_corpus(dm.documents(s, d), lex=D, topic=dm.WORDS[:4], sep=dm.SEP)
    return out.select("doc_id", "stance_label", "confidence", "split", *[
        F.get("expected_score_band", F.lit(i)).alias(n) for i, n in enumerate(("score_lo", "score_hi"))])


@query
def adaptive_scoring(s, d):
    """Stance blend, stance weighting, writer profile and toxicity penalty."""
    out = dm.scored_rows(s, d).drop("toxicity_penalty")
    for step in (sc.stance_blend, sc.stance_weighting, sc.adaptive_components, sc.toxicity_penalty):
        out = step(out)
    return rounded(out.select("id", "constructiveness", "respectfulness", "analytical_tone", "clarity", "fan_sincerity",
                              "dominant_stance_component", "soft_stance_component", "final_stance_component",
                              "toxicity_penalty", "total"), 4)


@query
def fuse_scores(s, d):
    out = fu.fuse_scores(dm.scored_rows(s, d))
    return rounded(out.select("id", "final_score", "toxicity_adjustment", "ceiling", "archetype_detected", "core_component",
                              "originality_component"), 3)


COMPS = ["constructiveness", "respectfulness", "analytical_tone", "clarity", "fan_sincerity", "total"]


@query
def floor_uplift(s, d):
    return rounded(sc.floor_uplift(dm.scored_rows(s, d)).select("id", *COMPS), 3)


@query
def rescue_layer(s, d):
    out = sc.rescue(dm.scored_rows(s, d))
    return rounded(out.select("id", *COMPS, "rescue_reason", "rescue_activated", "rescued_outlier",
                              "analytical_boost_applied"), 3)


@query
def complaint_and_abuse_caps(s, d):
    out = sc.complaint_and_abuse_caps(dm.scored_rows(s, d))
    return rounded(out.select("id", "constructiveness", "toxicity_penalty", "total"), 3)


@query
def sarcasm_penalty(s, d):
    out = sc.sarcasm_penalty(dm.scored_rows(s, d))
    return rounded(out.select("id", "sarcasm_credibility_penalty", "rule_score"), 2)


@query
def fold_adjustments(s, d):
    base = dm.scored_rows(s, d).withColumns({
        "rule_score": F.least(F.lit(95.0), F.greatest(F.lit(20.0), c("total"))), "stat_score_adjustment":
        (c("id") % 9 - 4).cast("double"), "quality_component": (c("id") % 22 - 7).cast("double")})
    out = sc.fold_adjustments(base)
    return rounded(out.select("id", "adjusted_score", "writing_quality_component"), 2)
