"""Numeric claims in text and their verification against player-match facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prosegauge.functions import numeric as nu, text as tx
from prosegauge.lexicons import WRITER_TYPES
from prosegauge.operators.facts import MEASURES, chosen_statistic, measure_sums
from prosegauge.operators.scale import join_null_safe, top_by_own_limit
from prosegauge.session import checkpointed, stored

FILTERS = ["window_size", "season", "year_lo", "year_hi", "opposition", "venue"]
ATTRIBUTES = ["stat_type", "window_type", *FILTERS, "claimed_value"]
S = tx.WS
NUMBER = r"(-?\d+(?:\.\d+)?)"


def _group(c: Column, pattern: str, ix: int = 1) -> Column:
    """Captured group, or NULL where the pattern does not occur."""
    return F.nullif(F.regexp_extract(c, pattern, ix), F.lit(""))


# --- claims (C1-C4) -------------------------------------------------------------------

def stat_type(c: Column) -> Column:
    low = F.lower(c)
    return (F.when(low.contains("strike rate") | low.rlike(r"(?U)\bsr\b"), "strike_rate")
            .when(low.contains("economy"), "economy_rate").when(low.contains("average"), "batting_average")
            .when(low.contains("wicket"), "wickets_total").when(low.contains("run"), "runs_total"))


def claimed_value(c: Column) -> Column:
    near = _group(c, r"(?i)(?:average|strike" + S + r"+rate|economy(?:" + S + r"+rate)?|runs?|wickets?)"
                     r"[^\d]{0,25}(?:is|are|was|were|at|of)?[^\d]{0,15}" + NUMBER)
    numbers = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1))
    windowed = c.rlike(r"(?i)last" + S + r"+\d{1,3}" + S + r"+(?:matches?|innings?)")
    pick = F.when(windowed, F.try_element_at(numbers, F.lit(-1))).otherwise(F.try_element_at(numbers, F.lit(1)))
    return F.coalesce(near, pick).try_cast("double")


def claim_attributes(clauses: DataFrame, clause: str = "sentence") -> DataFrame:
    c = F.col(clause)
    matches = _group(c, r"(?i)last" + S + r"+(\d{1,3})" + S + r"+matches?").cast("int")
    innings = _group(c, r"(?i)last" + S + r"+(\d{1,3})" + S + r"+innings?").cast("int")
    years = r"(?i)(?:between|from)" + S + r"+(20\d{2})" + S + r"+(?:and|to)" + S + r"+(20\d{2})"
    y1, y2 = _group(c, years, 1).cast("int"), _group(c, years, 2).cast("int")
    team = _group(c, r"(?U)\b(?:vs|against)\s+([A-Z][A-Za-z.\-\s]{1,40})")
    place = tx.normalize_team(_group(c, r"(?U)\bat\s+([A-Z][A-Za-z.\-\s]{2,60})"))
    return clauses.withColumns({
        "stat_type": stat_type(c),
        "window_type": F.when(matches.isNotNull(), "last_n_matches").when(innings.isNotNull(), "last_n_innings"),
        "window_size": F.coalesce(matches, innings),
        "season": F.when(c.rlike(r"(?i)(?:this|current)" + S + "+season"), "this_season"),
        "year_lo": F.least(y1, y2),
        "year_hi": F.greatest(y1, y2),
        "opposition": F.nullif(tx.normalize_team(team), F.lit("")),
        "venue": F.nullif(F.when(F.lower(place).startswith("the "), F.substr(place, F.lit(5))).otherwise(place),
                          F.lit("")),
        "claimed_value": claimed_value(c),
    })


def extract_claims(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per clause that names a statistic; ``claim_ix`` orders the claims of a document."""
    sents = docs.select(key, F.posexplode(tx.sentences(F.col(text))).alias("_s", "_sentence"))
    parts = sents.select(key, "_s", F.posexplode(tx.clauses(F.col("_sentence"))).alias("_c", "sentence"))
    found = parts.filter(stat_type(F.col("sentence")).isNotNull())
    # positions fit well below 2^31 for any text, so one BIGINT keeps the order
    ix = F.shiftleft(F.col("_s").cast("bigint"), 31) + F.col("_c")
    return claim_attributes(found.select(key, ix.alias("claim_ix"), "sentence"))


# --- mentions (J3-J5) ------------------------------------------------------------------

def name_variants(players: DataFrame) -> DataFrame:
    """Normalised variants of every player name; the last name in order owns a shared variant."""
    parts = F.filter(F.split(F.col("player"), S + "+"), lambda p: p != "")
    surname = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-1)))
    forms = F.array_compact(F.array(F.col("player"), F.replace(F.col("player"), F.lit("."), F.lit("")), surname))
    named = players.select(tx.strip(F.col("player")).alias("player")).filter("player != ''").distinct()
    return (named.select("player", F.explode(F.array_distinct(F.transform(forms, tx.normalize_name))).alias("variant"))
            .filter("variant != ''").groupBy("variant").agg(F.max("player").alias("player")))


def mention_keys(players: DataFrame) -> DataFrame:
    """(key, player): "v:" + name variant, and "i:" + initial and surname of multi-part names."""
    parts = F.filter(F.split(F.col("player"), S + "+"), lambda p: p != "")
    letters = F.transform(parts, lambda p: F.lower(F.regexp_replace(p, "[^A-Za-z]", "")))
    initial, surname = F.substring(F.get(letters, F.lit(0)), 1, 1), F.try_element_at(letters, F.lit(-1))
    short = (players.select("player").filter(F.col("player").isNotNull()).distinct().filter(F.size(parts) >= 2)
             .filter((initial != "") & (surname != ""))
             .select(F.concat(F.lit("i:"), initial, F.lit(" "), surname).alias("key"), "player"))
    return short.unionByName(name_variants(players).select(
        F.concat(F.lit("v:"), "variant").alias("key"), "player"))


def _without_possessive(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\b([A-Za-z.]+)'s\b", "$1")


def direct_mentions(texts: DataFrame, players: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Capitalised phrases and "initial surname" pairs, looked up in one equi-join over one scan."""
    word = r"[A-Z][A-Za-z.\-']+"
    pair = r"(?U)\b([A-Z])\.?\s+([A-Z][a-zA-Z]+)\b"
    bare = texts.select(*keys, _without_possessive(F.col(text)).alias("_t"))
    phrases = F.transform(
        F.regexp_extract_all(F.col("_t"), F.lit(rf"{word}(?:{S}+{word}){{0,3}}"), F.lit(0)),
        lambda p, i: F.struct(F.lit(0).alias("stage"), i.alias("pos"),
                              F.concat(F.lit("v:"), tx.normalize_name(p)).alias("key")))
    pairs = F.zip_with(
        F.regexp_extract_all(F.col("_t"), F.lit(pair), F.lit(1)),
        F.regexp_extract_all(F.col("_t"), F.lit(pair), F.lit(2)),
        lambda a, b: F.concat(F.lit("i:"), F.lower(a), F.lit(" "), F.lower(b)))
    pairs = F.transform(pairs, lambda k, i: F.struct(F.lit(1).alias("stage"), i.alias("pos"), k.alias("key")))
    asked = bare.select(*keys, F.inline(F.concat(phrases, pairs)))
    return (asked.join(mention_keys(players), "key")
            .groupBy(*keys, "player").agg(F.min(F.struct("stage", "pos")).alias("ord")))


def fallback_mentions(texts: DataFrame, players: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Any variant anywhere in the normalised text: word n-grams up to the longest variant meet the variants."""
    variants = name_variants(players)
    longest = variants.select(F.coalesce(F.max(F.size(F.split("variant", " "))), F.lit(0)).alias("n"))
    words = texts.select(*keys, F.split(tx.normalize_name(_without_possessive(F.col(text))), " ").alias("_w"),
                         longest.scalar().alias("_n"))
    starts = words.select(*keys, "_n", "_w", F.posexplode("_w").alias("_i", "_first"))
    spans = starts.select(*keys, F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("_n"), F.size("_w") - F.col("_i")))),
        lambda n: F.concat_ws(" ", F.slice("_w", F.col("_i") + 1, n)))).alias("variant"))
    return (spans.join(variants, "variant").select(*keys, "player").distinct()
            .select(*keys, "player", F.struct(F.lit(2).alias("stage"), F.lit(0).alias("pos")).alias("ord")))


def extract_mentions(texts: DataFrame, players: DataFrame, keys: Sequence[str] = ("doc_id",),
                     text: str = "text", materialize: bool = False) -> DataFrame:
    """(keys, player, ord): players a text names, in order of appearance.

    Only texts without a direct hit are searched for a variant anywhere. With
    ``materialize`` the direct hits are checkpointed, as they are needed twice.
    """
    keys = list(keys)
    direct = direct_mentions(texts, players, keys, text)
    if materialize:
        direct = checkpointed(direct)
    unresolved = texts.join(direct.select(*keys).distinct(), keys, "left_anti")
    return direct.unionByName(fallback_mentions(unresolved, players, keys, text))


def claims_with_players(claims: DataFrame, clause_mentions: DataFrame, doc_mentions: DataFrame,
                        key: str = "doc_id") -> DataFrame:
    """A claim is about the players its clause names, else about all players of its document."""
    own = claims.join(clause_mentions, [key, "claim_ix"])
    rest = claims.join(clause_mentions.select(key, "claim_ix").distinct(), [key, "claim_ix"], "left_anti")
    return own.unionByName(rest.join(doc_mentions, key))


# --- dimension resolution (J8) ------------------------------------------------------------

def _grams(text: Column, n: int) -> Column:
    """Different runs of ``n`` characters of a text."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(n))))


def contained_pairs(inner: DataFrame, outer: DataFrame, size: int = 3) -> DataFrame:
    """``_i`` and ``_o`` for every value ``_i`` that occurs inside a value ``_o``.

    An index of the outer values' runs of up to ``size`` characters; an inner value is looked up by the run of its own
    that fewest outer values have, and what is found there is checked. Rows grow with the values' lengths, not their
    squares. Empty values are in none.
    """
    index = outer.select("_o", F.explode(F.concat(*[_grams(F.col("_o"), n) for n in range(1, size + 1)])).alias("_g"))
    often = index.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.length("_i") >= size, _grams(F.col("_i"), size)).otherwise(F.array("_i"))
    found = inner.select("_i", F.explode(own).alias("_g")).join(often, "_g", "left")
    rarest = found.groupBy("_i").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("_r")).filter("_r.n > 0")
    return rarest.select("_i", F.col("_r._g").alias("_g")).join(index, "_g").filter(F.col("_o").contains(F.col("_i"))).select("_i", "_o")


def resolve_dimension(df: DataFrame, col: str, dim: DataFrame, dim_col: str) -> DataFrame:
    """Exact case-insensitive value, else the first value that contains or is contained, else unchanged.

    Only distinct values are matched, by an index of their characters (``contained_pairs``).
    """
    values = df.select(F.col(col).alias("_v")).filter("_v is not null and _v != ''").distinct()
    values = values.withColumn("_low", F.lower(tx.normalize_team(F.col("_v"))))
    dims = dim.select(F.col(dim_col).alias("_d")).filter("_d is not null and _d != ''").distinct()
    dims = dims.withColumn("_dlow", F.lower("_d"))
    lows, dlows = values.select("_low").distinct(), dims.select("_dlow").distinct()
    inside_value = contained_pairs(dlows.select(F.col("_dlow").alias("_i")), lows.select(F.col("_low").alias("_o"))).select(
        F.col("_o").alias("_low"), F.col("_i").alias("_dlow"))
    inside_dim = contained_pairs(lows.select(F.col("_low").alias("_i")), dlows.select(F.col("_dlow").alias("_o"))).select(
        F.col("_i").alias("_low"), F.col("_o").alias("_dlow"))
    same = F.col("_low") == F.col("_dlow")
    best = inside_value.unionByName(inside_dim).join(dims, "_dlow").groupBy("_low").agg(F.coalesce(
        F.max(F.when(same, F.col("_d"))), F.min("_d")).alias("_to"))
    found = values.join(best, "_low").select("_v", "_to")
    joined = df.join(found, df[col] == found["_v"], "left")
    return joined.withColumn(col, F.coalesce(
        F.col("_to"), F.when(F.col(col).isNotNull(), tx.normalize_team(F.col(col))))).drop("_v", "_to")


# --- claims against facts (J7, C5, A6, C7) ---------------------------------------------------

def computed_values(claims: DataFrame, facts: DataFrame, salts: int = 16) -> DataFrame:
    """Add ``computed_value`` to claims (with ``player`` and the filter columns; NULL = no restriction).

    Claims repeat the same question, so only distinct (player, filters) meet the
    facts. Questions without a window are answered from facts that are summed
    per (player, season, year, opposition, venue) first; windowed ones keep as
    many newest rows per question as its window has. The joins are salted, as one
    player may own a third of the facts.
    """
    asked = claims.select("player", *FILTERS, F.coalesce(
        (F.col("window_size") > 0), F.lit(False)).alias("_windowed")).distinct()
    asked = asked.withColumn("_q", F.sha2(F.to_json(F.struct("player", *FILTERS), {"ignoreNullFields": "false"}), 256))
    latest = facts.groupBy("player").agg(F.max("season").alias("_latest"))
    asked = asked.join(latest, "player", "left")

    def allowed(f: DataFrame, q: DataFrame) -> Column:
        return (((q["season"].isNull()) | (f["season"] == F.when(
                    q["season"] == "this_season", q["_latest"]).otherwise(q["season"]))
                 | ((q["season"] == "this_season") & q["_latest"].isNull()))
                & (q["year_lo"].isNull() | f["year"].between(q["year_lo"], q["year_hi"]))
                & (q["opposition"].isNull() | (F.lower(f["opposition"]) == F.lower(q["opposition"])))
                & (q["venue"].isNull() | (F.lower(f["venue"]) == F.lower(q["venue"]))))

    def meet(f: DataFrame, q: DataFrame, spread: Column) -> DataFrame:
        f = f.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
        q = q.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return f.join(q, (f["player"] == q["player"]) & (f["_salt"] == q["_salt"]) & allowed(f, q))

    groups = ["player", "season", "year", "opposition", "venue"]
    summed = facts.groupBy(*groups).agg(*measure_sums())
    plain = meet(summed, asked.filter("not _windowed"),
                 F.xxhash64(*groups)).select("_q", *MEASURES).groupBy("_q").agg(*measure_sums())
    rows = meet(facts, asked.filter("_windowed"), F.xxhash64("match_id")).select(
        "_q", "window_size", "match_date", "match_id", *MEASURES)
    newest = top_by_own_limit(rows, ["_q"], [F.desc_nulls_last("match_date"), F.asc("match_id")], "window_size",
                              ["match_id"])
    windowed = newest.groupBy("_q").agg(*measure_sums())
    answers = asked.select("player", *FILTERS, "_q").join(plain.unionByName(windowed), "_q").drop("_q")
    return (join_null_safe(claims, answers, ["player", *FILTERS], "left")
            .withColumn("computed_value", chosen_statistic(F.col("stat_type"))).drop(*MEASURES))


def claim_verdict(df: DataFrame) -> DataFrame:
    """found / verified / accuracy / confidence / difference from claimed and computed value."""
    diff = F.abs(F.col("claimed_value") - F.col("computed_value")) / F.greatest(
        F.abs("computed_value"), F.lit(1e-9))
    d = F.col("difference")
    return df.withColumn("difference", diff).withColumns({
        "stats_verified": F.coalesce(d <= 0.05, F.lit(False)),
        "stat_accuracy_score": F.when(d <= 0.05, 1.0).when(d <= 0.10, 0.6).otherwise(0.0),
        "stat_confidence": F.when(d.isNull(), "low").when(d <= 0.05, "high").when(d <= 0.10, "medium")
        .otherwise("high"),
        "stats_found": F.col("computed_value").isNotNull(),
    })


def stat_weight(writer: Column, has_number: Column) -> Column:
    # Weight of statistics by writer type.
    return (F.when(writer == "Analyst", 4.0).when(writer == "Debater", 2.5)
            .when(writer == "Passionate Fan", F.when(has_number, 1.5).otherwise(0.25))
            .when(writer == "Storyteller", 0.75).otherwise(1.0))


def verdict_folds() -> list[Column]:
    found = F.col("stats_found")
    first = F.struct(*[F.col(c) for c in ("stat_type", "player", "claimed_value", "computed_value", "difference")])
    at = F.when(found, F.struct("claim_ix", "ord", "player"))
    return [
        F.avg(F.when(found, F.col("stat_accuracy_score"))).alias("_accuracy"),
        F.bool_and(F.when(found, F.col("stats_verified"))).alias("_verified"),
        F.bool_or(F.when(found, F.col("stat_confidence") == "high")).alias("_high"),
        F.bool_or(F.col("claimed_value").isNotNull()).alias("_numeric"),
        F.min_by(first, at).alias("_first"),
        F.count(F.lit(1)).alias("n_stat_mentions"),
    ]


def finish_verdicts(docs: DataFrame, folded: DataFrame, key: str, writer: Column) -> DataFrame:
    """A row for every document; without a claim that could be checked it is 'not found'."""
    c = F.col
    out = docs.join(folded, key, "left")
    has = c("_accuracy").isNotNull()
    return out.select(
        *docs.columns,
        has.alias("stats_found"),
        F.coalesce(c("_verified"), F.lit(False)).alias("stats_verified"),
        F.coalesce(nu.rounded(F.col("_accuracy"), 4), F.lit(0.0)).alias("stat_accuracy_score"),
        F.when(~has, "low").when(c("_high"), "high").otherwise("medium").alias("stat_confidence"),
        F.when(has, nu.rounded((c("_accuracy") - 0.5) * 2.0 * stat_weight(writer, c("_numeric")), 2))
        .otherwise(0.0).alias("stat_score_adjustment"),
        *[F.when(has, c("_first")[f]).alias(f"first_{f}") for f in
          ("stat_type", "player", "claimed_value", "computed_value", "difference")],
        F.coalesce("n_stat_mentions", F.lit(0)).alias("n_stat_mentions"),
    )


def stat_mentions(docs: DataFrame, facts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per (claim, player) with the verdict: every claim keeps its row, found or not."""
    # claims are a small share of the text; cut here, so that the text is split once
    claims = checkpointed(extract_claims(docs, key, text))
    # named once: the name patterns would be pushed below the distinct, and run on every fact for both searches
    players = stored(facts.select("player").distinct())
    speaking = docs.select(key, text).join(claims.select(key).distinct(), key, "left_semi")
    doc_mentions = extract_mentions(speaking, players, [key], text, materialize=True)
    clause_mentions = extract_mentions(claims, players, [key, "claim_ix"], "sentence", materialize=True)
    about = checkpointed(claims_with_players(claims, clause_mentions, doc_mentions, key))
    about = resolve_dimension(about, "opposition", facts, "opposition")
    about = checkpointed(resolve_dimension(about, "venue", facts, "venue"))
    judged = claim_verdict(computed_values(about, facts))
    return judged.withColumn("computed_value", nu.rounded(F.col("computed_value"), 2))


def verify_documents(docs: DataFrame, facts: DataFrame, key: str = "doc_id", text: str = "text",
                     writer: str | None = None) -> DataFrame:
    """Verification result per document, keyed by ``key``."""
    folded = stat_mentions(docs, facts, key, text).groupBy(key).agg(*verdict_folds())
    kept = docs.select(key, F.col(writer).alias("_writer")) if writer else docs.select(
        key, F.lit(WRITER_TYPES[-1]).alias("_writer"))
    return finish_verdicts(kept, folded, key, F.col("_writer")).drop("_writer")
