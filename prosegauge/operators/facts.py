"""Ball-by-ball logs to player-match facts and player statistics (A1-A5, J1, J2, W1, W2, S1 consumers)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prosegauge.functions.numeric import ratio, to_int0
from prosegauge.functions.text import normalize_team, strip_ref
from prosegauge.lexicons import NON_BOWLER_WICKETS
from prosegauge.operators.scale import top_per_group

MEASURES = ["runs", "balls_faced", "dismissals", "runs_conceded", "balls_bowled", "wickets"]
STATISTICS = ["batting_average", "strike_rate", "economy_rate", "runs_total", "wickets_total"]


def _text(name: str) -> Column:
    return F.coalesce(strip_ref(F.col(name)), F.lit(""))


def ball_events(log: DataFrame) -> DataFrame:
    """Typed delivery rows of a raw log (columns ``c0..c15`` and ``match_id``)."""
    balls = log.filter(F.col("c0") == "ball").select(
        "match_id", _text("c4").alias("striker"), _text("c6").alias("bowler"),
        to_int0(F.col("c7")).alias("bat_runs"), to_int0(F.col("c9")).alias("wides"),
        to_int0(F.col("c10")).alias("noballs"), to_int0(F.col("c13")).alias("penalty"),
        F.lower(_text("c14")).alias("wicket_type"), _text("c15").alias("player_out"))
    return with_delivery_facts(balls)


def with_delivery_facts(balls: DataFrame) -> DataFrame:
    out = F.col("player_out") != ""
    return balls.withColumns({
        "legal": ((F.col("wides") == 0) & (F.col("noballs") == 0)).cast("int"),
        "conceded": F.col("bat_runs") + F.col("wides") + F.col("noballs") + F.col("penalty"),
        "is_out": (out & (F.col("wicket_type") != "retired hurt")).cast("int"),
        "bowler_wicket": (out & (F.col("wicket_type") != "")
                          & ~F.col("wicket_type").isin(*NON_BOWLER_WICKETS)).cast("int"),
    })


def batting(balls: DataFrame) -> DataFrame:
    return balls.groupBy("match_id", F.col("striker").alias("player")).agg(
        F.sum("bat_runs").alias("runs"), F.sum("legal").alias("balls_faced"))


def bowling(balls: DataFrame) -> DataFrame:
    return balls.groupBy("match_id", F.col("bowler").alias("player")).agg(
        F.sum("conceded").alias("runs_conceded"), F.sum("legal").alias("balls_bowled"),
        F.sum("bowler_wicket").alias("wickets"))


def dismissals(balls: DataFrame) -> DataFrame:
    return balls.filter(F.col("is_out") == 1).groupBy("match_id", F.col("player_out").alias("player")).agg(
        F.count(F.lit(1)).alias("dismissals"))


def match_info(log: DataFrame) -> DataFrame:
    """One row per match: the two teams in file order, date, year, season, venue. Later rows win."""
    info = log.filter((F.col("c0") == "info") & F.col("c1").isin("team", "date", "season", "venue"))
    # team rows come first, in file order; the window's sort by match serves the aggregate as well
    info = info.withColumn("_rank", F.row_number().over(W.partitionBy("match_id").orderBy(F.col("c1") != "team", "row_order")))

    def latest(key: str) -> Column:
        return F.max_by(F.when(F.col("c1") == key, F.coalesce(F.col("c2"), F.lit(""))),
                        F.when(F.col("c1") == key, F.col("row_order")))

    def team(rank: int) -> Column:
        return normalize_team(F.max(F.when((F.col("c1") == "team") & (F.col("_rank") == rank), F.col("c2"))))

    matches = info.groupBy("match_id").agg(
        latest("date").alias("date_text"), latest("season").alias("season_text"), latest("venue").alias("venue_text"),
        team(1).alias("team_a"), team(2).alias("team_b"))
    year = F.nullif(F.regexp_extract(F.col("date_text"), r"(20\d{2})", 1), F.lit("")).cast("int")
    return matches.select(
        "match_id",
        F.try_to_timestamp(F.col("date_text"), F.lit("yyyy/MM/dd")).alias("match_date"),
        year.alias("year"),
        F.coalesce(F.nullif(F.col("season_text"), F.lit("")), year.cast("string")).alias("season"),
        normalize_team(F.col("venue_text")).alias("venue"), "team_a", "team_b",
    )


def contributions(balls: DataFrame) -> DataFrame:
    """What each delivery adds to its striker, its bowler and the player out: one stream, one shuffle."""
    zero = F.lit(0).cast("bigint")

    def part(player: str, listed: bool, used: Column, **values: str) -> Column:
        return F.struct(F.col(player).alias("player"), F.lit(listed).alias("listed"), used.alias("_used"),
                        *[(F.col(values[m]).cast("bigint") if m in values else zero).alias(m) for m in MEASURES])

    # three parts of every delivery, of which the last may be unused: a plain array is compiled, a filtered one is not
    parts = F.array(
        part("striker", True, F.lit(True), runs="bat_runs", balls_faced="legal"),
        part("bowler", True, F.lit(True), runs_conceded="conceded", balls_bowled="legal", wickets="bowler_wicket"),
        part("player_out", False, F.coalesce(F.col("is_out") == 1, F.lit(False)), dismissals="is_out"))
    return balls.select("match_id", F.inline(parts)).filter("_used").drop("_used")


def player_facts(balls: DataFrame, squads: DataFrame | None = None) -> DataFrame:
    """Sums per (match, player) over squad members, strikers and bowlers; absent parts are 0.

    ``squads`` has (match_id, player, team, row_order). Someone who was only
    dismissed is not part of the universe.
    """
    # sums alone are fixed-width and fold in hash tables map-side; team names are folded apart from them
    keys = ["match_id", "player"]
    sums = contributions(balls).groupBy(*keys).agg(
        F.max("listed").alias("_listed"), *[F.sum(m).cast("double").alias(m) for m in MEASURES])
    if squads is None:
        return sums.filter("_listed").drop("_listed").withColumn("team", F.lit(None).cast("string"))
    # a squad names a player once, so nothing folds before the shuffle: sorted once, after it
    teams = squads.repartition(*keys).groupBy(*keys).agg(F.max_by("team", "row_order").alias("team"))
    known = sums.join(teams, keys, "full")
    return known.filter(F.coalesce("_listed", F.lit(False)) | F.col("team").isNotNull()).select(
        *keys, "team", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in MEASURES])


def squads(log: DataFrame, plural_spelling: bool = False) -> DataFrame:
    """Squad rows. Some files spell the key ``players``; they count only on request."""
    keys = ["player", "players"] if plural_spelling else ["player"]
    return log.filter((F.col("c0") == "info") & F.col("c1").isin(*keys)).select(
        "match_id", _text("c3").alias("player"), normalize_team(F.col("c2")).alias("team"), "row_order")


def opposition(team: Column, team_a: Column, team_b: Column) -> Column:
    known = (team != "") & (team_a != "") & (team_b != "")
    return F.when(known, F.when(team == team_a, team_b).otherwise(team_a)).otherwise("")


def player_match(log: DataFrame, plural_spelling: bool = False) -> DataFrame:
    """The fact table: one row per (match, player). Matches without deliveries keep their squads."""
    facts = player_facts(ball_events(log), squads(log, plural_spelling))
    team = F.coalesce(F.col("team"), F.lit(""))
    return facts.join(match_info(log), "match_id", "left").select(
        "match_id", "match_date", "year", "season", "venue", "player", team.alias("player_team"),
        opposition(team, F.coalesce("team_a", F.lit("")), F.coalesce("team_b", F.lit(""))).alias("opposition"),
        *MEASURES, F.concat("match_id", F.lit(".csv")).alias("source_file"))


def players(log: DataFrame, plural_spelling: bool = False) -> DataFrame:
    """The different players of ``player_match``, without its sums: strikers, bowlers and squad members with a team."""
    balls = log.filter(F.col("c0") == "ball").select(F.explode(F.array(_text("c4"), _text("c6"))).alias("player"))
    named = squads(log, plural_spelling).filter(F.col("team").isNotNull() & F.col("row_order").isNotNull())
    return balls.unionByName(named.select("player")).distinct()


# --- statistics -----------------------------------------------------------------------

def measure_sums() -> list[Column]:
    return [F.sum(m).alias(m) for m in MEASURES]


def statistics() -> dict[str, Column]:
    """All five statistics over summed measures; NULL where there is nothing to divide by."""
    return {
        "batting_average": ratio(F.col("runs"), F.col("dismissals"), None),
        "strike_rate": ratio(F.col("runs") * 100.0, F.col("balls_faced"), None),
        "economy_rate": ratio(F.col("runs_conceded") * 6.0, F.col("balls_bowled"), None),
        "runs_total": F.col("runs"),
        "wickets_total": F.col("wickets"),
    }


def chosen_statistic(stat_type: Column) -> Column:
    out = None
    for name, value in statistics().items():
        cond = stat_type == name
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def player_stats(rows: DataFrame, by: Sequence[str] = ("player",)) -> DataFrame:
    summed = rows.groupBy(*by).agg(*measure_sums())
    return summed.select(*by, *[c.alias(n) for n, c in statistics().items()])


def last_n(rows: DataFrame, n: int, by: Sequence[str] = ("player",)) -> DataFrame:
    """Newest ``n`` matches per player (``n`` = 0: all). Equal dates go by match id."""
    if n == 0:
        return rows
    return top_per_group(rows, by, [F.desc_nulls_last("match_date"), F.asc("match_id")], max(1, n)).drop("_rank")


def this_season_stats(rows: DataFrame, by: Sequence[str] = ("player",)) -> DataFrame:
    """Statistics over the greatest season of each player: two aggregates, no window over rows."""
    seasons = rows.groupBy(*by, "season").agg(*measure_sums())
    latest = seasons.groupBy(*by).agg(F.max(F.struct("season", *MEASURES)).alias("_s")).select(*by, "_s.*")
    return latest.select(*by, "season", *[c.alias(k) for k, c in statistics().items()])


def this_season_rows(rows: DataFrame, by: Sequence[str] = ("player",)) -> DataFrame:
    latest = rows.groupBy(*by).agg(F.max("season").alias("season"))
    return rows.join(latest, [*by, "season"], "left_semi")
