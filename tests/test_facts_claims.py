import pytest
from pyspark.sql import functions as F

from prosegauge.operators import claims as cl, facts as fa
from prosegauge.sources.readers import read_ball_log

MATCH = """version,1.7.0
info,team,Reds
info,team,Blues
info,season,{season}
info,date,{date}
info,venue,"Park, North"
info,{key},Reds,A Batter
info,{key},Blues,B Bowler
"""
BALLS = """ball,1,0.1,Reds,A Batter,C Other,B Bowler,4,0,,,,,,"",""
ball,1,0.2,Reds,A Batter,C Other,B Bowler,0,1,1,,,,,"",""
ball,1,0.3,Reds,A Batter,C Other,B Bowler,1,1,,1,,,,"",""
ball,1,0.4,Reds,C Other,A Batter,B Bowler,0,0,,,,,,run out,A Batter
ball,1,0.5,Reds,C Other,A Batter,B Bowler,0,0,,,,,,bowled,C Other
ball,1,0.6,Reds,D Hurt,A Batter,B Bowler,0,0,,,,,5,retired hurt,D Hurt
"""


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("log")
    (root / "m1.csv").write_text(MATCH.format(season="2023/24", date="2024/01/05", key="player") + BALLS)
    (root / "m2.csv").write_text(MATCH.format(season="", date="2025/02/06", key="players"))
    return read_ball_log(spark, str(root))


def test_player_match(log):
    rows = {(r.match_id, r.player): r for r in fa.player_match(log).collect()}
    a, b, d = rows["m1", "A Batter"], rows["m1", "B Bowler"], rows["m1", "D Hurt"]
    # wide and no-ball are not balls faced; the run out counts as a dismissal
    assert (a.runs, a.balls_faced, a.dismissals) == (5.0, 1.0, 1.0)
    # bat 5 + wide 1 + no-ball 1 + penalty 5; only "bowled" is the bowler's wicket
    assert (b.runs_conceded, b.balls_bowled, b.wickets) == (12.0, 4.0, 1.0)
    assert d.dismissals == 0.0 and d.player_team == "" and d.opposition == ""
    assert (a.player_team, a.opposition, a.venue, a.season, a.year) == ("Reds", "Blues", "Park, North", "2023/24", 2024)
    assert not [k for k in rows if k[0] == "m2"]
    both = {(r.match_id, r.player): r for r in fa.player_match(log, plural_spelling=True).collect()}
    assert both["m2", "A Batter"].season == "2025" and both["m2", "A Batter"].runs == 0.0


def test_facts_shuffle_a_match_once_and_compile_their_parts(log):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(fa.match_info(log)).count("Exchange hashpartitioning") == 1
    assert "lambda" not in plan(fa.contributions(fa.ball_events(log)))
    parts = fa.contributions(fa.ball_events(log))
    assert sorted(r.player for r in parts.filter("NOT listed").collect()) == ["A Batter", "C Other"]


def facts(frame):
    rows = [("m1", "2024-01-01", 2024, "2024", "Park", "V Kohli", "T1", "T2", 50.0, 40.0, 1.0),
            ("m2", "2024-02-01", 2024, "2024", "Park", "V Kohli", "T1", "T3", 30.0, 20.0, 0.0),
            ("m3", "2025-01-01", 2025, "2025", "Oval", "V Kohli", "T1", "T2", 100.0, 50.0, 1.0),
            ("m3", "2025-01-01", 2025, "2025", "Oval", "R Sharma", "T1", "T2", 10.0, 20.0, 0.0)]
    df = frame(rows, "match_id string, match_date string, year int, season string, venue string, player string, "
                     "player_team string, opposition string, runs double, balls_faced double, dismissals double")
    return df.withColumns({"match_date": F.to_timestamp("match_date"), "runs_conceded": F.lit(0.0),
                           "balls_bowled": F.lit(0.0), "wickets": F.lit(0.0)})


def test_statistics_and_windows(frame):
    f = facts(frame)
    stats = {r.player: r for r in fa.player_stats(f).collect()}
    assert stats["V Kohli"].batting_average == 90.0 and stats["R Sharma"].batting_average is None
    assert stats["V Kohli"].economy_rate is None
    last = {r.player: r for r in fa.player_stats(fa.last_n(f, 2)).collect()}
    assert last["V Kohli"].runs_total == 130.0
    assert fa.last_n(f, 0).count() == 4
    season = {r.player: r for r in fa.this_season_stats(f).collect()}
    assert season["V Kohli"].runs_total == 100.0
    assert fa.this_season_rows(f).count() == 2


CLAIMS = [
    ("In the last 2 matches Kohli has runs of 130", "runs_total", 2, None, None, None, None, 130.0),
    ("strike rate of 120.5 this season against India A", "strike_rate", None, "this_season", None, None, "India A", 120.5),
    # the number next to the metric word is taken, even where it is a year
    ("average between 2024 and 2021 was 30 at The Oval", "batting_average", None, None, 2021, 2024, None, 2024.0),
    ("last 0 innings economy", "economy_rate", 0, None, None, None, None, 0.0),
    ("a wicket without number", "wickets_total", None, None, None, None, None, None),
]


def test_claim_attributes(frame):
    df = frame([(i, r[0]) for i, r in enumerate(CLAIMS)], "i int, sentence string")
    got = cl.claim_attributes(df).orderBy("i").collect()
    for g, (_, kind, n, season, lo, hi, opp, value) in zip(got, CLAIMS):
        assert (g.stat_type, g.window_size, g.season, g.year_lo, g.year_hi, g.opposition, g.claimed_value) == (
            kind, n, season, lo, hi, opp, value)
    assert got[2].venue == "Oval"


def test_verdict_borders(frame):
    df = frame([(105.0, 100.0), (110.0, 100.0), (111.0, 100.0), (1.0, None), (None, 5.0)],
               "claimed_value double, computed_value double")
    got = [(r.stats_found, r.stats_verified, r.stat_accuracy_score, r.stat_confidence)
           for r in cl.claim_verdict(df).collect()]
    assert got == [(True, True, 1.0, "high"), (True, False, 0.6, "medium"), (True, False, 0.0, "high"),
                   (False, False, 0.0, "low"), (True, False, 0.0, "low")]


def test_verify_documents(frame):
    docs = frame([
        (1, "In the last 1 matches Kohli's tally has runs of 100. V Kohli has a strike rate of 150 at Park; "
            "R Sharma has runs of 99 against T2 now."),
        (2, "nobody has 10 runs"), (3, ""), (4, "the great v kohli has an average of 90."),
    ], "doc_id int, text string")
    f = facts(frame)
    mentions = cl.stat_mentions(docs, f).orderBy("doc_id", "claim_ix").collect()
    assert [(m.doc_id, m.player, m.computed_value) for m in mentions] == [
        (1, "V Kohli", 100.0), (1, "V Kohli", pytest.approx(133.33)), (1, "R Sharma", 10.0), (4, "V Kohli", 90.0)]
    got = {r.doc_id: r for r in cl.verify_documents(docs, f).collect()}
    assert got[1].stats_found and not got[1].stats_verified
    assert got[1].stat_accuracy_score == pytest.approx(1 / 3, abs=1e-4)
    assert got[4].stats_verified and got[4].stat_score_adjustment == 1.0
    assert not got[2].stats_found and not got[3].stats_found and got[3].stat_confidence == "low"


def test_resolve_dimension(frame):
    dim = frame([("India",), ("India A",), ("West Indies",)], "team string")
    df = frame([("india",), ("the India A side",), ("Indies",), ("Mars",), (None,)], "v string")
    got = sorted(str(r.v) for r in cl.resolve_dimension(df, "v", dim, "team").collect())
    assert got == sorted(["India", "India", "West Indies", "Mars", "None"])


def test_contained_pairs_equal_brute_force(frame):
    import random

    draw = random.Random(6)
    words = {"".join(draw.choice("ab é") for _ in range(draw.randint(0, 9))) for _ in range(150)} | {"x" * 2000 + "ab", "x" * 1999, "b"}
    df = frame([(w,) for w in words], "w string")
    got = cl.contained_pairs(df.select(F.col("w").alias("_i")), df.select(F.col("w").alias("_o"))).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a in words for b in words if a and a in b)


def test_long_values_resolve(frame):
    long = "park " * 400
    dims = frame([(long + "end",), ("Oval",)], "d string")
    asked = frame([(1, long + "END of it"), (2, "oval"), (3, "rk park"), (4, "nowhere"), (5, None)], "id int, v string")
    got = {r.id: r.v for r in cl.resolve_dimension(asked, "v", dims, "d").collect()}
    assert got == {1: long + "end", 2: "Oval", 3: long + "end", 4: "nowhere", 5: None}


def test_players_are_those_of_the_fact_table(frame):
    def line(match, order, **cells):
        return (match, *[cells.get(f"c{i}") for i in range(16)], order)

    rows = [line("m", 1, c0="ball", c4="A", c6="B", c7="1", c14="bowled", c15="Only Out"), line("m", 2, c0="ball", c4="A", c6=None, c7="x"),
            line("m", 3, c0="info", c1="player", c2=None, c3="No Team"), line("n", None, c0="info", c1="player", c2="T", c3="No Order"),
            line("n", 4, c0="info", c1="players", c2="T", c3="Plural"), line(None, 5, c0="info", c1="player", c2="T", c3="No Match")]
    log = frame(rows, "match_id string, " + ", ".join(f"c{i} string" for i in range(16)) + ", row_order bigint")
    for plural in (False, True):
        want = {r.player for r in fa.player_match(log, plural).select("player").distinct().collect()}
        found = [r.player for r in fa.players(log, plural).collect()]
        assert set(found) == want and len(found) == len(want) and ("Plural" in want) == plural
    # no sums and no matches are made to name them
    assert "sum" not in fa.players(log)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_names_are_not_searched_in_every_fact(frame, monkeypatch):
    seen, search = [], cl.extract_mentions
    monkeypatch.setattr(cl, "extract_mentions", lambda texts, players, *more, **named: (
        seen.append(players), search(texts, players, *more, **named))[1])
    rows = facts(frame)
    cl.stat_mentions(frame([(1, "V Kohli has runs of 180.")], "doc_id int, text string"), rows.unionAll(rows))
    # both searches read one list of different names, so no name pattern is pushed down to the facts
    assert len(seen) == 2 and seen[0] is seen[1]
    plan = cl.mention_keys(seen[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan and "LogicalRDD" not in plan and "runs" not in plan and "parquet" in plan
    assert sorted(r.player for r in seen[0].collect()) == ["R Sharma", "V Kohli"]
