"""Nothing is cut: windows of any size, all patterns, vectors of any length, keys that do not collide, hot days."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from prosegauge.lexicons import LEXICON
from prosegauge.operators import evaluate as ev, signals as si, stance as st, submissions as su
from prosegauge.operators.scale import first_rows, running, top_by_own_limit
from prosegauge.plans.demo import DEMO


def test_limits_above_a_thousand_rows(spark):
    rows = spark.range(2400).select((F.col("id") % 2).alias("g"), "id", F.when(F.col("id") % 2 == 0, 1100).otherwise(3).alias("size"))
    got = top_by_own_limit(rows, ["g"], [F.col("id").desc()], "size", ["id"]).groupBy("g").agg(F.count("*"), F.min("id"))
    assert sorted(map(tuple, got.collect())) == [(0, 1100, 200), (1, 3, 2395)]


@pytest.mark.parametrize("lists", [LEXICON, DEMO])
def test_every_attack_pattern_is_tried(frame, lists):
    text = frame([("that player is bad and you are bad",), ("he is",), ("nothing",)], "text string")
    got = [r[0] for r in text.select(si.abuse_indicator(F.col("text"), {**lists, "abuse_words": ["zzz"]})).collect()]
    assert got == pytest.approx([0.3, 0.15, 0.0])


def test_patterns_do_not_depend_on_word_lists(frame):
    paras = frame([(1, 1, "Brilliant plan, mistake again"), (1, 2, "critics say it failed but it did not")],
                  "doc_id int, para_ix int, text string")
    scores = [[r.contradiction_score for r in st.sarcasm(paras, lex).orderBy("para_ix").collect()] for lex in (
        LEXICON | {"sarcasm_praise": ["zzz"]}, DEMO | {"sarcasm_praise": ["zzz"]})]
    assert scores == [[0.5, 0.0], [0.5, 0.0]]
    flags = [r.contrast_rejection_detected for r in st.quote_flags(paras, DEMO).orderBy("para_ix").collect()]
    assert flags == [False, True]


def test_centroids_take_the_length_from_the_vectors(frame):
    data = frame([(1, "a", [1.0, 2.0, 3.0]), (2, "a", [3.0, 2.0, 1.0])], "id int, label string, embedding array<double>")
    assert ev.label_centroids(data, unit_length=False).first().centroid == [2.0, 2.0, 2.0]
    uneven = data.union(frame([(3, "a", [1.0])], "id int, label string, embedding array<double>"))
    with pytest.raises(Exception, match="unequal length"):
        ev.label_centroids(uneven).collect()


def test_keys_do_not_collide(frame):
    rows = frame([("a\u0001b", "c", 1), ("a", "b\u0001c", 2), (None, "\u0000", 3), ("\u0000", None, 4), ("a", "b\u0001c", 5)],
                 "x string, y string, id int")
    assert sorted(r.id for r in first_rows(rows, [F.col("x"), F.col("y")], [F.col("id")]).collect()) == [1, 2, 3, 4]


def test_a_user_with_all_rows_of_one_day(spark):
    start = dt.datetime(2024, 1, 1)
    rows = spark.range(3000).select(
        F.col("id"), F.lit("u").alias("user_id"), (F.lit(start) + F.make_dt_interval(secs=F.col("id"))).alias("ts"),
        F.when(F.col("id") % 7 != 0, (F.col("id") * 37 % 101).cast("double")).alias("eqs_score"))
    got = su.running_average(rows, ["eqs_score"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") + plan.count("Range (") <= 2
    average, n = None, 0
    want = {}
    for i in range(3000):
        if i % 7:
            x = float(i * 37 % 101)
            average = x if average is None else (average * n + x) / (n + 1)
        n += 1
        want[i] = average
    for r in got.collect():
        assert r.n == r.id + 1 and (r.avg_eqs_score == pytest.approx(want[r.id]) if want[r.id] is not None else r.avg_eqs_score is None)
    total = running(rows, ["user_id"], ["ts", "id"], sums={"s": F.col("id")}).filter("id = 2999").first().s
    assert total == 2999 * 3000 // 2
