import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from prosegauge.lexicons import SPLIT_COLUMNS
from prosegauge.operators import submissions as su
from prosegauge.plans.corpus_build import build_corpus
from prosegauge.plans.submission_flow import process_submissions
from prosegauge.sources import readers as rd, sinks as sk
from prosegauge.streaming import jobs


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"Full_Text"\n1,"hello, ""you"""\n2,\n')
    assert [r.text for r in rd.read_text_csv(spark, str(tmp_path / "a.csv")).collect()] == ['hello, "you"', ""]
    assert rd.pick_text_column(["x", "Tweet"]) == "Tweet" and rd.pick_text_column(["x", "y"]) == "x"
    (tmp_path / "s.json").write_text(json.dumps([
        {"id": 1, "text": "a", "expected_stance": "X", "expected_score_band": [1.0, 2.0]}, {"id": 2, "text": ""},
        {"id": 3, "text": "b"}]))
    assert [r.id for r in rd.read_samples(spark, str(tmp_path / "s.json")).collect()] == [1]
    (tmp_path / "d.txt").write_text("one\n---\n  \n---\ntwo lines\nhere\n")
    assert [r.text for r in rd.read_delimited_docs(spark, str(tmp_path / "d.txt"), "---").collect()] == [
        "one", "two lines\nhere"]


def test_sinks(spark, frame, tmp_path):
    df = frame([("t", "X", 0.5, [1.0, 2.0])], "text string, stance_label string, confidence double, "
                                              "expected_score_band array<double>")
    sk.write_fixed_csv(df, str(tmp_path / "c"), SPLIT_COLUMNS)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert back.columns == SPLIT_COLUMNS and back.first().expected_score_band == "[1.0,2.0]"
    first = sk.materialize(df, str(tmp_path / "m"), 1)
    again = sk.materialize(df.withColumn("text", F.lit("changed")), str(tmp_path / "m"), 1)
    assert first.first().text == again.first().text == "t"
    assert sk.materialize(df.withColumn("text", F.lit("v2")), str(tmp_path / "m"), 2).first().text == "v2"
    sk.write_embeddings(frame([(1, [3.0, 4.0])], "id int, embedding array<double>"), str(tmp_path / "e"))
    assert rd.read_table(spark, "e", root=str(tmp_path)).first().embedding == pytest.approx([0.6, 0.8])
    scored = su.quick_score(frame([("u", "we won", dt.datetime(2024, 1, 2))],
                                  "user_id string, text string, request_timestamp timestamp"))
    for _ in range(2):
        sk.append_scores(scored, str(tmp_path / "h"))
    hist = spark.read.parquet(str(tmp_path / "h"))
    assert hist.count() == 2 and hist.first().text_length == 6 and hist.first().month == "2024-01"
    sk.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().stance_label == "X"


def requests(frame, n=40):
    t0 = dt.datetime(2024, 1, 25)
    rows = [(i, f"u{i % 3}", t0 + dt.timedelta(hours=11 * i), "bqs" if i % 5 == 0 else "eqs", i % 4 != 0,
             float(30 + i), "balanced" if i % 2 else "odd") for i in range(n)]
    return frame(rows, "id bigint, user_id string, ts timestamp, model string, success boolean, eqs_score double, "
                       "stance_label string")


def run_stream(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"select * from {name}")


@pytest.fixture
def stream(spark, frame, tmp_path):
    df = requests(frame)
    for part in range(2):
        df.filter(F.col("id").between(part * 20, part * 20 + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))


def test_stream_quota_equals_batch(stream):
    batch, live = stream
    out = run_stream(jobs.stream_quota(live), "update", "quota")
    got = out.groupBy("user_id", "model", "period_start").agg(F.max("request_count").alias("n"))
    want = su.quota_status(batch, 5).select("user_id", "model", "period_start", F.col("request_count").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_decisions_and_profiles_equal_batch(stream):
    batch, live = stream
    got = {r.id: (r.used_before, r.allowed) for r in run_stream(
        jobs.stream_quota_decisions(live, 3, lateness="40 days"), "append", "decisions").collect()}
    want = {r.id: (r.used_before, r.allowed) for r in su.quota_decisions(batch, 3).collect()}
    assert got == want
    prof = run_stream(jobs.stream_profiles(live), "update", "profiles")
    last = {r.user_id: r for r in prof.groupBy("user_id").agg(F.max_by(
        F.struct("avg_eqs_score", "writing_style", "reputation_points"), "total_submissions").alias("p"),
        F.max("total_submissions").alias("n")).collect()}
    for r in su.writer_profiles(batch).collect():
        mine = last[r.user_id]
        assert mine.n == r.total_submissions and mine.p.avg_eqs_score == pytest.approx(r.avg_eqs_score)
        assert (mine.p.writing_style, mine.p.reputation_points) == (r.writing_style, r.reputation_points)


def test_stream_scores(spark, frame, tmp_path):
    frame([(1, "we won"), (2, "poor")], "doc_id int, text string").write.parquet(str(tmp_path / "docs"))
    live = spark.readStream.schema("doc_id int, text string").parquet(str(tmp_path / "docs"))
    q = jobs.stream_scores(live, su.quick_score, str(tmp_path / "out"), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.doc_id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 62.0, 2: 38.0}


def test_submission_flow_and_corpus(frame):
    t0 = dt.datetime(2024, 1, 1)
    df = frame([(1, "u", t0, "a good long text", "eqs"), (2, "u", t0 + dt.timedelta(hours=1), "a good long text", "eqs"),
                (3, "u", t0 + dt.timedelta(hours=2), "short", "eqs")],
               "id bigint, user_id string, ts timestamp, text string, model string")
    remote = frame([(1, 80.0, 0.9)], "id bigint, remote_score double, remote_confidence double")
    got = {r.id: r for r in process_submissions(df, remote, 1).collect()}
    assert got[1].eqs_score == 80.0 and got[2].reject_reason == "quota_exceeded"
    assert got[3].reject_reason == "text_too_short"
    docs = frame([(i, f"The cricket selection number {i} was good because of form.") for i in range(10)],
                 "doc_id bigint, text string")
    out = build_corpus(docs).collect()
    assert len(out) == 10 and sum(r.split == "train" for r in out) == 8


def test_streams_run_to_end_equal_batch(stream):
    batch, live = stream
    use = jobs.run_to_end(jobs.stream_quota(live), "update", ["user_id", "model", "period_start"])
    want = su.quota_status(batch, 5).select("user_id", "model", "period_start", "request_count")
    assert sorted(map(tuple, use.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    decided = jobs.run_to_end(jobs.stream_quota_decisions(live, 3))
    assert decided.count() == batch.count()
