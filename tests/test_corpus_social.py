import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from prosegauge.operators import clean, corpus, evaluate as ev, scale, social as so, submissions as su

T0 = dt.datetime(2024, 1, 30, 10)


def test_clean_keeps_first_of_copies(frame):
    df = frame([(3, "Good match today"), (1, " good MATCH today "), (2, "rt @x match"), (4, "#match"), (5, "nothing")],
               "doc_id int, text string")
    got = clean.clean_texts(df, ["doc_id"], ["match"]).collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, "good MATCH today")]


def test_split_is_exact_and_repeatable(frame):
    rows = [(i, "big" if i % 3 else "mid") for i in range(300)] + [(1000, "one"), (2000, "two"), (2001, "two")]
    df = frame(rows, "doc_id int, lang string")
    out = corpus.stratified_split(df, "lang", "doc_id", 0.8, 42, digits=1)
    got = {(r.lang, r.split): r.n for r in out.groupBy("lang", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {("big", "train"): 160, ("big", "test"): 40, ("mid", "train"): 80, ("mid", "test"): 20,
                   ("one", "train"): 1, ("two", "train"): 1, ("two", "test"): 1}
    again = corpus.stratified_split(df.repartition(7), "lang", "doc_id", 0.8, 42)
    assert {(r.doc_id, r.split) for r in again.collect()} == {(r.doc_id, r.split) for r in out.collect()}
    m = corpus.split_manifest(out, "lang").first()
    assert (m.total_rows, m.train_rows) == (303, 242) and m.class_distribution_test == {"big": 40, "mid": 20, "two": 1}


def test_rebalance(frame):
    df = frame([(i, "A" if i < 50 else "B", f"t{i}") for i in range(53)], "doc_id int, lab string, text string")
    out = corpus.rebalance(df, "lab", "doc_id", 10, labels=["B", "A"]).orderBy("id").collect()
    assert [r.id for r in out] == list(range(1, 21)) and [r.lab for r in out] == ["B"] * 10 + ["A"] * 10
    b = [r for r in out if r.lab == "B"]
    assert sum(r.source == "synthetic_balance" for r in b) == 7 and len({r.doc_id for r in b}) == 3
    assert all(r.source == "original" for r in out if r.lab == "A")


def test_labels_and_targets(frame):
    df = frame([("useless trash",), ("should could improve",), ("plain",)], "text string")
    got = corpus.heuristic_label(df).collect()
    assert [r.expected_stance for r in got] == ["DIRECT_ATTACK", "CONSTRUCTIVE_CRITICISM", "NEUTRAL_ANALYSIS"]
    assert got[0].expected_score_band == [0.0, 25.0]
    t = corpus.heuristic_targets(frame([("you are a clown",), ("because we should",)], "text string")).collect()
    assert [(r.constructive_target, r.toxic_target) for r in t] == [(0, 1), (1, 0)]


def subs(frame, scores, user="u"):
    rows = [(i, user, T0 + dt.timedelta(hours=9 * i), s, "eqs", s is not None) for i, s in enumerate(scores)]
    return frame(rows, "id bigint, user_id string, ts timestamp, eqs_score double, model string, success boolean")


def fold(scores):
    avg, out = None, []
    for n, s in enumerate(scores):
        if s is not None:
            avg = s if avg is None else (avg * n + s) / (n + 1)
        out.append(avg)
    return out


def test_running_average_matches_the_fold(frame):
    rnd = random.Random(3)
    scores = [None if rnd.random() < 0.3 else round(rnd.uniform(20, 95), 2) for _ in range(60)]
    got = su.running_average(subs(frame, scores), ["eqs_score"]).orderBy("id").collect()
    assert [r.n for r in got] == list(range(1, 61))
    for r, want in zip(got, fold(scores)):
        assert (r.avg_eqs_score is None) == (want is None)
        assert want is None or r.avg_eqs_score == pytest.approx(want, rel=1e-9)
    prof = su.writer_profiles(subs(frame, scores).withColumn("stance_label", F.lit("balanced"))).first()
    best = max(int((a or 0) * n / 10 + 1e-9) for n, a in enumerate(fold(scores), 1))
    assert prof.reputation_points == best and prof.total_submissions == 60 and prof.writing_style == "balanced"
    full = [50.0, 60.0, 70.0]
    assert su.writer_profiles(subs(frame, full), null_free=True).first().avg_eqs_score == pytest.approx(60.0)


def test_quota_over_two_months(frame):
    df = subs(frame, [50.0] * 10)
    got = su.quota_decisions(df, 3).orderBy("id").collect()
    months, used = {}, []
    for r in got:
        k = r.ts.month
        used.append(months.get(k, 0))
        months[k] = months.get(k, 0) + 1
    assert [r.used_before for r in got] == used and [r.allowed for r in got] == [u < 3 for u in used]
    status = {r.period_start.month: r.status for r in su.quota_status(df, 5).collect()}
    assert status[1] == ("blocked" if months[1] >= 5 else "warning" if months[1] >= 4 else "active")
    free = df.withColumn("model", F.lit("bqs"))
    assert all(r.allowed and r.used_before == 0 for r in su.quota_decisions(free, 1).collect())


def test_routing_and_validation(frame):
    df = frame([(1, "we won the match", "eqs"), (2, "we won the match", "bqs"), (3, "poor plan today", "eqs"), (4, "x", "eqs")],
               "id int, text string, model string")
    remote = frame([(1, 88.0, 0.9), (2, 10.0, 0.9)], "id int, remote_score double, remote_confidence double")
    got = {r.id: (r.model_version, r.eqs_score) for r in su.route_scores(df, remote).collect()}
    assert got[1] == ("EQS-remote-v1", 88.0) and got[2] == ("EQS-local", 62.0)
    assert got[3] == ("EQS-local-fallback", 42.0)
    assert [r.reject_reason for r in su.validate_submissions(df).orderBy("id").collect()][-1] == "text_too_short"


def communities(frame):
    rows = [(1, "A", "a", "batting", ["bowling"], "public", 5, 1), (2, "B", "b", "bowling", None, "public", 9, 2),
            (3, "C", "c", "general", ["batting"], "private", 50, 3)]
    return frame(rows, "id bigint, name string, slug string, primary_topic string, secondary_topics array<string>, "
                       "visibility string, member_count bigint, created_at int").withColumn("description", F.lit("d"))


def test_directory_and_discovery(frame):
    com = communities(frame)
    assert [r.id for r in so.list_communities(com, topic="batting").collect()] == [3, 1]
    assert [r.id for r in so.list_communities(com, search="b").collect()] == [2]
    writers = frame([("x", ["bowling", "batting"]), ("y", None)], "user_id string, primary_topics array<string>")
    got = {(r.user_id, r.place): r.community_id for r in so.discover_communities(writers, com, 2).collect()}
    assert got == {("x", 1): 2, ("x", 2): 1, ("y", 1): 2, ("y", 2): 1}


def test_like_minded_writers_against_brute_force(frame):
    rnd = random.Random(5)
    topics = ["batting", "bowling", "strategy", "general"]
    people = [(f"u{i}", rnd.sample(topics, rnd.randint(0, 3)), rnd.choice(["analytical", "balanced"]), rnd.randint(0, 9), rnd.randint(1, 5))
              for i in range(25)]
    users = frame([(u, u, i % 5 != 0, i % 7 != 0) for i, (u, *_) in enumerate(people)],
                  "id string, username string, is_active boolean, email_verified boolean")
    writers = frame(people, "user_id string, primary_topics array<string>, writing_style string, "
                            "reputation_points int, total_submissions int")
    ok = {f"u{i}" for i in range(25) if i % 5 and i % 7}
    got: dict = {}
    for r in so.like_minded_writers(writers, users, style="analytical", k=4).orderBy("target_id", "place").collect():
        got.setdefault(r.target_id, []).append((r.user_id, r.match_score, tuple(r.shared_topics)))
    for u, mine, *_ in people:
        cand = []
        for v, theirs, style, rep, n in people:
            shared = tuple(t for t in mine if t in theirs) if mine else tuple(theirs)
            score = 2 * len(shared) + (style == "analytical")
            if v != u and v in ok and score:
                cand.append((-score, -rep, -n, v, shared))
        assert got.get(u, []) == [(v, -s, sh) for s, _, _, v, sh in sorted(cand)[:4]], u


def test_membership_replay_against_sequential(frame):
    rnd = random.Random(9)
    cmds = [(i, T0 + dt.timedelta(hours=5 * i), rnd.randint(1, 4), f"u{rnd.randint(0, 3)}", rnd.choice(["join", "leave"]))
            for i in range(200)]
    members = {(1, "u0"): "owner", (1, "u1"): "member", (3, "u2"): "member"}
    df = frame(cmds, "cmd_id bigint, ts timestamp, community_id bigint, user_id string, command string")
    mem = frame([(c, u, r) for (c, u), r in members.items()], "community_id bigint, user_id string, role string")
    com = communities(frame)
    got = {r.cmd_id: r.accepted for r in so.apply_membership(df, mem, com).collect()}
    state, public = dict(members), {1, 2}
    for i, _, c, u, cmd in cmds:
        if cmd == "join":
            ok = c in public and (c, u) not in state
            if ok:
                state[c, u] = "member"
        else:
            ok = state.get((c, u)) == "member"
            if ok:
                del state[c, u]
        assert got[i] == ok, (i, c, u, cmd)


def test_creations_against_sequential(frame):
    rnd = random.Random(2)
    cmds = [(i, T0 + dt.timedelta(minutes=i), f"s{rnd.randint(0, 12)}", f"n{rnd.randint(0, 12)}") for i in range(60)]
    df = frame(cmds, "cmd_id bigint, ts timestamp, slug string, name string")
    existing = frame([("s0", "n1")], "slug string, name string")
    slugs, names, want = {"s0"}, {"n1"}, set()
    for i, _, s, n in cmds:
        if s not in slugs and n not in names:
            slugs.add(s), names.add(n), want.add(i)
    assert {r.cmd_id for r in so.apply_creations(df, existing).collect()} == want


def test_group_rank_and_null_keys(frame):
    df = frame([("a" if i % 4 else None, f"{i:05d}") for i in range(40)], "g string, h string")
    got = scale.group_rank(df, "g", "h", digits=4).collect()
    for g in ("a", None):
        mine = sorted((r.h, r._rank) for r in got if r.g == g)
        assert [k for _, k in mine] == list(range(1, len(mine) + 1))
    assert len(got) == 40


def test_evaluation(frame):
    df = frame([(1, 1, 1), (2, 1, 0), (3, 0, 0), (4, 0, 0)], "id int, p int, t int")
    r = ev.binary_report(df, "p", "t").first()
    assert (r.accuracy_percent, r.fp, r.fn, r.fp_percent, r.fn_percent) == (75.0, 1, 0, 33.33, 0.0)
    h = {x.bin_start: x.n for x in ev.score_histogram(frame([(100.0,), (0.0,), (-3.0,), (55.0,)], "s double"), "s").collect()}
    assert h[90] == 1 and h[0] == 2 and h[50] == 1 and len(h) == 10
    bands = frame([("A", "A", 50.0, 40.0, 60.0, 0.5, 0.0, 0.1, 0.0, 0.0, 1.0)],
                  "expected string, predicted string, score double, score_lo double, score_hi double, toxicity double, "
                  "toxicity_lo double, toxicity_hi double, supportive double, supportive_lo double, supportive_hi double")
    assert ev.band_report(bands).first().n_toxicity_band_miss == 1
    flags = ev.repair_pass(frame([("Non-constructive complaint", 70.0, True, 0.0, 1.0, 0.0, 0.0, 0.0)],
                                 "category string, final_score double, predicted_constructive boolean, toxicity_mean double, "
                                 "fan_sincerity double, mean_discourse double, mean_depth double, mean_suggestion double"), True).first()
    assert flags.final_score == 56.0 and not flags.predicted_constructive


def test_neighbours_against_brute_force(frame):
    rnd = random.Random(1)
    vecs = [(i, [rnd.gauss(0, 1) for _ in range(8)], i % 3) for i in range(70)]
    df = frame(vecs, "id bigint, embedding array<float>, label int")
    got: dict = {}
    near = ev.nearest(df, df, 5, leave_one_out=True)
    for r in near.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.sample_id)
    exact = {r.id: r.embedding for r in df.collect()}
    for i, v in exact.items():
        sims = sorted((-round(sum(a * b for a, b in zip(v, w)), 9), j) for j, w in exact.items() if j != i)
        assert got[i] == [j for _, j in sims[:5]]
    c = ev.label_centroids(df).collect()
    assert len(c) == 3 and all(sum(x * x for x in r.centroid) == pytest.approx(1.0) for r in c)
    p = ev.loo_label_scores(df, 5).groupBy("id").agg(F.sum("probability").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-3 for r in p)


def test_neighbours_of_a_bank_of_many_parts(frame, monkeypatch):
    rnd = random.Random(2)
    # few different components, so that similarities tie within and across parts; an id twice; a NULL vector
    rows = [(i, [float(rnd.randint(-1, 1)) for _ in range(4)], i % 3) for i in range(70)] + [(5, [1.0, 1.0, 0.0, 0.0], 2), (99, None, 1)]
    df = frame(rows, "id bigint, embedding array<float>, label int")
    for alone in (True, False):
        whole = sorted(map(tuple, ev.nearest(df, df, 6, leave_one_out=alone).collect()))
        with monkeypatch.context() as m:
            m.setattr(ev, "BANK_ROWS", 9)
            assert sorted(map(tuple, ev.nearest(df, df, 6, leave_one_out=alone).collect())) == whole
        vectors = [(i, v) for i, v, _ in sorted(rows, key=lambda r: (r[0], r[2])) if v]
        wanted = []
        for i, v in vectors:
            sims = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in vectors if j != i or not alone)
            wanted += [(i, n, j, -s) for n, (s, j) in enumerate(sims[:6], 1)]
        assert sorted((a, n, b, s) for a, n, b, _, s in whole) == sorted(wanted)


def test_pages_by_cursor_cover_the_directory(frame):
    rnd = random.Random(4)
    rows = [(i, f"n{i}", "", "batting", None, "public" if i % 4 else "private", None if i % 9 == 0 else rnd.randint(0, 5)) for i in range(40)]
    df = frame(rows, "id bigint, name string, description string, primary_topic string, secondary_topics array<string>, "
                     "visibility string, created_at bigint").withColumn("created_at", F.col("created_at").cast("timestamp"))
    whole = [r.id for r in df.filter("visibility = 'public'").orderBy(F.col("created_at").desc_nulls_last(), "id").collect()]
    seen, after = [], None
    for _ in range(20):
        page = so.community_page(df, 7, after, visibility="public").collect()
        assert {r.total for r in page} <= {len(whole)}
        seen += sorted((r.id for r in page), key=whole.index)
        if not page or page[0].next_id is None:
            break
        after = (page[0].next_created_at, page[0].next_id)
    assert seen == whole
    assert so.community_page(df, 7, after=None, search="nothing like it").count() == 0
