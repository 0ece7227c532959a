"""Neighbours by pivots, label centroids with features, and benchmark probabilities against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosegauge.lexicons import LEXICON, STANCES
from prosegauge.operators import benchmark as bm, evaluate as ev, neighbours as ne, stance as st

SCHEMA = "id bigint, embedding array<double>, label int"


def plain(rows, k, alone):
    out = []
    for i, v, _ in rows:
        if v is None:
            continue
        sims = []
        for j, w, label in rows:
            if w is None or (alone and i == j) or len(w) != len(v):
                continue
            s = round(sum(a * b for a, b in zip(v, w)), 9)
            if math.isfinite(s):
                sims.append((-s, j, str(label)))
        out += [(i, n, j, label, -s) for n, (s, j, label) in enumerate(sorted(sims)[:k], 1)]
    return sorted(out)


def got(df):
    return sorted((r.id, r.rank, r.sample_id, str(r.label), r.sim) for r in df.collect())


@pytest.mark.parametrize("alone", [True, False])
@pytest.mark.parametrize("rows_per_block", [5, 4096])
def test_nearest_equals_brute_force(frame, alone, rows_per_block):
    draw = random.Random(11)
    # lengths that differ, ties, copies, a hot cell, ids twice
    rows = [(i, [draw.choice([0.5, 1.0, 20.0]) * draw.randint(-3, 3) for _ in range(5)], i % 4) for i in range(250)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0, 1.0], 1) for i in range(250, 330)] + [(7, [1.0, 0.0, 0.0, 0.0, 0.0], 3), (400, None, 2)]
    df = frame(rows, SCHEMA).repartition(3)
    found = got(ne.nearest(df, df, 7, leave_one_out=alone, block_rows=rows_per_block))
    want = plain(rows, 7, alone)
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert np.allclose([r[4] for r in found], [r[4] for r in want])


def test_clustered_vectors_are_not_all_compared(frame, spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(60, 16)) * 4

    def pairs(n):
        x = centres[draw.integers(0, 60, n)] + draw.normal(size=(n, 16)) * 0.05
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = frame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
        some = df.filter("id % 20 = 0")
        compared = spark.sparkContext.accumulator(0)
        rows = ne.nearest(some, df, 5, compared=compared).collect()
        best = np.sort(x[::20] @ x.T, axis=1)[:, -5:][:, ::-1]
        mine = np.array([[r.sim for r in sorted(rows, key=lambda r: (r.id, r.rank)) if r.id == i] for i in range(0, n, 20)])
        assert np.allclose(mine, best, atol=1e-8)
        return compared.value / (n / 20)

    few, many = pairs(2000), pairs(16000)
    print(few, many)
    assert many < 0.1 * 16000 and many < 4 * few  # eight times the rows


def test_odd_vectors(frame):
    rows = [(1, [1.0, 2.0], 0), (2, [float("inf"), 1.0], 0), (3, [float("nan"), 1.0], 0), (4, [None, 1.0], 1), (5, [], 1), (6, [0.0, 0.0], 1),
            (None, [5.0, 5.0], 1), (8, [1e308, 1e308], 2), (9, [1e200, -1e200], None)]
    df = frame(rows, SCHEMA)
    found = {(r.id, r.sample_id): r.sim for r in ne.nearest(df, df, 9).collect()}
    assert found[1, 1] == 5.0 and found[1, 6] == 0.0 and (8, 8) not in found and (2, 1) not in found
    assert {j for i, j in found if i == 1} == {1, 6, 9}  # 1e308 + 2e308 is beyond the largest number
    assert ne.nearest(df.limit(0), df, 3).count() == 0 and ne.nearest(df, df.limit(0), 3).count() == 0


def test_features_of_labels_and_leaving_one_out(frame):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(4)], [draw.random() for _ in range(3)], i % 3) for i in range(40)] + [
        (50, [1.0, 0.0, 0.0, 0.0], [0.1, 0.2, 0.3], 9)]
    df = frame(rows, "id bigint, embedding array<double>, features array<double>, label int")
    for r in ev.label_centroids(df, features="features").collect():
        own = np.array([f for _, _, f, label in rows if label == r.label])
        assert np.allclose(r.feature_centroid, own.mean(0)) and r.n == len(own)
    got = {(r.id, r.label): r.probability for r in ev.loo_label_scores(df, 5, features="features").collect()}
    for i, v, f, label in rows:
        raw = {}
        others = [r for r in rows if r[0] != i]
        for s, other in sorted(((-round(float(np.dot(v, w)), 9), j, other) for j, w, _, other in others))[:5] and [
                (s, o) for s, _, o in sorted((-round(float(np.dot(v, w)), 9), j, other) for j, w, _, other in others)[:5]]:
            raw[other] = raw.get(other, 0) + max(0.0, -s) ** 2
        for one in {r[3] for r in others}:
            own = [r for r in others if r[3] == one]
            centre = np.sum([r[1] for r in own], axis=0)
            cosine = float(np.dot(centre, v) / np.linalg.norm(centre))
            near = 1 - float(np.mean(np.abs(np.mean([r[2] for r in own], axis=0) - f)))
            raw[one] = raw.get(one, 0) + 0.35 * min(1, max(0, (cosine + 1) / 2)) + 0.25 * min(1, max(0, near))
        for one, value in raw.items():
            assert got[i, one] == pytest.approx(value / sum(raw.values()), abs=1.1e-4)
    with pytest.raises(Exception, match="without features"):
        ev.label_centroids(df.withColumn("features", F.when(F.col("id") != 3, F.col("features"))), features="features").collect()


def test_benchmark_probabilities_enter_the_stance(frame):
    texts = {"DIRECT_ATTACK": " ".join(LEXICON["attack"][:2]), "SUPPORTIVE_DEFENSE": " ".join(LEXICON["supportive"][:2])}
    rows = [(i, label, text, [1.0, 0.1 * i] if label == "DIRECT_ATTACK" else [-1.0, 0.1 * i])
            for i, (label, text) in enumerate([*texts.items()] * 4)] + [(90, "no label of the bank", "x", [1.0, 1.0]), (91, STANCES[2], "y", None)]
    bank = bm.fit(frame(rows, "id bigint, label string, text string, embedding array<double>"))
    asked = frame([(1, "one two", [1.0, 0.0]), (2, None, [-1.0, 0.0]), (3, "three", None)], "id bigint, text string, embedding array<double>")
    probs = {}
    for r in bm.probabilities(asked, bank).collect():
        probs.setdefault(r.id, {})[r.label] = r.probability
    assert all(list(sorted(p)) == sorted(STANCES) and sum(p.values()) == pytest.approx(1, abs=1e-3) for p in probs.values())
    assert max(probs[1], key=probs[1].get) == "DIRECT_ATTACK" and max(probs[2], key=probs[2].get) == "SUPPORTIVE_DEFENSE"
    assert set(probs[3].values()) == {0.125}
    lines = asked.select(F.col("id").alias("doc_id"), F.lit(1).alias("para_ix"), F.lit("plain words of no list").alias("text"), "embedding")
    found = {r.doc_id: r for r in st.paragraph_stance(bm.with_benchmark(lines, bank)).collect()}
    assert found[1][st.prob("DIRECT_ATTACK")] > found[3][st.prob("DIRECT_ATTACK")] > found[2][st.prob("DIRECT_ATTACK")]
    # an empty bank: all labels alike
    nothing = bm.fit(frame([], "id bigint, label string, text string, embedding array<double>"))
    assert {r.probability for r in bm.probabilities(asked, nothing).collect()} == {0.125}


def test_bank_in_parts_equals_brute_force(frame):
    draw = random.Random(4)
    rows = [(i, [float(draw.randint(-3, 3)) for _ in range(5)], i % 4) for i in range(180)] + [(i, [1.0] * 5, 1) for i in range(180, 260)]
    df = frame(rows, SCHEMA).repartition(3)
    for alone in (True, False):
        found = got(ne.nearest(df, df, 7, leave_one_out=alone, part_rows=70, block_rows=20))
        want = plain(rows, 7, alone)
        assert [r[:3] for r in found] == [r[:3] for r in want] and np.allclose([r[4] for r in found], [r[4] for r in want])


def test_rows_of_one_vector_share_their_neighbours(frame, monkeypatch):
    rows = [(i, STANCES[i % 3], "one two", [1.0, 0.1 * i]) for i in range(9)]
    bank = bm.fit(frame(rows, "id bigint, label string, text string, embedding array<double>"))
    asked = []
    votes = ev.knn_label_votes
    monkeypatch.setattr(ev, "knn_label_votes", lambda queries, *rest: asked.append(queries.count()) or votes(queries, *rest))
    lines = frame([(1, i, f"text {i}", [1.0, 0.0]) for i in range(40)] + [(2, i, "x", None) for i in range(40)],
                  "doc_id bigint, para_ix int, text string, embedding array<double>")
    found = bm.with_benchmark(lines, bank).collect()
    assert asked == [1] and len(found) == 80
    assert {r[f"bench_{STANCES[0].lower()}"] for r in found if r.doc_id == 2} == {0.125}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_probabilities_lower_a_text_once(frame):
    """A filter on the size of an unrolled column made the features anew for each label and each use of it."""
    rows = [(i, STANCES[i % 3], "one two", [1.0, 0.1 * i]) for i in range(9)]
    bank = bm.fit(frame(rows, "id bigint, label string, text string, embedding array<double>"))
    asked = frame([(1, "Some words", [1.0, 0.0])], "id bigint, text string, embedding array<double>")
    assert optimized(bm.probabilities(asked, bank)).count("lower(") == 1


def test_centroid_scores_make_the_features_once(frame):
    rows = [(i, i % 3, "Some words", [1.0, 0.1 * i]) for i in range(9)]
    v = bm.with_features(frame(rows, "id bigint, label int, text string, embedding array<double>"))
    given = frame([(1, 9, [1.0, 0.0], [0.1] * 10)], "label int, n bigint, centroid array<double>, feature_centroid array<double>")
    assert optimized(ev.centroid_scores(v, given, features="features")).count("lower(") == 1


def test_rows_without_a_vector_are_spread(frame, spark):
    rows = [(i, STANCES[i % 3], "one two", [1.0, 0.1 * i]) for i in range(9)]
    bank = bm.fit(frame(rows, "id bigint, label string, text string, embedding array<double>"))
    lines = frame([(i, 1, "x", None) for i in range(800)] + [(900, 1, "y", [1.0, 0.0]), (901, 1, "y", [1.0, -0.0])],
                  "doc_id bigint, para_ix int, text string, embedding array<double>").repartition(4)
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {name: spark.conf.get(name) for name in plain}
    try:
        for name, value in plain.items():
            spark.conf.set(name, value)
        found = bm.with_benchmark(lines, bank).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)
    most = max(sum(r.task == t for r in found) for t in {r.task for r in found})
    assert len(found) == 802 and most < 300
    zero, minus = ([r[f"bench_{x.lower()}"] for x in STANCES] for r in found if r.doc_id >= 900)
    assert zero == minus and len(set(zero)) > 1


def test_near_ties_are_told_apart_by_doubles(frame):
    draw = np.random.default_rng(8)
    one = draw.normal(size=16)
    # differences far below single precision, ties, and a bank of mixed lengths
    rows = [(i, (one + draw.integers(-3, 4) * 1e-8 * (np.arange(16) == i % 16)).tolist(), i % 3) for i in range(150)]
    rows += [(i, (draw.normal(size=16) * 10.0 ** draw.integers(-3, 3)).tolist(), i % 3) for i in range(150, 200)]
    df = frame(rows, SCHEMA)
    found = got(ne.nearest(df, df, 7, part_rows=60))
    want = plain(rows, 7, False)
    assert np.allclose([r[4] for r in found], [r[4] for r in want], rtol=1e-13, atol=2e-9)
    exact = {i: np.array(v) for i, v, _ in rows}
    for i, _, j, _, sim in found:
        assert abs(float(exact[i] @ exact[j]) - sim) < 1e-9 + 1e-12 * abs(sim)


def test_few_true_cells_are_found():
    draw = np.random.default_rng(2)
    for shape in ((0, 5), (5, 0), (1, 1), (3, 5), (16, 8), (33, 17)):
        mask = draw.random(shape) < 0.2
        assert [x.tolist() for x in ne._where(mask)] == [x.tolist() for x in np.nonzero(mask)]
