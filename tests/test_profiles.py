"""Profiles kept up to date from run to run equal those of one pass."""

import random

import pytest
from pyspark.sql import functions as F

from prosegauge.operators import submissions as su


def same(a, b):
    a, b = ({r.user_id: r.asDict() for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys()
    for u, row in a.items():
        for name, value in row.items():
            assert b[u][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (u, name)


@pytest.mark.parametrize("seed", [1, 2])
def test_days_in_turn_equal_one_pass(frame, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(400):  # one user holds half; null scores, unknown styles, equal times, a null user
        rows.append((i, draw.choice([1, 1, 1, 2, 3, 4, None]), i // 7, draw.choice([None, None, draw.uniform(0, 100)]),
                     draw.choice(["analytical", "balanced", "odd", None])))
    df = frame(rows, "id bigint, user_id bigint, ts bigint, eqs_score double, stance_label string").withColumn("ts", F.col("ts").cast("timestamp"))
    whole = su.writer_profiles(df)
    state = None
    for low, high in ((0, 10), (10, 11), (11, 40), (40, 41), (41, 99)):
        part = df.filter((F.col("ts").cast("long") >= low) & (F.col("ts").cast("long") < high))
        state = su.checkpointed(su.profile_state(part, state))
    same(whole, state.drop("last_key"))
    # a day without rows changes nothing
    same(whole, su.profile_state(df.limit(0), state).drop("last_key"))


def test_earlier_rows_are_refused(frame):
    schema = "id bigint, user_id bigint, ts timestamp, eqs_score double"
    day = frame([(1, 1, None, 10.0)], schema).withColumn("ts", F.lit("2024-01-02").cast("timestamp"))
    state = su.checkpointed(su.profile_state(day))
    with pytest.raises(Exception, match="earlier than its user"):
        su.profile_state(day.withColumn("ts", F.lit("2024-01-01").cast("timestamp")), state).collect()
    other = day.withColumn("user_id", F.lit(2).cast("long")).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert su.profile_state(other, state).count() == 2
