"""Refresh of the fact table after changes of its source files."""

import os
import time

import pytest
from pyspark.sql import functions as F

from prosegauge.operators import facts as fa
from prosegauge.sources import incremental as inc, readers as rd


def match(number, batter, runs):
    lines = [f"info,team,T{number}", "info,team,U", "info,date,2024/01/02", "info,season,2024", "info,venue,V", f"info,player,T{number},{batter}",
             f"info,player,U,Bowler {number}"]
    lines += [f'ball,1,0.{i},T{number},{batter},Other,Bowler {number},{r},0,"","",""' for i, r in enumerate(runs, 1)]
    return "\n".join(lines) + "\n"


def read(spark, paths):
    return rd.read_ball_log(spark, paths)


def facts(log):
    return fa.player_match(log)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def files(folder):
    return {p: os.stat(os.path.join(d, p)).st_mtime_ns for d, _, names in os.walk(folder) for p in names if p.endswith(".parquet")}


def test_only_buckets_of_changed_files_are_rewritten(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def put(number, batter, runs):
        (source / f"{number}.csv").write_text(match(number, batter, runs))

    def full():
        return rows(facts(read(spark, str(source))))

    for n in range(30):
        put(n, f"Batter {n % 7}", [n % 5, 4])
    first = inc.refresh(spark, str(source), target, read, facts, buckets=8)
    assert (first.built, first.gone, first.kept) == (30, 0, 0) and rows(first.rows) == full()
    before = files(target + "/rows")
    # nothing changed: nothing is written
    again = inc.refresh(spark, str(source), target, read, facts, buckets=8)
    assert (again.built, again.gone, again.kept, again.buckets) == (0, 0, 30, 0) and files(target + "/rows") == before
    # one changes
    time.sleep(0.05)
    put(3, "Somebody Else", [6, 6, 6])
    one = inc.refresh(spark, str(source), target, read, facts, buckets=8)
    assert (one.built, one.kept, one.buckets) == (1, 29, 1) and rows(one.rows) == full()
    after = files(target + "/rows")
    bucket = one.rows.limit(0).sparkSession.sql("SELECT pmod(xxhash64('3.csv'), 8)").first()[0]
    assert {p for p in before if p in after} == {p for d, _, names in os.walk(target + "/rows") for p in names
                                                 if p.endswith(".parquet") and not d.endswith(f"bucket={bucket}")}
    # one comes, one goes
    put(99, "New", [1])
    (source / "5.csv").unlink()
    both = inc.refresh(spark, str(source), target, read, facts, buckets=8)
    assert (both.built, both.gone, both.kept) == (1, 1, 29) and rows(both.rows) == full()
    # a refresh that broke off before its manifest is repeated
    newest = max(os.listdir(target + "/manifest"), key=int)
    os.unlink(f"{target}/manifest/{newest}/_SUCCESS")
    assert rows(inc.refresh(spark, str(source), target, read, facts, buckets=8).rows) == full()
    with pytest.raises(ValueError, match="number of buckets"):
        inc.refresh(spark, str(source), target, read, facts, buckets=4)


def test_all_files_go_and_names_are_unique(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    (source / "a").mkdir(parents=True)
    (source / "a" / "1.csv").write_text(match(1, "A", [1]))
    assert inc.refresh(spark, str(source), target, read, facts, buckets=2).rows.count() == 2
    (source / "a" / "1.csv").unlink()
    (source / "a" / "2.csv").write_text(match(2, "B", [1]))
    out = inc.refresh(spark, str(source), target, read, facts, buckets=2)
    assert (out.built, out.gone) == (1, 1) and {r.source_file for r in out.rows.collect()} == {"2.csv"}
    (source / "b").mkdir()
    (source / "b" / "2.csv").write_text(match(2, "B", [1]))
    with pytest.raises(ValueError, match="named 2.csv"):
        inc.refresh(spark, str(source), target, read, facts, buckets=2)
