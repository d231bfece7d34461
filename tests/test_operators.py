"""Engine operators against their oracle SQL and hand-made vectors."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from strokeflow import catalog
from strokeflow.operators import aggregates, joins, sessions, sets, trajectory
from strokeflow.sources import files
from verify_oracle import compare

SF = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    assert compare(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def frames(spark, rows, names):
    return spark.createDataFrame(rows, names)


def test_serve_faults_peel_off(spark):
    rows = [(1, i, float(i), 1, c) for i, c in enumerate(["OUT", "OUT", "IN", "OUT"])] + [(2, 0, 0.0, 1, None), (2, 1, 1.0, 1, "OUT")]
    got = sessions.serve_faults(frames(spark, rows, "run_id long, frame long, t double, rally_number long, call string")).orderBy("run_id", "frame").collect()
    assert [r.rally_number_split for r in got] == [1, 2, 3, 3, 1, 1]


def test_clamp_depends_on_previous_output(spark):
    spans = frames(spark, [(1, 1.0, 3.0, 5), (1, 3.2, 3.4, 1), (1, 3.1, 3.3, 1), (1, 9.0, 20.0, 2)], "run_id long, start double, end double, n long")
    got = sessions.clamp_timeline(spans, 12.0).orderBy("start").collect()
    assert [(round(r.start, 3), round(r.end, 3), r.confidence) for r in got] == [(0.5, 3.5, 1.0), (3.5, 3.8, 0.25), (3.8, 3.9, 0.25), (8.5, 12.0, 0.5)]


def test_greedy_match_claims(spark):
    left = frames(spark, [(1, 10.0, 1), (1, 11.0, 2), (1, 40.0, 3)], "run_id long, at double, id long")
    right = frames(spark, [(1, 11.0, 7), (1, 13.0, 8)], "run_id long, at double, id long")
    got = {r.left_id: (r.right_id, r.distance) for r in joins.greedy_match(left, right, 3.0).collect()}
    assert got == {1: (7, 1.0), 2: (8, 2.0), 3: (None, None)}


def test_peaks_are_suppressed_by_kept_ones_only(spark):
    peaks = frames(spark, [(1, 10, 5.0, 1), (1, 14, 4.0, 2), (1, 18, 3.0, 3)], "run_id long, frame long, score double, seq long")
    assert [r.frame for r in sessions.suppress_peaks(peaks, 5).orderBy("rank").collect()] == [10, 18]


def test_split_fit_finds_the_corner(spark):
    rows = [(1, i, float(abs(i - 9))) for i in range(1, 22)]
    got = trajectory.split_fit(frames(spark, rows, "run_id long, frame long, y double")).collect()
    assert any(r.split_frame == 9 and r.improvement > 0.99 for r in got)


def test_gap_fill_needs_every_frame(spark):
    rows = [(1, f, 0.0 if f == 1 else 10.0, 0.0, f in (1, 6, 9), 0.5) for f in (1, 2, 3, 4, 5, 6, 7, 9)]
    got = {r.frame: (r.filled, r.fx) for r in trajectory.fill_gaps(frames(spark, rows, "run_id long, frame long, x double, y double, detected boolean, confidence double")).collect()}
    assert got[3] == (True, 4.0) and got[7][0] is False


def test_metrics_without_positives(spark):
    r = frames(spark, [(False, False)], "a boolean, p boolean").agg(*aggregates.binary_metrics(F.col("a"), F.col("p"))).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0, 0, 0, 1)


def test_files_round_trip(spark, tmp_path):
    rows = frames(spark, [(1, 2, 0.5, True, 1.0, 2.0), (1, 1, 0.25, False, None, None)], "run_id long, frame long, t double, detected boolean, x double, y double")
    files.write_track_csv(rows, str(tmp_path / "o"))
    (tmp_path / "t.csv").write_text("source_frame,timestamp_seconds,detected,x_center,y_center\n1,0.1,True,5,6\n2,0.2,yes,5,6\n3,0.3,False,,\n4,bad,1,7,8\n")
    got = files.read_track_csv(spark, str(tmp_path / "t.csv"))
    assert [r.frame for r in files.kept_positions(got).orderBy("frame").collect()] == [1, 4]
    (tmp_path / "j.jsonl").write_text('// note\n\n{"a": 1}\n{bad\n')
    assert [r.a for r in files.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int").collect()] == [1, None]
    with pytest.raises(ValueError):
        (tmp_path / "b.csv").write_text("source_frame\n1\n")
        files.read_track_csv(spark, str(tmp_path / "b.csv"))


def test_dedup_prefers_larger_session(spark):
    rows = frames(spark, [("v", 1, 1), ("v", 2, 1), ("v", 2, 2), ("w", 3, 1), ("w", 4, 1)], "k string, s long, f long")
    assert sorted((r.k, r.s) for r in sets.largest_session(rows, "k", "s").collect()) == [("v", 2), ("v", 2), ("w", 4)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
