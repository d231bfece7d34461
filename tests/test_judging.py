"""Calls, tracking, selection, attribution and documents against hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strokeflow.functions import wall
from strokeflow.operators import attribution, detections, fits, judging
from strokeflow.sources import documents

CORNERS = ((0.0, 100.0), (1000.0, 100.0), (1000.0, 700.0), (0.0, 700.0))


def cal(top=(0.0, 100.0, 1000.0, 100.0), bottom=(0.0, 700.0, 1000.0, 700.0), service=(0.0, 400.0, 1000.0, 400.0), corners=None):
    return (top, bottom, service, corners)


def judged(spark, cases, **options):
    rows = [(i, c, float(x), float(y)) for i, (c, x, y) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, cal {wall.CALIBRATION}, x double, y double")
    return [(r.call, r.reason, None if r.margin is None else round(r.margin, 6)) for r in judging.judge(df, **options).orderBy("i").collect()]


def test_calls_on_over_and_under_the_lines(spark):
    assert judged(spark, [(cal(), 500, 300), (cal(), 500, 100), (cal(), 500, 50), (cal(), 500, 700), (cal(), 500, 900)]) == [
        ("IN", "between_lines", 200.0), ("OUT", "above_or_on_top_line", 0.0), ("OUT", "above_or_on_top_line", -50.0), ("OUT", "below_or_on_bottom_line", 0.0), ("OUT", "below_or_on_bottom_line", -200.0),
    ]


def test_tilted_lines_are_measured_perpendicular(spark):
    tilted = cal(top=(0.0, 0.0, 300.0, 400.0), bottom=(0.0, 1000.0, 300.0, 1400.0))
    # At x = 150 the line is at y = 200; 50 below it is 30 away from it.
    assert judged(spark, [(tilted, 150, 250), (tilted, 150, 200), (tilted, 150, 150)]) == [("IN", "between_lines", 30.0), ("OUT", "above_or_on_top_line", 0.0), ("OUT", "above_or_on_top_line", -30.0)]


def test_beside_the_wall(spark):
    """Between the lines a ball counts at the border; above them it has no call."""
    cornered = cal(corners=CORNERS)
    assert judged(spark, [(cal(), -3, 300), (cal(), -3, 50), (cornered, 1004, 300), (cornered, 1004, 60)]) == [
        ("IN", "between_lines_x_clamped", 200.0), (None, "outside_wall_x_bounds", -50.0), ("IN", "between_lines_x_clamped", 200.0), (None, "outside_wall_x_bounds", round(-((4**2 + 40**2) ** 0.5), 6)),
    ]


def test_serves_have_to_hit_above_the_service_line(spark):
    assert judged(spark, [(cal(), 500, 300), (cal(), 500, 400), (cal(), 500, 600), (cal(), -2, 300), (cal(), 500, 90)], serve=True) == [
        ("IN", "between_out_and_service_lines", 100.0), ("OUT", "below_or_on_service_line", 0.0), ("OUT", "below_or_on_service_line", -200.0), ("IN", "between_lines_x_clamped", 100.0), ("OUT", "above_or_on_top_line", -10.0),
    ]


def test_an_invalid_band_is_an_error(spark):
    swapped = cal(top=(0.0, 700.0, 1000.0, 700.0), bottom=(0.0, 100.0, 1000.0, 100.0))
    with pytest.raises(Exception, match="valid wall band"):
        judged(spark, [(swapped, 500, 300)])
    assert judged(spark, [(swapped, 500, 300)], strict=False)[0][:2] == ("UNKNOWN", "invalid_band")


def test_calibrations_that_lack_parts(spark):
    lines = '"lines": [{"name": "out_line_lower_edge", "endpoints": [[0, 1], [2, 3]]}, {"name": "tin_top_edge", "endpoints": [[0, 9], [2, 9]]}]'
    corner = lambda n, x, y: f'{{"id": "{n}", "tap_px": [{x}, {y}]}}'
    four = [corner("top_left", 0, 0), corner("top_right", 9, 0), corner("bottom_right", 9, 9), corner("bottom_left", 0, 9)]
    planes = lambda c: '"planes": {"wall": {"corners": [' + ",".join(c) + "]}}"
    bodies = [f"{{{lines}}}", "{" + lines + "," + planes(four) + "}", "{" + lines + "," + planes(four[:3]) + "}", "{" + lines + "," + planes([four[1], corner("top_left", 99, 0), *four[2:]]) + "}", '{"lines": [{"name": "tin_top_edge", "endpoints": [[0, 9], [2, 9]]}]}', "{broken", None]
    got = [r.c for r in spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", wall.parse_calibration(F.col("b")).alias("c")).orderBy("i").collect()]
    assert [c is not None and c.top is not None for c in got] == [True, True, True, True, False, False, False]
    assert [c is not None and c.corners is not None for c in got] == [False, True, False, False, False, False, False]


def people(spark, frames):
    rows = [(1, f, float(f), d if feet else None, *(feet[d] if feet else (None, None)), 0.9 - d / 10) for f, feet in enumerate(frames) for d in range(max(1, len(feet)))]
    return spark.createDataFrame(rows, "run_id long, frame long, t double, det long, x double, y double, confidence double")


def tracks(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.frame, {})[r.track] = (r.x, r.y, r.coasted, r.ambiguous)
    return out


def test_two_players(spark):
    left, right = (0.0, 0.0), (10.0, 0.0)
    got = tracks(detections.track_two(people(spark, [[right, left], [(1.0, 0.0), (9.0, 0.0)], [], [(8.0, 0.0)], [], [], [(8.0, 0.0), (1.0, 0.0)]])))
    assert got[0] == {"A": (*left, False, False), "B": (*right, False, False)}
    assert got[1] == {"A": (1.0, 0.0, False, False), "B": (9.0, 0.0, False, False)}
    assert got[2] == {"A": (1.0, 0.0, True, False), "B": (9.0, 0.0, True, False)}
    assert got[3] == {"B": (8.0, 0.0, False, False)}  # A was last seen two seconds before
    assert got[4] == {"B": (8.0, 0.0, True, False)} and 5 not in got
    assert got[6] == {"A": (1.0, 0.0, False, False), "B": (8.0, 0.0, False, False)}


def test_a_second_player_who_comes_late(spark):
    got = tracks(detections.track_two(people(spark, [[], [(5.0, 0.0)], [(6.0, 0.0)], [(0.0, 0.0), (6.5, 0.0)], [(3.0, 0.0), (3.5, 0.0)]])))
    assert 0 not in got and got[1] == {"A": (5.0, 0.0, False, False)} and got[2] == {"A": (6.0, 0.0, False, False)}
    assert got[3] == {"A": (6.5, 0.0, False, False), "B": (0.0, 0.0, False, False)}
    # 3.5 + 3 against 3 + 3.5: both ways cost the same, the first detection goes to A.
    assert got[4] == {"A": (3.5, 0.0, False, False), "B": (3.0, 0.0, False, False)} or got[4]["A"][3]


def test_motion_consistent_selection(spark):
    """A ball that moves wins over a surer spot that stands still; a frame with nothing left has a null."""
    rows = [(1, f, 0, 20.0 * f, 10.0, 0.5) for f in range(6)] + [(1, f, 1, 500.0, 500.0, 0.9) for f in range(6)] + [(1, 9, 0, 500.0, 501.0, 0.9), (1, 20, 0, 5.0, 5.0, 0.7)]
    d = spark.createDataFrame([(*r, "ball") for r in rows], "run_id long, frame long, det long, x double, y double, confidence double, class_name string")
    got = {r.frame: (r.det, r.score) for r in detections.select(d, d).collect()}
    assert all(got[f] == (0, 0.8) for f in range(6)) and got[9] == (None, None) and got[20] == (0, 0.7)
    assert {r.frame: r.det for r in detections.select(d, d, supported=True).collect()}[20] is None


def test_nested_boxes_are_found_in_order(spark):
    box = '{"x": 1, "y": 2, "width": 3, "height": 4, "class": "ball", "inner": {"x": 5, "y": 6, "width": 7, "height": 8}}'
    docs = [(1, f'{{"a": [{box}, 7, "t"], "b": {{"x": 1}}}}'), (2, box), (3, "[]"), (4, '[[[{"x":1,"y":1,"width":1,"height":1,"name":"n"}]]]')]
    got = sorted((r.doc, r.det, r.class_name, r.x) for r in detections.found(spark.createDataFrame(docs, "doc long, body string")).collect())
    assert got == [(1, 0, "ball", 1.0), (1, 1, "object", 5.0), (2, 0, "ball", 1.0), (2, 1, "object", 5.0), (4, 0, "n", 1.0)]


def test_a_serve_fault_ends_its_rally(spark):
    rows = [(1, f, 1, "IN", s) for f, s in enumerate(("OUT", "OUT", "IN", "OUT"))] + [(1, 9, 2, "OUT", "IN")]
    got = attribution.serve_rule(spark.createDataFrame(rows, "run_id long, frame long, rally_number long, call string, serve_call string")).orderBy("frame").collect()
    assert [(r.is_serve, r.call, r.rally_number_split) for r in got] == [(True, "OUT", 1), (True, "OUT", 2), (True, "IN", 3), (False, "IN", 3), (True, "IN", 4)]


def test_observed_serves_repair_and_conflict(spark):
    # Three hits, the last IN: who serves wins. The first observed serve binds A to player 1.
    rows = [(1, 1, "A"), (1, 2, None), (1, 3, "B"), (1, 4, "A")]
    df = spark.createDataFrame([(r, n, 3, "IN", "IN", t) for r, n, t in rows], "run_id long, rally_number long, n_hits long, serve_call string, last_call string, track string")
    got = attribution.backfilled(attribution.observed_chain(df)).orderBy("rally_number").collect()
    assert [(r.server, r.winner, r.state) for r in got] == [(1, 1, "observed"), (2, 2, "repaired"), (2, 1, "conflict"), (1, 1, "observed")]


def test_documents_round_trip(spark, tmp_path):
    body = documents.payload(spark.createDataFrame([(1, 2, "IN"), (1, 1, None), (2, 5, "OUT")], "run_id long, frame long, call string"), spark.createDataFrame([(1, 1, 2)], "run_id long, rally_number long, n_hits long"))
    documents.write_documents(body, str(tmp_path / "out"))
    (tmp_path / "out" / "uploads").mkdir()
    (tmp_path / "out" / "uploads" / "x.txt").write_text("{}")
    read = documents.read_documents(spark, str(tmp_path / "out" / "*" / "*.txt"))
    assert sorted(r.body.strip() for r in read.collect()) == sorted(r.body for r in body.collect()) and all(r.modified is not None for r in read.collect())


def test_fingerprint_clusters(spark):
    v = {0: (1.0, 0.0), 1: (0.96, 0.28), 2: (0.0, 1.0), 3: (1.0, 0.0), 4: (0.28, 0.96), 5: (0.6, -0.8)}
    got = fits.cluster_fingerprints(spark.createDataFrame([(1, i, list(x)) for i, x in v.items()], "run_id long, i long, v array<double>"), 0.9, 2)
    assert sorted((r.cluster, r.i) for r in got.collect()) == [(0, 0), (0, 1), (0, 3), (1, 2), (1, 4)]


def test_homography_needs_four_points_off_a_line(spark):
    import numpy as np

    h = np.array([[2.0, 0.3, 5.0], [0.1, 3.0, -4.0], [0.001, 0.002, 1.0]])
    src = np.array([(0, 0), (21, 0), (21, 32), (0, 32), (9, 14)], float)
    p = h @ np.vstack([src.T, np.ones(5)])
    assert np.allclose(fits.homography(src, (p[:2] / p[2]).T), h, atol=1e-9)
    assert fits.homography(src[:3], src[:3]) is None and fits.homography(np.array([(i, 2 * i) for i in range(5)], float), src) is None
