"""Queries over the calibrated wall: lines, corner quad, calls, margins, diagram, gates, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import wall as W
from ..operators import judging as J
from . import bindings as B


def placed(spark, sf, known: bool = True):
    """Detected samples with their run's calibration; one small row per run is what the join moves."""
    rows = B.track(spark, sf).filter("detected").select("run_id", "frame", "x", "y").join(B.calibrations(spark, sf), "run_id")
    return rows.filter(F.col("cal.top").isNotNull()) if known else rows




# The same geometry as SQL text: lines are named by the prefix of their columns.
def below(line: str, x: str, y: str) -> str:
    return f"((({line}x1 - {line}x0) * ({y} - {line}y0) - ({line}y1 - {line}y0) * ({x} - {line}x0)) / sqrt(power({line}x1 - {line}x0, 2) + power({line}y1 - {line}y0, 2)))"


def y_at(line: str, x: str) -> str:
    return f"({line}y0 + ({line}y1 - {line}y0) / ({line}x1 - {line}x0) * ({x} - {line}x0))"


def progress(line: str) -> str:
    return f"(((x - {line}x0) * ({line}x1 - {line}x0) + (y - {line}y0) * ({line}y1 - {line}y0)) / (power({line}x1 - {line}x0, 2) + power({line}y1 - {line}y0, 2)))"


def edges(y: str) -> tuple[str, str]:
    return f"(40 + ({y} - 150) / 710 * (blx - 40))", f"(trx + ({y} - 160) / 690 * (990 - trx))"


LEFT, RIGHT = edges("y")
PLACED = "p AS (SELECT t.run_id, frame, x, y, c.* EXCLUDE (run_id) FROM track t JOIN calibrations c ON t.run_id = c.run_id WHERE detected AND known)"


def clamped(bottom: str) -> str:
    """p with lo, hi, cx and moved, for a lower line."""
    return f"""{PLACED}, b AS (SELECT *, CASE WHEN cornered THEN least({LEFT}, {RIGHT}) ELSE greatest(least(tx0, tx1), least({bottom}x0, {bottom}x1)) END AS lo,
      CASE WHEN cornered THEN greatest({LEFT}, {RIGHT}) ELSE least(greatest(tx0, tx1), greatest({bottom}x0, {bottom}x1)) END AS hi FROM p),
      w AS (SELECT *, least(hi, greatest(lo, x)) AS wx FROM b),
      m AS (SELECT *, NOT x BETWEEN lo AND hi AND {below('t', 'wx', 'y')} > 0 AND {below(bottom, 'wx', 'y')} < 0 AS moved FROM w),
      j AS (SELECT *, CASE WHEN moved THEN wx ELSE x END AS cx FROM m)"""


def reason(bottom: str, under: str, between: str) -> str:
    return f"""CASE WHEN NOT cx BETWEEN lo AND hi THEN 'outside_wall_x_bounds' WHEN {below('t', 'cx', 'y')} <= 0 THEN 'above_or_on_top_line' WHEN {below(bottom, 'cx', 'y')} >= 0 THEN '{under}'
      WHEN moved THEN 'between_lines_x_clamped' ELSE '{between}' END"""


CALL = "CASE WHEN reason = 'outside_wall_x_bounds' THEN NULL WHEN reason LIKE 'between%' THEN 'IN' ELSE 'OUT' END AS call"


@register(
    "j01_line_functions",
    f"""WITH {PLACED} SELECT run_id, frame, round({y_at('t', 'x')}, 6) AS y_at, round({below('t', 'x', 'y')}, 6) AS distance, x BETWEEN tx0 AND tx1 AS spans, round(tx0 + (tx1 - tx0) * (y / 1000), 6) AS px,
      round(ty0 + (ty1 - ty0) * (y / 1000), 6) AS py, round({progress('b')}, 6) AS along, round(sqrt(power(tx1 - tx0, 2) + power(ty1 - ty0, 2)), 6) AS length FROM p""",
)
def j01(spark, sf):
    top = F.col("cal")["top"]
    px, py = W.point_at(top, F.col("y") / 1000)
    made = {"y_at": W.y_at(top, F.col("x")), "distance": W.below(top, F.col("x"), F.col("y")), "px": px, "py": py, "along": W.progress(F.col("cal")["bottom"], F.col("x"), F.col("y")), "length": W.length(top)}
    return placed(spark, sf).select("run_id", "frame", W.spans_x(top, F.col("x")).alias("spans"), *[F.round(c, 6).alias(n) for n, c in made.items()])


@register(
    "j02_corner_quad",
    f"""WITH {PLACED}, q AS (SELECT *, least({LEFT}, {RIGHT}) AS lo, greatest({LEFT}, {RIGHT}) AS hi FROM p WHERE cornered)
      SELECT run_id, frame, round(lo, 6) AS low, round(hi, 6) AS high, x BETWEEN lo AND hi AND y BETWEEN 150 AND 860 AS inside, round(CASE WHEN hi <= lo THEN 0.5 ELSE (x - lo) / (hi - lo) END, 6) AS share,
      round(sqrt(power(greatest(lo - x, 0, x - hi), 2) + power(greatest(150 - y, 0, y - 860), 2)), 6) AS outside FROM q""",
)
def j02(spark, sf):
    c = F.col("cal")["corners"]
    low, high = W.corner_x(c, F.col("y"))
    made = {"low": low, "high": high, "share": W.corner_share(c, F.col("x"), F.col("y")), "outside": W.outside_distance(c, F.col("x"), F.col("y"))}
    return placed(spark, sf).filter(c.isNotNull()).select("run_id", "frame", W.in_corners(c, F.col("x"), F.col("y")).alias("inside"), *[F.round(v, 6).alias(n) for n, v in made.items()])


@register("j03_clamped_x", f"WITH {clamped('b')} SELECT run_id, frame, round(cx, 6) AS cx, moved FROM j")
def j03(spark, sf):
    return J.clamp(placed(spark, sf)).select("run_id", "frame", F.round("at_x", 6).alias("cx"), "moved")


@register(
    "j04_judge",
    f"""WITH {clamped('b')}, r AS (SELECT *, {reason('b', 'below_or_on_bottom_line', 'between_lines')} AS reason FROM j),
      s AS (SELECT *, greatest(lo - cx, 0, cx - hi) AS ox, greatest(150 - y, 0, y - 860) AS oy, least({below('t', 'cx', 'y')}, -{below('b', 'cx', 'y')}) AS band FROM r)
      SELECT run_id, frame, {CALL}, reason, round({y_at('t', 'cx')}, 6) AS top_y, round({y_at('b', 'cx')}, 6) AS bottom_y, round(CASE WHEN cornered AND (ox > 0 OR oy > 0) THEN -sqrt(ox * ox + oy * oy) ELSE band END, 6) AS margin FROM s""",
)
def j04(spark, sf):
    return J.judge(placed(spark, sf)).select("run_id", "frame", "call", "reason", *[F.round(c, 6).alias(c) for c in ("top_y", "bottom_y", "margin")])


@register(
    "j04_judge_serve",
    f"""WITH {clamped('s')}, r AS (SELECT *, {reason('s', 'below_or_on_service_line', 'between_out_and_service_lines')} AS reason FROM j)
      SELECT run_id, frame, {CALL}, reason, round({y_at('s', 'cx')}, 6) AS service_y FROM r""",
)
def j04_serve(spark, sf):
    return J.judge(placed(spark, sf), serve=True).select("run_id", "frame", "call", "reason", F.round("bottom_y", 6).alias("service_y"))


@register(
    "j05_wall_diagram",
    f"""WITH {clamped('b')}, g AS (SELECT unnest(range(0, 1001)) AS i),
      d AS (SELECT run_id, frame, i, cx, y, tx0 + (tx1 - tx0) * (i / 1000.0::DOUBLE) AS ax, ty0 + (ty1 - ty0) * (i / 1000.0::DOUBLE) AS ay, bx0 + (bx1 - bx0) * (i / 1000.0::DOUBLE) AS ex, by0 + (by1 - by0) * (i / 1000.0::DOUBLE) AS ey FROM j, g),
      v AS (SELECT *, ((cx - ax) * (ex - ax) + (y - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) AS v FROM d),
      e AS (SELECT run_id, frame, i, v, cx - (ax + (ex - ax) * v) AS dx, y - (ay + (ey - ay) * v) AS dy FROM v),
      k AS (SELECT run_id, frame, arg_min(i, struct_pack(e := dx * dx + dy * dy, i := i)) AS i, arg_min(v, struct_pack(e := dx * dx + dy * dy, i := i)) AS v FROM e GROUP BY run_id, frame)
      SELECT run_id, frame, round(CASE WHEN cornered THEN (cx - lo) / (hi - lo) ELSE i / 1000.0::DOUBLE END, 6) AS u, round(v, 6) AS v FROM k JOIN j USING (run_id, frame)""",
)
def j05(spark, sf):
    return J.diagram(placed(spark, sf)).select("run_id", "frame", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


#: A range of x for runs without calibration.
LOW, HIGH = 800.0, 200.0
ANY = "p AS (SELECT t.run_id, frame, x, y, c.* EXCLUDE (run_id) FROM track t JOIN calibrations c ON t.run_id = c.run_id WHERE detected), q AS (SELECT *, least(greatest(y, 150), 860) AS cy FROM p), h AS (SELECT *, {left} AS l, {right} AS r FROM q)"
GATES = ANY.format(left=edges("cy")[0], right=edges("cy")[1])


def gate_sql(kind: str, vertical: bool) -> str:
    pad, share = J.PADS[kind]
    wide = f"greatest({pad}, {share}::DOUBLE * greatest(0, greatest(l, r) - least(l, r)))"
    sides, along = f"x BETWEEN least(l, r) - {wide} AND greatest(l, r) + {wide}", f"{progress('b')} BETWEEN -{share}::DOUBLE AND 1 + {share}::DOUBLE"
    under = f"-{below('b', 'x', 'y')} >= -{pad}"
    over_v, under_v = f"y - {y_at('t', 'x')} >= -{pad}", f"{y_at('b', 'x')} - y >= -{pad}"
    lines = {"wall": f"{over_v if vertical else below('t', 'x', 'y') + f' >= -{pad}'} AND {under_v if vertical else under} AND {along}", "side": along, "chunk": f"{under} AND {along}"}[kind]
    corners = {"wall": f"{sides} AND y BETWEEN 150 - {wide} AND 860 + {wide}", "side": sides, "chunk": f"{sides} AND {under}"}[kind]
    none = "true" if vertical else f"x BETWEEN 200 - greatest({pad}, {share}::DOUBLE * 600) AND 800 + greatest({pad}, {share}::DOUBLE * 600)"
    return f"CASE WHEN cornered THEN {corners} WHEN known THEN {lines} ELSE {none} END"


@register("c09_wall_gates", f"WITH {GATES} SELECT run_id, frame, {gate_sql('wall', False)} AS wall, {gate_sql('side', False)} AS side, {gate_sql('chunk', False)} AS chunk FROM h")
def c09(spark, sf):
    return J.gates(placed(spark, sf, False), F.lit(LOW), F.lit(HIGH)).select("run_id", "frame", "wall", "side", "chunk")


@register("c10_evaluation_gates", f"WITH {GATES} SELECT run_id, frame, {gate_sql('wall', True)} AS wall, {gate_sql('side', True)} AS side, {gate_sql('chunk', True)} AS chunk FROM h")
def c10(spark, sf):
    return J.gates(placed(spark, sf, False), F.lit(LOW), F.lit(HIGH), evaluation=True).select("run_id", "frame", "wall", "side", "chunk")


@register(
    "c11_significance",
    """SELECT run_id, frame, (speed_before >= 20 AND speed_before * 10 >= 200 AND k >= 25) OR (coalesce(call = 'OUT', false) AND y * 500 <= 80 AND x >= 0.30) AS significant FROM hits""",
)
def c11(spark, sf):
    valley = F.coalesce(F.col("call") == "OUT", F.lit(False))
    found = W.significant(F.col("speed_before") * 10, F.col("k").cast("double"), valley, F.col("y") * 500, F.col("x"))
    return B.hits(spark, sf).select("run_id", "frame", found.alias("significant"))


@register(
    "j11_candidate_score",
    """WITH s AS (SELECT run_id, frame, 0.55::DOUBLE * (speed_before * 10) / 200 + 0.35::DOUBLE * k / 25 + 0.10::DOUBLE * least(least(speed_before * 20, speed_after * 20) / 200, 4) AS base, CASE WHEN k % 3 > 0 THEN y * 500 END AS d, x FROM hits)
      SELECT run_id, frame, round(CASE WHEN d IS NULL THEN base ELSE base + 1.40::DOUBLE * greatest(0, 1 - d / 80) + 0.55::DOUBLE * least(x * 8 / 2, 2) + 0.90::DOUBLE * least(x / 0.3::DOUBLE, 3) END, 9) AS score FROM s""",
)
def j11(spark, sf):
    distance = F.when(F.col("k") % 3 > 0, F.col("y") * 500)
    score = W.candidate_score(F.col("speed_before") * 10, F.col("k").cast("double"), F.col("speed_before") * 20, F.col("speed_after") * 20, distance, F.col("x") * 8, F.col("x"))
    return B.hits(spark, sf).select("run_id", "frame", F.round(score, 9).alias("score"))


@register(
    "a21_calibration_parse",
    """SELECT run_id, known AS judged, cornered, CASE WHEN known THEN tx1 END AS top_right, CASE WHEN known THEN sy0 END AS service_left, CASE WHEN cornered THEN trx END AS corner FROM calibrations""",
)
def a21(spark, sf):
    """The calibrations as JSON documents, parsed again; of a line that is drawn twice the last counts."""
    ends = lambda l: F.array(F.array(l["x0"], l["y0"]), F.array(l["x1"], l["y1"]))
    named = lambda n, l: F.struct(F.lit(n).alias("name"), ends(l).alias("endpoints"))
    tap = lambda n, c: F.struct(F.lit(n).alias("id"), F.when(c.isNotNull(), F.array(c["x"], c["y"])).alias("tap_px"))
    lines = F.array(named("out_line_lower_edge", F.col("cal")["bottom"]), named("out_line_lower_edge", F.col("cal")["top"]), named("tin_top_edge", F.col("cal")["bottom"]), named("service_line_top_edge", F.col("cal")["service"]))
    corners = F.array(*[tap(n, F.col("cal")["corners"][c]) for n, c in (("top_left", "tl"), ("top_right", "tr"), ("bottom_right", "br"), ("bottom_left", "bl"))])
    document = F.to_json(F.struct(lines.alias("lines"), F.struct(F.struct(corners.alias("corners")).alias("wall")).alias("planes")))
    parsed = B.calibrations(spark, sf).select("run_id", W.parse_calibration(document).alias("c"))
    return parsed.select(
        "run_id", F.col("c.top").isNotNull().alias("judged"), F.col("c.corners").isNotNull().alias("cornered"),
        F.col("c.top.x1").alias("top_right"), F.col("c.service.y0").alias("service_left"), F.col("c.corners.tr.x").alias("corner"),
    )
