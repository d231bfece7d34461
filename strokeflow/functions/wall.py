"""The calibrated front wall: border lines, corner quad, gates and scores, as column expressions. Calls are in operators/judging.

A calibration is a struct column with ``top``, ``bottom`` and ``service``
(lines, each a struct of x0, y0, x1, y1; left to right) and ``corners`` (a
struct of tl, tr, br, bl, each of x and y, or null). y grows downwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "struct<x0:double,y0:double,x1:double,y1:double>"
POINT = "struct<x:double,y:double>"
CORNERS = f"struct<tl:{POINT},tr:{POINT},br:{POINT},bl:{POINT}>"
CALIBRATION = f"struct<top:{LINE},bottom:{LINE},service:{LINE},corners:{CORNERS}>"


def length(line: Column) -> Column:
    return F.hypot(line["x1"] - line["x0"], line["y1"] - line["y0"])


def y_at(line: Column, x: Column) -> Column:
    """Null for a vertical line."""
    return line["y0"] + F.try_divide(line["y1"] - line["y0"], line["x1"] - line["x0"]) * (x - line["x0"])


def spans_x(line: Column, x: Column) -> Column:
    return x.between(F.least(line["x0"], line["x1"]), F.greatest(line["x0"], line["x1"]))


def point_at(line: Column, u: Column) -> tuple[Column, Column]:
    return line["x0"] + (line["x1"] - line["x0"]) * u, line["y0"] + (line["y1"] - line["y0"]) * u


def below(line: Column, x: Column, y: Column) -> Column:
    """Perpendicular distance, positive below the line; null for a line without length."""
    return F.try_divide((line["x1"] - line["x0"]) * (y - line["y0"]) - (line["y1"] - line["y0"]) * (x - line["x0"]), length(line))


def progress(line: Column, x: Column, y: Column) -> Column:
    """How far along a line the point's foot lies, 0 to 1 within it; 0 for a line without length."""
    dx, dy = line["x1"] - line["x0"], line["y1"] - line["y0"]
    squared = dx * dx + dy * dy
    return F.when(squared <= 1e-9, 0.0).otherwise(F.try_divide((x - line["x0"]) * dx + (y - line["y0"]) * dy, squared))


def _edge_x(top: Column, bottom: Column, y: Column) -> Column:
    rise = bottom["y"] - top["y"]
    return F.when(F.abs(rise) <= 1e-9, (top["x"] + bottom["x"]) / 2).otherwise(top["x"] + F.try_divide(y - top["y"], rise) * (bottom["x"] - top["x"]))


def corner_x(corners: Column, y: Column) -> tuple[Column, Column]:
    """The quad's borders at a height, the smaller first."""
    left, right = _edge_x(corners["tl"], corners["bl"], y), _edge_x(corners["tr"], corners["br"], y)
    return F.least(left, right), F.greatest(left, right)


def corner_y(corners: Column) -> tuple[Column, Column]:
    return F.least(corners["tl"]["y"], corners["tr"]["y"]), F.greatest(corners["bl"]["y"], corners["br"]["y"])


def in_corners(corners: Column, x: Column, y: Column) -> Column:
    return x.between(*corner_x(corners, y)) & y.between(*corner_y(corners))


def corner_share(corners: Column, x: Column, y: Column) -> Column:
    """X from 0 at the left border to 1 at the right one; 0.5 where they meet."""
    left, right = corner_x(corners, y)
    return F.when(right <= left, 0.5).otherwise(F.try_divide(x - left, right - left))


def outside_distance(corners: Column, x: Column, y: Column) -> Column:
    left, right = corner_x(corners, y)
    top, bottom = corner_y(corners)
    zero = F.lit(0.0)
    return F.hypot(F.greatest(left - x, zero, x - right), F.greatest(top - y, zero, y - bottom))


def wall_x(cal: Column, y: Column, frame_width: Column | None = None) -> tuple[Column, Column]:
    """Borders of the wall at a height: the corner quad's, or what both lines span (the whole frame if they share nothing)."""
    top, bottom = cal["top"], cal["bottom"]
    low = F.greatest(F.least(top["x0"], top["x1"]), F.least(bottom["x0"], bottom["x1"]))
    high = F.least(F.greatest(top["x0"], top["x1"]), F.greatest(bottom["x0"], bottom["x1"]))
    width = F.greatest(F.lit(1.0), F.coalesce(frame_width, F.lit(1.0)) if frame_width is not None else F.lit(1.0))
    left, right = corner_x(cal["corners"], y)
    cornered = cal["corners"].isNotNull()
    return F.when(cornered, left).when(high <= low, 0.0).otherwise(low), F.when(cornered, right).when(high <= low, width).otherwise(high)


def valid_band(cal: Column) -> Column:
    """Whether the top line lies above the bottom line at their middles."""
    top_mid, bottom_mid = point_at(cal["top"], F.lit(0.5)), point_at(cal["bottom"], F.lit(0.5))
    return F.coalesce((below(cal["top"], *bottom_mid) > 0) & (below(cal["bottom"], *top_mid) < 0), F.lit(False))


def in_range(low: Column, high: Column, x: Column, pad: Column | float = 0.0) -> Column:
    """X within two bounds in either order; no bounds, or equal ones, let all through."""
    pad = F.greatest(F.lit(0.0), pad if isinstance(pad, Column) else F.lit(pad))
    off = low.isNull() | high.isNull() | (low == high)
    return off | x.between(F.least(low, high) - pad, F.greatest(low, high) + pad)


def parse_calibration(text: Column) -> Column:
    """The calibration struct of a JSON document.

    Lines go by name; a document without the out line and the tin has neither
    (nor a call). Corners count only if all four are tapped and the right ones
    lie right of the left ones. A document that does not parse is null.
    """
    point = "array<double>"
    doc = F.from_json(
        text,
        f"lines array<struct<name:string,endpoints:array<{point}>>>, planes struct<wall:struct<corners:array<struct<id:string,tap_px:{point}>>>>, frame_width double, frame_height double, camera_id string",
    )

    def line(name: str) -> Column:
        found = F.try_element_at(F.filter(doc["lines"], lambda e: e["name"] == name), F.lit(-1))["endpoints"]  # of repeated names the last counts
        at = lambda i, j: F.get(F.get(found, F.lit(i)), F.lit(j))
        made = F.struct(at(0, 0).alias("x0"), at(0, 1).alias("y0"), at(1, 0).alias("x1"), at(1, 1).alias("y1"))
        return F.when(made["x0"].isNotNull() & made["y0"].isNotNull() & made["x1"].isNotNull() & made["y1"].isNotNull(), made)

    def corner(name: str) -> Column:
        tap = F.try_element_at(F.filter(doc["planes"]["wall"]["corners"], lambda e: (e["id"] == name) & e["tap_px"].isNotNull()), F.lit(-1))["tap_px"]
        return F.struct(F.get(tap, F.lit(0)).alias("x"), F.get(tap, F.lit(1)).alias("y"))

    tl, tr, br, bl = (corner(c) for c in ("top_left", "top_right", "bottom_right", "bottom_left"))
    known = (tl["x"] + tr["x"] + br["x"] + bl["x"] + tl["y"] + tr["y"] + br["y"] + bl["y"]).isNotNull()
    corners = F.when(known & (tr["x"] + br["x"] > tl["x"] + bl["x"]), F.struct(tl.alias("tl"), tr.alias("tr"), br.alias("br"), bl.alias("bl")))
    top, bottom = line("out_line_lower_edge"), line("tin_top_edge")
    both = top.isNotNull() & bottom.isNotNull()
    made = F.struct(F.when(both, top).alias("top"), F.when(both, bottom).alias("bottom"), line("service_line_top_edge").alias("service"), corners.alias("corners"))
    return F.when(doc["lines"].isNotNull() | doc["planes"].isNotNull(), made.cast(CALIBRATION))


def significant(dv: Column, turn: Column, valley: Column, distance: Column, improvement: Column, min_dv: float = 200.0, min_turn: float = 25.0) -> Column:
    """C11: a fast and sharp turn, or a valley near a line that two segments fit better than one."""
    near = F.coalesce(valley, F.lit(False)) & (F.coalesce(distance, F.lit(float("inf"))) <= 80.0) & (F.coalesce(improvement, F.lit(0.0)) >= 0.30)
    return F.coalesce((dv >= min_dv) & (turn >= min_turn), F.lit(False)) | near


def candidate_score(dv: Column, turn: Column, speed_before: Column, speed_after: Column, distance: Column, valley_depth: Column, improvement: Column) -> Column:
    """Speed change and turn against their thresholds, capped speed; evidence of a line where a distance to one is known."""
    base = 0.55 * dv / 200.0 + 0.35 * turn / 25.0 + 0.10 * F.least(F.least(speed_before, speed_after) / 200.0, F.lit(4.0))
    near = F.greatest(F.lit(0.0), 1 - distance / 80.0)
    depth = F.least(F.coalesce(valley_depth, F.lit(0.0)) / 2.0, F.lit(2.0))
    gain = F.least(F.coalesce(improvement, F.lit(0.0)) / 0.30, F.lit(3.0))
    return F.when(distance.isNull(), base).otherwise(base + (1.40 * near + 0.55 * depth + 0.90 * gain))
