"""Column functions: geometry, judging, zones, rounding, percentiles, text. All stay inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COURT_WIDTH_FT, COURT_LENGTH_FT = 21.0, 32.0
SPEED_MAX_FTPS = 30.0
# Horizontal and vertical borders of the target zones, and heights in feet.
CENTER_LEFT, CENTER_RIGHT = 0.21, 0.79
LOB_Y, SERVICE_Y = 0.324, (4.57 - 1.78) / (4.57 - 0.48)
OUT_FT, TIN_FT = 4.57 * 3.280839895, 0.48 * 3.280839895
FTPS_TO_MPH = 0.6818181818


def signed_distance(x0: Column, y0: Column, x1: Column, y1: Column, x: Column, y: Column) -> Column:
    """Signed perpendicular distance of a point from a line."""
    return F.try_divide((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0), F.hypot(x1 - x0, y1 - y0))


def inside_quad_x(left: Column, right: Column, x: Column, pad: float = 0.0) -> Column:
    """X within two bounds in either order, plus a pad."""
    return x.between(F.least(left, right) - pad, F.greatest(left, right) + pad)


def front_wall(kind: Column) -> Column:
    """Whether an event of this kind counts as a hit of the front wall: one without a kind does, and an unknown one."""
    return kind.isNull() | kind.isin("wall", "unknown")


def target_zone(x: Column, y: Column) -> Column:
    """Zones 1 to 9, left to right and within a side from lob to low; outside points are clamped."""
    side = F.when(x < CENTER_LEFT, 0).when(x <= CENTER_RIGHT, 1).otherwise(2)
    band = F.when(y < LOB_Y, 0).when(y < SERVICE_Y, 1).otherwise(2)
    return (side * 3 + band + 1).cast("int")


def grid_cell(value: Column, extent: float, cells: int) -> Column:
    """Which of ``cells`` equal parts of ``extent``; outside values fall into the edge cells."""
    return F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor(value / extent * cells))).cast("int")


def wall_height_ft(v: Column) -> Column:
    """Height in feet of diagram coordinate v (0 at the out line, 1 at the tin)."""
    return F.lit(OUT_FT) - v * (OUT_FT - TIN_FT)


def mph(ftps: Column) -> Column:
    return ftps * FTPS_TO_MPH


def round_even(value: Column, places: int) -> Column:
    """``value`` rounded half to even after scaling in binary, as DuckDB does (bround() goes by the decimal digits, which tie where the scaled double does not)."""
    scaled = value * 10.0**places
    return F.when(F.abs(scaled) < float("inf"), F.rint(scaled) / 10.0**places).otherwise(value)


def scale_frames(frames: int, fps: Column, minimum: int = 1) -> Column:
    """A frame count tuned at 60 fps, at another rate."""
    return F.greatest(F.lit(minimum), F.bround(frames * fps / 60).cast("int"))


def vote(parts: list[tuple[Column, float]], upper: float = 0.15, lower: float = -0.15) -> tuple[Column, Column]:
    """Weighted mean of the votes (-1 to 1) that are not null, and the class it falls into."""
    total = sum((F.coalesce(v, F.lit(0.0)) * w for v, w in parts[1:]), F.coalesce(parts[0][0], F.lit(0.0)) * parts[0][1])
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    score = F.try_divide(total, F.when(weight > 0, weight))
    return score, F.when(score >= upper, "wall").when(score <= lower, "racket").otherwise("unknown")


def clip_unit(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def nearest_rank(sorted_values: Column, fraction: float) -> Column:
    """The value at place round(fraction (n - 1)), half to even."""
    return F.get(sorted_values, F.bround(fraction * (F.size(sorted_values) - 1)).cast("int"))


def floor_rank(sorted_values: Column, fraction: float) -> Column:
    """The value at place floor(fraction (n - 1))."""
    return F.get(sorted_values, F.floor(fraction * (F.size(sorted_values) - 1)).cast("int"))


def count_rank(sorted_values: Column, fraction: float) -> Column:
    """The value at place int(fraction n), the last at most."""
    return F.get(sorted_values, F.least(F.floor(fraction * F.size(sorted_values)), F.size(sorted_values) - 1).cast("int"))


def loose_boolean(text: Column, true: tuple[str, ...] = ("true", "1", "yes", "y")) -> Column:
    """§ booleans in text: which words count as true is the caller's choice; null is false."""
    return F.coalesce(F.lower(F.trim(text)).isin(*true), F.lit(False))


def slug(text: Column) -> Column:
    """J20 without Unicode folding: ASCII letters, digits, dot, dash, underscore; a checksum is added where anything changed."""
    base = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(base == text, base).otherwise(F.concat_ws("-", F.when(base != "", base), F.substring(F.sha1(text.cast("binary")), 1, 8)))


def duration_text(seconds: Column) -> Column:
    """H:mm:ss."""
    s = F.bround(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def rewrite(text: Column, words: dict[str, str]) -> Column:
    """Whole words replaced whatever their case; a capital first letter stays one."""
    for old, new in words.items():
        text = F.regexp_replace(text, rf"\b{old[0].upper()}{old[1:]}\b", new[0].upper() + new[1:])
        text = F.regexp_replace(text, rf"(?i)\b{old}\b", new)
    return text


def prose(parts: list[Column], most: int) -> Column:
    """The first ``most`` sentences that apply."""
    return F.concat_ws(" ", F.slice(F.array_compact(F.array(*parts)), 1, most))
