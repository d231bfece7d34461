"""Points under homographies, lens distortion, cameras and image lines, and court boxes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import COURT_LENGTH_FT, COURT_WIDTH_FT

# Marks of the court's floor in feet, and heights on its walls.
SHORT_LINE_FT, SERVICE_BOX_FT = 18.0, 5.25
OUT_FRONT_FT, OUT_BACK_FT, TIN_TOP_FT = 15.0, 7.0, 19.0 / 12.0


def at(h: Column, i: int) -> Column:
    return F.get(h, F.lit(i))


def apply_homography(h: Column, x: Column, y: Column) -> Column:
    """Struct of u and v of a point under ``h`` (nine numbers, row by row); null where it maps to infinity."""
    w = at(h, 6) * x + at(h, 7) * y + at(h, 8)
    return F.when(F.abs(w) > 1e-12, F.struct(F.try_divide(at(h, 0) * x + at(h, 1) * y + at(h, 2), w).alias("u"), F.try_divide(at(h, 3) * x + at(h, 4) * y + at(h, 5), w).alias("v")))


def invert_homography(h: Column) -> Column:
    """The inverse, scaled to a last number of 1; null if there is none."""
    a, b, c, d, e, f, g, k, i = (at(h, n) for n in range(9))
    cofactors = [e * i - f * k, c * k - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * k - e * g, b * g - a * k, a * e - b * d]
    det = a * cofactors[0] + b * cofactors[3] + c * cofactors[6]
    return F.when((F.abs(det) > 1e-300) & (cofactors[8] != 0), F.array(*[F.try_divide(m, cofactors[8]) for m in cofactors]))


def undistort(x: Column, y: Column, k1: Column, cx: Column, cy: Column, norm: Column) -> Column:
    """Struct of x and y by the division model; unchanged where k1 is null, null where the factor collapses."""
    dx, dy = x - cx, y - cy
    factor = 1 + k1 * ((dx * dx + dy * dy) / (norm * norm))
    found = F.when(F.abs(factor) > 1e-9, F.struct((cx + F.try_divide(dx, factor)).alias("x"), (cy + F.try_divide(dy, factor)).alias("y")))
    return F.when(k1.isNull(), F.struct(x.alias("x"), y.alias("y"))).otherwise(found)


def distort(x: Column, y: Column, k1: Column, cx: Column, cy: Column, norm: Column) -> Column:
    """The inverse of :func:`undistort`; null outside its range."""
    dx, dy = x - cx, y - cy
    r = F.hypot(dx, dy) / norm
    left = 1 - 4 * k1 * r * r
    scale = F.try_divide(F.try_divide(1 - F.sqrt(F.greatest(F.lit(0.0), left)), 2 * k1 * r), r)
    same = k1.isNull() | (r <= 1e-12) | (F.abs(k1) <= 1e-12)
    return F.when(same, F.struct(x.alias("x"), y.alias("y"))).when(left >= 0, F.struct((cx + dx * scale).alias("x"), (cy + dy * scale).alias("y")))


def _camera_point(cam: Column, p: tuple[Column, Column, Column]) -> list[Column]:
    """A court point in the camera's own axes; ``cam`` has rotation (nine numbers), center (three), focal, cx and cy."""
    d = [v - at(cam["center"], i) for i, v in enumerate(p)]
    return [sum((at(cam["rotation"], 3 * r + i) * d[i] for i in (1, 2)), at(cam["rotation"], 3 * r) * d[0]) for r in range(3)]


def depth(cam: Column, x: Column, y: Column, z: Column) -> Column:
    """Distance in front of the camera."""
    return _camera_point(cam, (x, y, z))[2]


def project(cam: Column, x: Column, y: Column, z: Column) -> Column:
    """Struct of the pixel u, v of a court point; null at or behind the camera."""
    px, py, pz = _camera_point(cam, (x, y, z))
    return F.when(pz > 1e-9, F.struct((cam["focal"] * F.try_divide(px, pz) + cam["cx"]).alias("u"), (cam["focal"] * F.try_divide(py, pz) + cam["cy"]).alias("v")))


def ray(cam: Column, u: Column, v: Column) -> Column:
    """Unit direction dx, dy, dz in the court of the ray through a pixel."""
    d = [(u - cam["cx"]) / cam["focal"], (v - cam["cy"]) / cam["focal"], F.lit(1.0)]
    out = [sum((at(cam["rotation"], 3 * r + c) * d[r] for r in (1, 2)), at(cam["rotation"], c) * d[0]) for c in range(3)]
    norm = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])  # a rotation keeps lengths
    return F.struct(*[(o / norm).alias(n) for o, n in zip(out, ("dx", "dy", "dz"))])


def scale_camera(cam: Column, factor: Column) -> Column:
    """The camera of a picture resized by ``factor``."""
    return cam.withField("focal", cam["focal"] * factor).withField("cx", cam["cx"] * factor).withField("cy", cam["cy"] * factor)


def box_of(points: Column) -> Column:
    """X, y, w, h of the axis-aligned box around an array of points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h"))


def streak(points: Column) -> Column:
    """The two points of an annotation that are furthest apart (the first of equals), their distance, the width across it, angle and aspect; null for fewer than two distinct points."""
    index = F.sequence(F.lit(0), F.size(points) - 1)
    squared = lambda a, b: F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)
    pairs = F.flatten(F.transform(index, lambda i: F.transform(F.filter(index, lambda j: j > i), lambda j: F.struct((-squared(F.get(points, i), F.get(points, j))).alias("d"), i.alias("i"), j.alias("j")))))
    best = F.when(F.size(points) >= 2, F.array_min(pairs))

    def measured(b: Column) -> Column:
        p, q, long = F.get(points, b["i"]), F.get(points, b["j"]), F.sqrt(-b["d"])
        ux, uy = F.try_divide(q["x"] - p["x"], long), F.try_divide(q["y"] - p["y"], long)
        wide = 2 * F.array_max(F.transform(points, lambda c: F.abs((c["x"] - p["x"]) * uy - (c["y"] - p["y"]) * ux)))
        aspect = F.when(wide > 0, F.try_divide(long, wide)).otherwise(1.0)
        row = F.struct(long.alias("length"), wide.alias("width"), F.degrees(F.atan2(q["y"] - p["y"], q["x"] - p["x"])).alias("angle"), aspect.alias("aspect"), b["i"].alias("i"), b["j"].alias("j"))
        return F.when(long > 0, row)

    return F.get(F.transform(F.array(best), lambda b: F.when(b.isNotNull(), measured(b))), F.lit(0))


def line_through(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Struct a, b, c of the line a x + b y + c = 0 with a unit normal; null for equal points."""
    a, b, c = y0 - y1, x1 - x0, x0 * y1 - x1 * y0
    n = F.hypot(a, b)
    return F.when(n > 1e-9, F.struct(*[F.try_divide(v, n).alias(k) for v, k in ((a, "a"), (b, "b"), (c, "c"))]))


def meet(p: Column, q: Column) -> Column:
    """Where two lines cross, x and y; null for parallel ones."""
    w = p["a"] * q["b"] - q["a"] * p["b"]
    return F.when(F.abs(w) > 1e-12, F.struct(F.try_divide(p["b"] * q["c"] - q["b"] * p["c"], w).alias("x"), F.try_divide(q["a"] * p["c"] - p["a"] * q["c"], w).alias("y")))


def cross_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.try_divide((a - c) * (b - d), (b - c) * (a - d))


def direction_delta(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The unsigned angle between two directions in degrees."""
    return F.abs(F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by)))


def passes(line: Column, mx: Column, my: Column, vx: Column, vy: Column, vw: Column, tolerance: float) -> Column:
    """Whether a line (unit normal a, b) seen from its middle points at (vx, vy, vw), a point that may be at infinity."""
    dx, dy = vx - mx * vw, vy - my * vw
    reach = F.hypot(dx, dy)
    sine = F.abs(F.try_divide(line["b"] * dy + line["a"] * dx, reach))
    return (reach < 1e-12) | (F.degrees(F.asin(F.least(F.lit(1.0), sine))) <= tolerance)


def floor_zone(x: Column, y: Column, columns: int = 3, rows: int = 4) -> Column:
    """Zone (1-based, row by row from the front wall), row, column, place, and flags of a point of the floor; outside points count at the edge."""
    px, py = F.least(F.lit(COURT_WIDTH_FT), F.greatest(F.lit(0.0), x)), F.least(F.lit(COURT_LENGTH_FT), F.greatest(F.lit(0.0), y))
    column = F.least(F.lit(columns - 1), F.floor(px / COURT_WIDTH_FT * columns)).cast("int")
    row = F.least(F.lit(rows - 1), F.floor(py / COURT_LENGTH_FT * rows)).cast("int")
    deep = py.between(SHORT_LINE_FT, SHORT_LINE_FT + SERVICE_BOX_FT)
    return F.struct(
        (row * columns + column + 1).alias("zone"), row.alias("row"), column.alias("column"), F.bround(px, 2).alias("x_ft"), F.bround(py, 2).alias("y_ft"), (py >= SHORT_LINE_FT).alias("behind_short_line"),
        (deep & (px <= SERVICE_BOX_FT)).alias("in_left_service_box"), (deep & (px >= COURT_WIDTH_FT - SERVICE_BOX_FT)).alias("in_right_service_box"),
        F.when(px < COURT_WIDTH_FT / 2, "left").otherwise("right").alias("side"),
    )


def screen_box(x: Column, y: Column, w: Column, h: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """A box in shares of a picture, y upwards, as a box on the screen where the picture is shown, y downwards."""
    return F.struct((left + x * width).alias("x"), (top + (1 - y - h) * height).alias("y"), (w * width).alias("w"), (h * height).alias("h"))


def fitted(picture_w: Column, picture_h: Column, view_w: Column, view_h: Column) -> Column:
    """The largest box of a picture's shape in the middle of a view."""
    scale = F.least(F.try_divide(view_w, picture_w), F.try_divide(view_h, picture_h))
    w, h = picture_w * scale, picture_h * scale
    return F.struct(((view_w - w) / 2).alias("x"), ((view_h - h) / 2).alias("y"), w.alias("w"), h.alias("h"))


def side_out_height(y: Column) -> Column:
    """Height of the out line on a side wall, falling from the front wall to the back."""
    return F.lit(OUT_FRONT_FT) + (OUT_BACK_FT - OUT_FRONT_FT) * (y / COURT_LENGTH_FT)


def surface_call(surface: Column, x: Column, y: Column, z: Column) -> Column:
    """Struct of call (in, out, down, bounce) and margin, the distance to the deciding line, of an impact on a surface; null for an unknown one."""
    row = lambda call, margin: F.struct(F.lit(call).alias("call"), margin.alias("margin"))
    front = F.when(z >= OUT_FRONT_FT, row("out", z - OUT_FRONT_FT)).when(z <= TIN_TOP_FT, row("down", TIN_TOP_FT - z)).otherwise(row("in", F.least(OUT_FRONT_FT - z, z - TIN_TOP_FT)))
    line = F.when(surface == "back_wall", OUT_BACK_FT).otherwise(side_out_height(y))
    other = F.when(z >= line, row("out", z - line)).otherwise(row("in", line - z))
    return F.when(surface == "floor", row("bounce", F.lit(0.0))).when(surface == "front_wall", front).when(surface.isin("left_wall", "right_wall", "back_wall"), other)


def surface_distances(x: Column, y: Column, z: Column) -> Column:
    """Distance of a court point to the floor, the front wall and the nearer side wall, and the nearest of them (the first of equals)."""
    parts = {"floor": z, "wall": y, "side": F.least(x, COURT_WIDTH_FT - x)}
    nearest = F.array_min(F.array(*[F.struct(v.alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, v) in enumerate(parts.items())]))
    return F.struct(*[v.alias(n) for n, v in parts.items()], nearest["name"].alias("nearest"))


def positional_sigma(cam: Column, x: Column, y: Column, z: Column, surface: Column, pixel_sigma: float, least: float) -> Column:
    """Pixel noise in feet at a court point, larger where the surface's normal lies along the view."""
    seen = project(cam, x, y, z)
    d = ray(cam, seen["u"], seen["v"])
    along = F.when(surface == "floor", d["dz"]).when(surface == "wall", d["dy"]).otherwise(d["dx"])
    observed = F.greatest(F.lit(0.2), F.sqrt(F.greatest(F.lit(0.0), 1 - along * along)))
    return F.greatest(F.lit(least), F.try_divide(pixel_sigma * depth(cam, x, y, z) / cam["focal"], observed))


def in_court(x: Column, y: Column, z: Column, margin: float = 2.0) -> Column:
    """Within the court's volume, up to the out line, and a margin."""
    return x.between(-margin, COURT_WIDTH_FT + margin) & y.between(-margin, COURT_LENGTH_FT + margin) & z.between(-margin, OUT_FRONT_FT + margin)


def in_surface(surface: Column, x: Column, y: Column, z: Column, slack: float = 0.5) -> Column:
    """Within a surface's bounds and a slack."""
    wide, long, up = x.between(-slack, COURT_WIDTH_FT + slack), y.between(-slack, COURT_LENGTH_FT + slack), z >= -slack
    return F.when(surface == "floor", wide & long).when(surface.isin("front_wall", "back_wall"), wide & up).otherwise(long & up)


def snap(cam: Column, d: Column, surface: Column) -> Column:
    """Where a ray (a column, from :func:`ray`) meets a surface, x, y, z; null if it runs along it or lies behind. Whether it is within bounds says :func:`in_surface`."""
    o = [at(cam["center"], i) for i in range(3)]
    on = {"floor": (2, 0.0), "front_wall": (1, 0.0), "back_wall": (1, COURT_LENGTH_FT), "left_wall": (0, 0.0), "right_wall": (0, COURT_WIDTH_FT)}
    t = F.lit(None).cast("double")
    for name, (axis, value) in on.items():
        way = d[("dx", "dy", "dz")[axis]]
        t = F.when((surface == name) & (F.abs(way) >= 1e-6), F.try_divide(value - o[axis], way)).otherwise(t)
    p = [o[i] + t * d[n] for i, n in enumerate(("dx", "dy", "dz"))]
    return F.when(t > 0, F.struct(*[v.alias(n) for v, n in zip(p, ("x", "y", "z"))]))
