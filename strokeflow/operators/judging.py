"""Calls of balls against the calibrated wall. Each step is a column of its own, so that expressions stay small."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wall as W

# Paddings of the gates in pixels, and as shares of the wall's width.
PADS = {"wall": (80.0, 0.85), "side": (120.0, 0.25), "chunk": (24.0, 0.02)}



def clamp(df: DataFrame) -> DataFrame:
    """``df`` (cal, x, y) with ``at_x`` and ``moved``.

    A point beside the wall whose height, at the wall's border, lies between
    the lines counts at the border. All others stay where they are.
    """
    left, right = W.wall_x(F.col("cal"), F.col("y"))
    out = df.withColumns({"_left": left, "_right": right}).withColumn("_border", F.least(F.col("_right"), F.greatest(F.col("_left"), F.col("x"))))
    border = F.col("_border")
    moved = ~F.col("x").between(F.col("_left"), F.col("_right")) & (W.below(F.col("cal")["top"], border, F.col("y")) > 0) & (W.below(F.col("cal")["bottom"], border, F.col("y")) < 0)
    out = out.withColumn("moved", F.coalesce(moved, F.lit(False)))
    return out.withColumn("at_x", F.when(F.col("moved"), border).otherwise(F.col("x"))).drop("_border", "_left", "_right")


def judge(df: DataFrame, serve: bool = False, strict: bool = True) -> DataFrame:
    """``df`` (cal, x, y) with call, reason, top_y, bottom_y and margin.

    A ball on a line is OUT. A ball beside the wall has no call, unless it
    counts at the border. ``margin`` is positive when in and negative when out;
    beside a corner quad, it is minus the distance to it. A ``serve`` has to hit
    above the service line. An invalid band is an error if ``strict``, else its
    call is UNKNOWN. Without a position there is no call and no reason.
    """
    band = df.withColumns({"_cal": F.col("cal"), "cal": F.col("cal").withField("bottom", F.col("cal")["service"])}) if serve else df.withColumn("_cal", F.col("cal"))
    left, right = W.wall_x(F.col("cal"), F.col("y"))
    out = clamp(band).withColumns({"_over": W.below(F.col("cal")["top"], F.col("at_x"), F.col("y")), "_under": -W.below(F.col("cal")["bottom"], F.col("at_x"), F.col("y")), "_beside": ~F.col("at_x").between(left, right)})
    under, between = ("below_or_on_service_line", "between_out_and_service_lines") if serve else ("below_or_on_bottom_line", "between_lines")
    invalid = F.raise_error(F.lit("the calibrated lines do not form a valid wall band")).cast("string") if strict else F.lit("invalid_band")
    reason = (
        F.when(F.col("x").isNull() | F.col("y").isNull(), F.lit(None).cast("string")).when(~W.valid_band(F.col("cal")), invalid).when(F.col("_beside"), "outside_wall_x_bounds")
        .when(F.col("_over") <= 0, "above_or_on_top_line").when(F.col("_under") <= 0, under).when(F.col("moved"), "between_lines_x_clamped").otherwise(between)
    )
    corners = F.col("cal")["corners"]
    outside = corners.isNotNull() & ~W.in_corners(corners, F.col("at_x"), F.col("y"))
    out = out.withColumns({
        "reason": reason, "top_y": W.y_at(F.col("cal")["top"], F.col("at_x")), "bottom_y": W.y_at(F.col("cal")["bottom"], F.col("at_x")),
        "margin": F.when(outside, -W.outside_distance(corners, F.col("at_x"), F.col("y"))).otherwise(F.least("_over", "_under")),
    })
    why = F.col("reason")
    call = F.when(why == "invalid_band", "UNKNOWN").when(why.startswith("between"), "IN").when(why != "outside_wall_x_bounds", "OUT")
    return out.withColumns({"call": call, "cal": F.col("_cal")}).drop("_cal", "_over", "_under", "_beside", "at_x", "moved")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _nearness(r: Column, c: Column, i: Column) -> Column:
    """Struct of squared error, i and v of the point r against connector c; null if it has no length."""
    squared = c["vx"] * c["vx"] + c["vy"] * c["vy"]
    v = F.try_divide((r["x"] - c["tx"]) * c["vx"] + (r["y"] - c["ty"]) * c["vy"], squared)
    ex, ey = r["x"] - (c["tx"] + c["vx"] * v), r["y"] - (c["ty"] + c["vy"] * v)
    return F.when(squared > 1e-9, F.struct((ex * ex + ey * ey).alias("error"), i.alias("i"), v.alias("v")))


def _steps(r: Column, steps: int) -> Column:
    """The steps among which the nearest connector is: those around the connectors that pass through the point, or all if none does.

    A connector passes through the point where a quadratic in u is zero; the
    error falls to nothing there, so the nearest step is next to such a u.
    """
    top, bottom = r["top"], r["bottom"]
    px, py = r["x"] - top["x0"], r["y"] - top["y0"]
    dx, dy = top["x1"] - top["x0"], top["y1"] - top["y0"]
    vx, vy = bottom["x0"] - top["x0"], bottom["y0"] - top["y0"]
    wx, wy = bottom["x1"] - top["x1"] - vx, bottom["y1"] - top["y1"] - vy
    parts = F.struct((px * vy - py * vx).alias("c0"), (px * wy - py * wx - dx * vy + dy * vx).alias("c1"), (dy * wx - dx * wy).alias("c2"))

    def around(p: Column) -> Column:
        half = F.when(p["c1"] < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(F.lit(0.0), p["c1"] * p["c1"] - 4 * p["c0"] * p["c2"]))
        q = (p["c1"] + half) / -2.0
        real = p["c1"] * p["c1"] >= 4 * p["c0"] * p["c2"]
        roots = F.when(real, F.array(F.try_divide(q, p["c2"]), F.try_divide(p["c0"], q)))
        near = F.flatten(F.transform(F.filter(roots, lambda u: u.between(0, 1)), lambda u: F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: (F.floor(u * steps) + d).cast("int"))))
        return F.filter(near, lambda i: i.between(0, steps))

    every = F.sequence(F.lit(0), F.lit(steps))
    return let(let(parts, around), lambda found: F.when(F.size(found) > 0, found).otherwise(every))


def diagram(df: DataFrame, steps: int = 1000) -> DataFrame:
    """``df`` (cal, x, y) with u and v, the place in the tilted quad between both lines.

    Of ``steps`` + 1 connectors between the lines, at equal shares u, the one
    nearest to the point counts, the first of equals; v is 0 on the top line and
    1 on the bottom one. With corners, u is the share of the quad's width.
    Connectors without length are passed over; if all are, both come from the
    borders and lines at the point itself.
    """

    def best(r: Column) -> Column:
        def connector(i: Column) -> Column:
            (tx, ty), (bx, by) = W.point_at(r["top"], i / F.lit(float(steps))), W.point_at(r["bottom"], i / F.lit(float(steps)))
            return let(F.struct(tx.alias("tx"), ty.alias("ty"), (bx - tx).alias("vx"), (by - ty).alias("vy")), lambda c: _nearness(r, c, i))

        return F.array_min(F.transform(r["steps"], connector))  # passes over nulls

    inputs = F.struct(F.col("at_x").alias("x"), F.col("y").alias("y"), F.col("cal")["top"].alias("top"), F.col("cal")["bottom"].alias("bottom"))
    out = clamp(df).withColumn("_best", let(inputs, lambda r: let(r.withField("steps", _steps(r, steps)), best)))
    left, right = W.wall_x(F.col("cal"), F.col("y"))
    out = out.withColumns({"_left": left, "_right": right, "_top": W.y_at(F.col("cal")["top"], F.col("at_x")), "_bottom": W.y_at(F.col("cal")["bottom"], F.col("at_x"))})
    none = F.col("_best").isNull()
    u = F.when(none, F.try_divide(F.col("at_x") - F.col("_left"), F.col("_right") - F.col("_left")))
    u = u.when(F.col("cal")["corners"].isNotNull(), W.corner_share(F.col("cal")["corners"], F.col("at_x"), F.col("y"))).otherwise(F.col("_best.i") / F.lit(float(steps)))
    v = F.when(none, F.try_divide(F.col("y") - F.col("_top"), F.col("_bottom") - F.col("_top"))).otherwise(F.col("_best.v"))
    return out.withColumns({"u": u, "v": v}).drop("_best", "_left", "_right", "_top", "_bottom", "at_x", "moved")


def gates(df: DataFrame, low: Column, high: Column, evaluation: bool = False) -> DataFrame:
    """``df`` (cal, x, y) with the gates wall, side and chunk: whether a ball is on the front wall, generously padded; not beside it, whatever its height; on it or above it (leaving this one ends a visit).

    Corners count first, then lines, then a range of x (``low`` to ``high`` in
    either order; none lets all through). The ``evaluation`` copy (C10) measures
    the wall's pad straight up and down, not perpendicular to the lines, and lets
    runs without calibration through.
    """
    corners, top, bottom = F.col("cal")["corners"], F.col("cal")["top"], F.col("cal")["bottom"]
    high_y, low_y = W.corner_y(corners)
    out = df.withColumns({"_t": high_y, "_b": low_y}).withColumn("_y", F.least(F.greatest(F.col("y"), F.col("_t")), F.col("_b")))
    left, right = W.corner_x(corners, F.col("_y"))
    over, under = (F.col("y") - W.y_at(top, F.col("x")), W.y_at(bottom, F.col("x")) - F.col("y")) if evaluation else (W.below(top, F.col("x"), F.col("y")), -W.below(bottom, F.col("x"), F.col("y")))
    out = out.withColumns({
        "_l": left, "_r": right, "_over": over, "_under": under, "_floor": -W.below(bottom, F.col("x"), F.col("y")), "_u": W.progress(bottom, F.col("x"), F.col("y")),
        "_cornered": corners.isNotNull(), "_lined": top.isNotNull() & bottom.isNotNull(),
    })
    span = F.coalesce(F.abs(high - low), F.lit(0.0))

    def gate(kind: str) -> Column:
        pad, share = PADS[kind]
        wide = F.greatest(F.lit(pad), share * F.greatest(F.lit(0.0), F.col("_r") - F.col("_l")))
        quad, along = F.col("x").between(F.col("_l") - wide, F.col("_r") + wide), F.col("_u").between(-share, 1 + share)
        band = F.lit(True)
        if kind == "wall":
            quad &= F.col("y").between(F.col("_t") - wide, F.col("_b") + wide)
            band = F.coalesce((F.col("_over") >= -pad) & (F.col("_under") >= -pad), F.lit(False))
        if kind == "chunk":
            band = F.col("_floor") >= -pad
            quad &= F.when(F.col("_lined"), band).otherwise(F.col("y") <= F.col("_b") + pad)
        none = F.lit(True) if evaluation else W.in_range(low, high, F.col("x"), F.greatest(F.lit(pad), share * span))
        return F.when(F.col("_cornered"), quad).when(F.col("_lined"), band & along).otherwise(none)

    return out.withColumns({kind: gate(kind) for kind in PADS}).drop("_t", "_b", "_y", "_l", "_r", "_over", "_under", "_floor", "_u", "_cornered", "_lined")
