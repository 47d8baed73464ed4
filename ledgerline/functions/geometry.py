"""Planar geometry as column expressions over arrays of points (x, y)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

XY = "struct<x:double, y:double>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def points(coords: Column | str) -> Column:
    """``'x,y x,y'`` as an array of (x, y)."""
    pair = lambda p: F.struct(F.split(p, ",")[0].cast("int").alias("x"), F.split(p, ",")[1].cast("int").alias("y"))
    return F.transform(F.split(col(coords), " "), pair)


def min_x(pts: Column | str) -> Column:
    return F.array_min(F.transform(col(pts), lambda p: p["x"])).cast("double")


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def edges(ring: Column) -> Column:
    """The sides of a ring as (ax, ay, bx, by), the last one back to the start."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    side = lambda a, b: F.struct(a["x"].cast("double").alias("ax"), a["y"].cast("double").alias("ay"), b["x"].cast("double").alias("bx"), b["y"].cast("double").alias("by"))
    return F.zip_with(ring, following, side)


def half_hull(ordered: Column) -> Column:
    """Points of a sorted array that no later one makes turn the wrong way, without the last: half of a convex hull."""

    def left_turn(a: Column, b: Column, c: Column) -> Column:
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]) > 0

    def step(kept: Column, c: Column) -> Column:
        # Points go from the end until one is left, or the last two and the new one turn left.
        stays = F.filter(F.sequence(F.lit(1), F.size(kept)), lambda k: (k == 1) | left_turn(F.get(kept, k - 2), F.get(kept, k - 1), c))
        return F.concat(F.slice(kept, F.lit(1), F.array_max(stays)), F.array(c))

    chain = F.aggregate(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 1, 1), step)
    return let(chain, lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))))


def hull(pts: Column) -> Column:
    """Convex hull, counter-clockwise, without collinear points; up to two distinct points are themselves."""
    distinct = F.array_sort(F.array_distinct(F.transform(pts, lambda p: xy(p["x"], p["y"]))))
    return let(distinct, lambda p: F.when(F.size(p) < 3, p).otherwise(F.concat(half_hull(p), half_hull(F.reverse(p)))))


def rotated_sides(pts: Column | str) -> Column:
    """(width, length) of the smallest rectangle around the points; one of its sides lies on a side of their hull. NULL for NULL, 0 for one point."""

    def extent(h: Column, ux: Column, uy: Column) -> Column:
        at = F.transform(h, lambda p: p["x"] * ux + p["y"] * uy)
        return let(at, lambda a: F.array_max(a) - F.array_min(a))

    def box(h: Column, e: Column, i: Column) -> Column:
        unit = let(F.sqrt((e["bx"] - e["ax"]) * (e["bx"] - e["ax"]) + (e["by"] - e["ay"]) * (e["by"] - e["ay"])), lambda n: xy((e["bx"] - e["ax"]) / n, (e["by"] - e["ay"]) / n))
        spans = let(unit, lambda u: F.struct(extent(h, u["x"], u["y"]).alias("a"), extent(h, -u["y"], u["x"]).alias("b")))
        return let(spans, lambda s: F.struct((s["a"] * s["b"]).alias("area"), i.alias("i"), F.least(s["a"], s["b"]).alias("width"), F.greatest(s["a"], s["b"]).alias("length")))

    def smallest(h: Column) -> Column:
        least = F.array_min(F.transform(edges(h), lambda e, i: box(h, e, i)))
        point = F.struct(F.lit(0.0).alias("width"), F.lit(0.0).alias("length"))
        return F.when(F.size(h) < 2, point).otherwise(F.struct(least["width"].alias("width"), least["length"].alias("length")))

    return F.when(col(pts).isNotNull(), let(hull(col(pts)), smallest))


def line_steps(line: Column) -> Column:
    """The pieces of a line as (ax, ay, bx, by, n, end): n their length, end the line's length up to their end."""
    pieces = F.transform(F.slice(edges(line), F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), lambda e: e.withField("n", F.sqrt((e["bx"] - e["ax"]) * (e["bx"] - e["ax"]) + (e["by"] - e["ay"]) * (e["by"] - e["ay"]))))
    kind = "array<struct<ax:double, ay:double, bx:double, by:double, n:double, end:double>>"
    add = lambda done, e: F.concat(done, F.array(e.withField("end", F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0.0)) + e["n"])))
    return F.aggregate(pieces, F.array().cast(kind), add)


def along(line: Column, fraction: Column) -> Column:
    """The point at a fraction of the line's length; the start of a line without length."""

    def on(steps: Column) -> Column:
        target = fraction * F.get(steps, F.size(steps) - 1)["end"]
        piece = F.filter(steps, lambda e: e["end"] >= target)[0]
        t = lambda e: (target - (e["end"] - e["n"])) / e["n"]
        return let(piece, lambda e: F.when(e["n"] > 0, xy(e["ax"] + t(e) * (e["bx"] - e["ax"]), e["ay"] + t(e) * (e["by"] - e["ay"]))).otherwise(xy(e["ax"], e["ay"])))

    return F.when(F.size(line) > 1, let(line_steps(line), on)).otherwise(xy(line[0]["x"], line[0]["y"]))


def line_centroid(line: Column) -> Column:
    """The mean of a line's points, by length; the start of a line without length."""

    def mean(steps: Column) -> Column:
        whole = total(F.transform(steps, lambda e: e["n"]))
        middle = lambda a, b: total(F.transform(steps, lambda e: (e[a] + e[b]) / 2 * e["n"])) / whole
        return F.when(whole > 0, xy(middle("ax", "bx"), middle("ay", "by"))).otherwise(xy(line[0]["x"], line[0]["y"]))

    return let(line_steps(line), mean)


def centroid(ring: Column | str) -> Column:
    """Centroid of a polygon's ring; of a ring without area that of its outline, of a single point the point. NULL for none."""
    ring = col(ring)
    cross = lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]

    def mean(sides: Column) -> Column:
        twice = total(F.transform(sides, cross))
        middle = lambda a, b: total(F.transform(sides, lambda e: (e[a] + e[b]) * cross(e))) / (3 * twice)
        return F.when(F.abs(twice) > 1e-300, xy(middle("ax", "bx"), middle("ay", "by"))).otherwise(line_centroid(F.concat(ring, F.slice(ring, 1, 1))))

    return F.when(F.size(ring) > 1, let(edges(ring), mean)).when(F.size(ring) == 1, xy(ring[0]["x"], ring[0]["y"]))


def within_edges(x: Column, y: Column, sides: Column) -> Column:
    """Strictly inside the polygon of these sides: on none of them, and an odd number of them right of the point. Sides that lie wholly left, above or below may be missing."""

    def on_side(e: Column) -> Column:
        cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        between = x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
        return between & (cross == 0)

    def right(e: Column) -> Column:
        crosses = (e["ay"] > y) != (e["by"] > y)
        return F.when(crosses, x < e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])).otherwise(False)

    return ~F.exists(sides, on_side) & (F.size(F.filter(sides, right)) % 2 == 1)


def within(x: Column | str, y: Column | str, ring: Column | str) -> Column:
    """Strictly inside a polygon; points on its boundary are not within it. NULL for missing values."""
    x, y, ring = col(x), col(y), col(ring)
    return F.when(x.isNotNull() & y.isNotNull() & ring.isNotNull(), within_edges(x, y, edges(ring)))
