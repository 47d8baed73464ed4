"""Geometry and projections: the expressions against plain numpy, published control points and forward formulas."""

import math
import random
from collections.abc import Sequence

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import geometry, projection
from ledgerline.operators import geo, match

Points = Sequence[tuple[float, float]]
RING = "array<struct<x: double, y: double>>"


def hull(pts: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without collinear points."""
    p = sorted(set(map(tuple, pts.tolist())))
    if len(p) < 3:
        return np.array(p, float)

    def chain(points_: Points) -> list:
        out: list = []
        for c in points_:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]), float)


def least_rectangles(pts: Points) -> list[tuple[float, float]]:
    """(width, length) of the rectangles around the points that have a side on one of their hull, of least area: several where areas are equal."""
    h = hull(np.asarray(pts, float).reshape(-1, 2))
    if len(h) < 2:
        return [(0.0, 0.0)]
    edges = np.roll(h, -1, axis=0) - h
    edges = edges / np.linalg.norm(edges, axis=1, keepdims=True)
    along, across = h @ edges.T, h @ np.stack([-edges[:, 1], edges[:, 0]])
    a, b = np.ptp(along, axis=0), np.ptp(across, axis=0)
    return [(min(x, y), max(x, y)) for x, y in zip(a, b, strict=True) if x * y <= (a * b).min() + 1e-9]


def along(line: Points, fraction: float) -> tuple[float, float]:
    """The point at a fraction of the line's length."""
    p = np.asarray(line, float)
    step = np.linalg.norm(np.diff(p, axis=0), axis=1)
    target, total = fraction * step.sum(), np.cumsum(step)
    k = min(int(np.searchsorted(total, target)), len(step) - 1) if len(step) else 0
    if not len(step) or step[k] == 0:
        return float(p[0][0]), float(p[0][1])
    t = (target - (total[k] - step[k])) / step[k]
    return tuple(map(float, p[k] + t * (p[k + 1] - p[k])))


def line_centroid(line: Points) -> tuple[float, float]:
    p = np.asarray(line, float)
    step = np.linalg.norm(np.diff(p, axis=0), axis=1)
    if step.sum() == 0:
        return float(p[0][0]), float(p[0][1])
    return tuple(map(float, ((p[1:] + p[:-1]) / 2 * step[:, None]).sum(axis=0) / step.sum()))


def polygon_centroid(ring: Points) -> tuple[float, float]:
    p = np.asarray(ring, float)
    q = np.roll(p, -1, axis=0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    if math.isclose(cross.sum(), 0, abs_tol=1e-300):
        return line_centroid([*ring, ring[0]])
    return tuple(map(float, ((p + q) * cross[:, None]).sum(axis=0) / (3 * cross.sum())))


def inside(x: float, y: float, ring: Points) -> bool:
    """Strictly inside a polygon; points on its boundary are not within it."""
    p = np.asarray(ring, float)
    q = np.roll(p, -1, axis=0)
    cross = (q[:, 0] - p[:, 0]) * (y - p[:, 1]) - (q[:, 1] - p[:, 1]) * (x - p[:, 0])
    between = (np.minimum(p[:, 0], q[:, 0]) <= x) & (x <= np.maximum(p[:, 0], q[:, 0])) & (np.minimum(p[:, 1], q[:, 1]) <= y) & (y <= np.maximum(p[:, 1], q[:, 1]))
    if (between & (cross == 0)).any():
        return False
    span = (p[:, 1] > y) != (q[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1])
    return bool((span & (x < at)).sum() % 2)


def shapes(seed, n=150):
    r = random.Random(seed)
    out = [[(1.0, 1.0)], [(0.0, 0.0), (3.0, 4.0)], [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], [(2.0, 2.0)] * 3, [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (1.0, 1.0)]]
    for _ in range(n):
        k = r.randint(1, 12)
        out.append([(float(r.randint(0, 9)), float(r.randint(0, 9))) if k % 2 else (r.uniform(-5, 5), r.uniform(-5, 5)) for _ in range(k)])
    return out


def test_rectangles_centroids_and_lines_are_those_of_numpy(spark):
    rings = shapes(1)
    df = spark.createDataFrame([(i, x, 0.37) for i, x in enumerate(rings)], f"i int, p {RING}, f double")
    rows = df.select("i", geometry.rotated_sides("p").alias("s"), geometry.centroid("p").alias("c"), geometry.along(F.col("p"), F.col("f")).alias("a"), geometry.line_centroid(F.col("p")).alias("l")).collect()
    for x in rows:
        p = rings[x.i]
        assert any((x.s.width, x.s.length) == pytest.approx(y, abs=1e-9) for y in least_rectangles(p)), p
        assert tuple(x.c) == pytest.approx(polygon_centroid(p) if len(p) > 1 else p[0], abs=1e-6), p
        if len(p) > 1:
            assert tuple(x.a) == pytest.approx(along(p, 0.37), abs=1e-9) and tuple(x.l) == pytest.approx(line_centroid(p), abs=1e-9)
    gone = spark.createDataFrame([(None, None)], f"p {RING}, c string").select(geometry.rotated_sides("p").alias("s"), geometry.centroid("p").alias("c"), geometry.points("c").alias("q")).first()
    assert gone.s is None and gone.c is None and gone.q is None


def test_structuring_lines_runs_no_python(spark):
    from ledgerline.operators import lines

    df = spark.createDataFrame([(0, 0, 0, "x", "0,0 9,0 9,2 0,2")], "page_idx int, col_idx int, line_idx int, content string, coords string")
    measured = lines.measured(df)
    assert (measured.first().minx, measured.first().bbox_height) == (0, 2)
    assert "Python" not in measured._jdf.queryExecution().executedPlan().toString()


def test_within_is_that_of_numpy(spark):
    r = random.Random(4)
    rings = [x for x in shapes(3) if len(x) > 2]
    spots = [(i, float(r.randint(0, 9)), float(r.randint(0, 9))) for i in range(len(rings)) for _ in range(8)] + [(i, r.uniform(-5, 5), r.uniform(-5, 5)) for i in range(len(rings)) for _ in range(8)]
    df = spark.createDataFrame([(i, x, y, rings[i]) for i, x, y in spots], f"i int, x double, y double, p {RING}")
    for x in df.select("i", "x", "y", geometry.within("x", "y", "p").alias("w")).collect():
        assert x.w == inside(x.x, x.y, rings[x.i])


@pytest.mark.parametrize("seed", [1, 2])
def test_the_quadtree_finds_the_first_zone(spark, seed):
    """Stars, slivers, boxes and tiny zones of very different sizes; points on corners, sides and anywhere."""
    r = random.Random(seed)
    star = lambda x, y, s, n: [(x + s * (1 if c % 2 else 0.3) * math.cos(2 * math.pi * c / n), y + s * (1 if c % 2 else 0.3) * math.sin(2 * math.pi * c / n)) for c in range(n)]
    rings = [star(r.uniform(0, 100), r.uniform(0, 100), 10 ** r.uniform(-2, 1.5), 2 * r.randint(2, 40)) for _ in range(30)]
    rings += [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)] for x, y, w, h in ((10.0, 10.0, 20.0, 20.0), (30.0, 10.0, 20.0, 20.0), (0.0, 0.0, 100.0, 0.001), (50.0, 0.0, 0.001, 100.0))]
    rings += [[(0.0, 0.0), (100.0, 99.0), (100.0, 100.0), (0.0, 0.5)], [(5.0, 5.0)], [(1.0, 1.0), (2.0, 2.0)], None]
    corners = [p for x in rings if x for p in x]
    spots = [r.choice(corners) for _ in range(60)] + [(float(r.randint(0, 100)), float(r.randint(0, 100))) for _ in range(100)] + [(r.uniform(-5, 105), r.uniform(-5, 105)) for _ in range(400)]
    spots += [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for x in rings[:8] for a, b in zip(x, x[1:], strict=False)] + [(30.0, 20.0), (None, 1.0), (float("nan"), 1.0), (math.inf, 1.0)]
    zones = spark.createDataFrame([(f"z{i}", (i * 7) % 37, x) for i, x in enumerate(rings)], f"id string, zone_idx int, ring {RING}")
    got = match.within_first(spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "i int, x double, y double"), zones, "x", "y").collect()
    assert len(got) == len(spots)
    order = sorted((i * 7 % 37, i) for i, x in enumerate(rings) if x and len(x) > 2)
    for x in got:
        want = None if x.x is None or not math.isfinite(x.x) else next((f"z{i}" for _, i in order if inside(x.x, x.y, rings[i])), None)
        assert x.zone == want, (x, want)
    assert match.within_first(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), zones.limit(0), "x", "y").first().zone is None


def test_cells_decide_most_points(spark):
    ring = [(math.cos(c / 100 * math.pi), math.sin(c / 100 * math.pi)) for c in range(200)]
    cells, (_, _, side) = match.zone_cells(spark.createDataFrame([(1, 0, ring)], f"id int, zone_idx int, ring {RING}"), "id", "zone_idx")
    rows = cells.collect()
    area = sum((side / 2**x["__level"]) ** 2 for x in rows if x["__whole"])
    assert area > 0.75 * math.pi and max(len(x["__sides"]) for x in rows if not x["__whole"]) <= 40 and len(rows) < 400


# Published examples: Trinidad 1903 (Cassini, in links) and a position vector shift.
TRINIDAD = projection.Cassini(projection.Ellipsoid(31706587.88, 294.2606764), 10 + 26.5 / 60, -(61 + 20 / 60), 430000.0, 325000.0)


def test_published_points(spark):
    at = spark.range(1).select(projection.geographic(F.lit(66644.94), F.lit(82536.22), TRINIDAD).alias("p")).first().p
    assert (math.degrees(at.y), math.degrees(at.x)) == pytest.approx((10.0, -62.0), abs=1e-6)
    v = F.struct(F.lit(3657660.66).alias("x"), F.lit(255768.55).alias("y"), F.lit(5201382.11).alias("z"))
    moved = spark.range(1).select(projection.shifted(v, projection.Shift(0, 0, 4.5, 0, 0, 0.554, 0.219)).alias("v")).first().v
    assert tuple(moved) == pytest.approx((3657660.78, 255778.43, 5201387.75), abs=0.01)


def forward(lon, lat, p):
    """Degrees to Cassini-Soldner coordinates."""
    e2, a = p.ellipsoid.e2, p.ellipsoid.a
    f = math.radians(lat)
    n = a / math.sqrt(1 - e2 * math.sin(f) ** 2)
    t, d, c = math.tan(f) ** 2, math.radians(lon - p.lon) * math.cos(f), e2 / (1 - e2) * math.cos(f) ** 2
    x = n * (d - t * d**3 / 6 - (8 - t + 8 * c) * t * d**5 / 120)
    y = projection.meridian_arc(p.ellipsoid, f) - projection.meridian_arc(p.ellipsoid, math.radians(p.lat)) + n * math.tan(f) * (d**2 / 2 + (5 - t + 6 * c) * d**4 / 24)
    return p.easting + x, p.northing + y


def test_projection_is_the_inverse_of_the_forward_formula(spark):
    r = random.Random(6)
    places = [(13.62720366666667, 52.41864827777778), *((r.uniform(13.0, 13.9), r.uniform(52.3, 52.7)) for _ in range(40))]
    df = spark.createDataFrame([(i, *forward(*p, projection.BERLIN)) for i, p in enumerate(places)], "i int, x double, y double")
    for x in df.select("i", projection.geographic(F.col("x"), F.col("y"), projection.BERLIN).alias("g"), projection.to_wgs84(F.col("x"), F.col("y")).alias("w")).collect():
        lon, lat = places[x.i]
        assert (math.degrees(x.g.x), math.degrees(x.g.y)) == pytest.approx((lon, lat), abs=1e-8)  # a millimetre
        # Geodetic places of the old datum lie some 150 m from those of WGS 84 here.
        metres = math.hypot((x.w.x - lon) * 111_320 * math.cos(math.radians(lat)), (x.w.y - lat) * 111_200)
        assert 100 < metres < 200 and x.w.x < lon and x.w.y < lat
    assert spark.createDataFrame([(None, 1.0)], "x double, y double").select(projection.to_wgs84(F.col("x"), F.col("y")).alias("w")).first().w is None


def test_earth_centred_places_and_back(spark):
    df = spark.createDataFrame([(lon, lat) for lon in (-120.0, 0.0, 13.4) for lat in (-60.0, 0.0, 52.5, 89.0)], "lon double, lat double")
    there = projection.earth_centred(F.radians("lon"), F.radians("lat"), projection.WGS84)
    for x in df.select("lon", "lat", projection.on_ellipsoid(there, projection.WGS84).alias("g")).collect():
        assert (math.degrees(x.g.x), math.degrees(x.g.y)) == pytest.approx((x.lon, x.lat), abs=1e-9)


def test_streets_and_lots_in_degrees(spark):
    street = f"name string, num_1 string, num_2 string, num_3 string, num_4 string, line {RING}, row_idx int"
    line = [(40000.0, 10000.0), (41000.0, 10000.0)]
    got = {x.address: (x.x, x.y) for x in geo.street_addresses(spark.createDataFrame([("S", "1", "4", ".", ".", line, 0)], street), reproject=True).collect()}
    start = spark.range(1).select(projection.to_wgs84(F.lit(40000.0), F.lit(10000.0)).alias("w")).first().w
    assert got["S 1"] == got["S 2"] == (start.x, start.y) and 13.6 < got["S 4"][0] < 13.7 and set(got) == {"S 1", "S 2", "S 3", "S 4"}
    lots = spark.createDataFrame([("a", None, None, [(40000.0, 10000.0), (40010.0, 10000.0), (40010.0, 10010.0), (40000.0, 10010.0)], 0)], f"adress1 string, adress2 string, adress3 string, ring {RING}, row_idx int")
    at = geo.lot_addresses(lots, reproject=True).first()
    assert 0 < at.x - start.x < 0.0002 and 0 < at.y - start.y < 0.0002
