"""Joins: exact lookups on distinct keys, and the best fuzzy match."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions.geometry import edges, within_edges
from ..functions.text import similarity
from ..sources.staging import staged
from .scans import positions


def distinct_keys(df: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Each key once; with ``order``, numbered by first appearance."""
    if not order:
        return df.select(key).distinct()
    return df.groupBy(key).agg(F.min(F.struct(*order)).alias("first_seen"))


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(*(F.min_by(F.struct(c), order)[c].alias(c) for c in rest))


def last_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in (key, *order)]
    return df.groupBy(key).agg(*(F.max_by(F.struct(c), F.struct(*order))[c].alias(c) for c in rest))


def lookup(df: DataFrame, table: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Left join to a table of unique keys. strict raises where a key has no row. Its size decides how it is joined."""
    if not strict:
        return df.join(table, key, "left")
    joined = df.join(table.withColumn("__found", F.lit(True)), key, "left")
    check = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))).cast("boolean")).otherwise(True)
    return joined.filter(check).drop("__found")


def via_distinct(df: DataFrame, key: str, resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An expensive lookup on distinct keys only, joined back to all rows."""
    return df.join(resolve(df.filter(F.col(key).isNotNull()).select(key).distinct()), key, "left")


def tokens(text: Column) -> Column:
    """A text's characters, each with how often it came before: a set whose overlap with another text's is the number of characters they share."""
    chars = F.array_sort(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    return F.transform(chars, lambda c, i: F.concat(c, (i - F.array_position(chars, c) + 1).cast("string")))


def indexed(texts: DataFrame, name: str, counts: DataFrame) -> DataFrame:
    """(name, size, known): every text with its tokens that occur among the keys, the rarest first."""
    each = texts.select(name, F.length(name).alias("size"), F.explode_outer(tokens(F.col(name))).alias("token"))
    return each.join(counts, "token", "left").groupBy(name, "size").agg(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "token")))).alias("known"))


def candidate_pairs(queries: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """(query, match): pairs of indexed texts among which all with a ratio >= cutoff are.

    Texts of a and b characters with ratio >= c share at least c (a + b) / 2 characters; as b is at least a c / (2 - c), that is c a / (2 - c) of the a or more.
    So among the a - that + 1 rarest tokens of either text there is one that both have: an equi-join on these, each pair
    taken at the first token it shares. Lengths and the exact number of shared tokens then filter.
    """
    c = F.lit(float(cutoff))

    def rarest(texts: DataFrame, name: str, q: str) -> DataFrame:
        # Tokens that no key has come first of all; they join nothing.
        room = F.col("size") - F.ceil(F.col("size") * c / (2 - c) - 1e-9) + 1 - (F.col("size") - F.size("known"))
        prefix = F.slice("known", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))
        return texts.select(name, F.col("size").alias(f"__size_{q}"), F.col("known").alias(f"__known_{q}"), prefix.alias(f"__prefix_{q}")).withColumn("__token", F.explode(f"__prefix_{q}"))

    both = rarest(queries, "query", "q").join(rarest(names, "match", "m"), "__token")
    a, b = F.col("__size_q"), F.col("__size_m")
    near = both.filter((2 * F.least(a, b) >= (a + b) * c - 1e-9) & (F.array_intersect("__prefix_q", "__prefix_m")[0] == F.col("__token")))
    return near.filter(2 * F.size(F.array_intersect("__known_q", "__known_m")) >= (a + b) * c - 1e-9).select("query", "match")


#: Texts shorter than this have a ratio of 1 with themselves and nothing else; in longer ones the ratio leaves frequent characters out.
POPULAR = 200


def best_matches(df: DataFrame, key: str, table: DataFrame, name: str, cutoff: float, steps: Sequence[float] = (0.7, 0.35, 0)) -> DataFrame:
    """(query, match, score) for every distinct non-null key: the most similar name with score >= cutoff.

    The score is the matching-block ratio 2 M / (length + length); of equal scores the largest string wins, and keys
    without a match have no row. cutoff: 0.05 to 1.

    Nothing is lost, and few pairs are compared: a key that is a name itself is done. The others go through falling thresholds, from near 1
    (steps: parts of the way from the cutoff to 1) down to the cutoff; a best score that reaches the threshold is the best of all, since all pairs that reach it
    were compared (see candidate_pairs), and its key takes no part in the next, wider step.
    """
    if not 0.05 <= cutoff <= 1:
        raise ValueError(f"cutoff {cutoff} is not between 0.05 and 1")
    queries = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("query")).distinct()
    names = table.filter(F.col(name).isNotNull()).select(F.col(name).alias("match")).distinct()
    same = queries.filter(F.length("query") < POPULAR).join(names, F.col("query") == F.col("match")).select("query", "match", F.lit(1.0).alias("score"))
    counts = names.select(F.explode(tokens(F.col("match"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    keys = staged(indexed(names, "match", counts))
    left = staged(indexed(queries.join(same, "query", "left_anti"), "query", counts))
    results = same
    for level in dict.fromkeys(cutoff + s * (1 - cutoff) for s in steps):
        scored = candidate_pairs(left, keys, level).select("query", "match", similarity("match", "query").alias("score")).filter(F.col("score") >= F.lit(float(level)))
        found = staged(scored.groupBy("query").agg(F.max(F.struct("score", "match")).alias("b")).select("query", "b.match", "b.score"))
        results = results.union(found)
        left = left.join(found, "query", "left_anti")
    return results


def match_codes(df: DataFrame, key: str, table: DataFrame, name: str, values: Sequence[str], order: str, cutoff: float = 1.0) -> DataFrame:
    """Rows of df with the values of their key's best match; of a repeated name the first row in ``order`` counts."""
    codes = first_of(table.select(name, order, *values), name, order)
    found = best_matches(df, key, table, name, cutoff).join(codes.withColumnRenamed(name, "match"), "match").select(F.col("query").alias("__query"), *values)
    return df.join(found, F.col(key) == F.col("__query"), "left").drop("__query")


def external_lookup(keys: DataFrame, key: str, client: Callable[[str], object], result: str, attempts: int = 1, metrics: Observation | None = None) -> DataFrame:
    """Ask a service once for each distinct key. client: key -> tuple of the result's fields, or None; it is made part of the tasks.

    A call that fails is made up to ``attempts`` times; then, and where the answer is None, there are NULLs, and ``success`` tells. metrics, once the
    result has been computed, holds asked, found, failed and calls (with those made again), counted in the same pass.
    """
    names, kind = [f.split()[0] for f in result.split(",")], keys.schema[key].dataType.simpleString()

    def ask(k: object) -> tuple:
        for call in range(1, attempts + 1):
            try:
                got = client(k)
            except Exception:  # noqa: BLE001 - a service's failures are results here
                continue
            return (k, *(got if got is not None else [None] * len(names)), got is not None, call)
        return (k, *[None] * len(names), False, attempts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([ask(k) for k in b[key]], columns=[key, *names, "success", "__calls"])

    asked = keys.select(key).distinct().mapInPandas(run, f"`{key}` {kind}, {result}, success boolean, __calls int")
    if metrics is not None:
        found = F.coalesce(F.sum(F.col("success").cast("long")), F.lit(0))
        calls = F.coalesce(F.sum("__calls"), F.lit(0))
        asked = asked.observe(metrics, F.count("*").alias("asked"), found.alias("found"), (F.count("*") - found).alias("failed"), calls.alias("calls"))
    return asked.drop("__calls")


def looked_up(df: DataFrame, key: str, question: Callable[[Column], Column], client: Callable[[str], object], result: str, attempts: int = 3, metrics: Observation | None = None) -> DataFrame:
    """df with the fields that a service answers to a question made from the key; NULL for missing keys and without an answer. Equal questions are asked once."""
    keys = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("__key")).distinct().withColumn("__question", question(F.col("__key")))
    answers = staged(external_lookup(keys, "__question", client, result, attempts, metrics))
    return df.join(keys.join(answers, "__question").drop("__question", "success"), F.col(key) == F.col("__key"), "left").drop("__key")


def within_first(points: DataFrame, zones: DataFrame, x: str, y: str, zone: str = "id", order: str = "zone_idx") -> DataFrame:
    """points with the id of the first zone (in ``order``) they lie strictly within; NULL outside and for missing coordinates.

    zones: id, order, ring ARRAY<STRUCT<x, y>>. Both sides meet by the cells of a quadtree, an equi-join (see zone_cells); most points are decided by the
    cell, the others by the few sides of the ring that concern it.
    """
    cells, frame = zone_cells(zones, zone, order)
    spots = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).distinct()
    levels = sorted(r["__level"] for r in cells.select("__level").distinct().collect())  # at most DEEPEST + 1
    if not levels:
        return points.withColumn("zone", F.lit(None).cast(zones.schema[zone].dataType))
    x0, y0, side = frame
    inside = F.col("__x").between(x0, x0 + side) & F.col("__y").between(y0, y0 + side)
    at = spots.filter(inside).withColumn("__level", F.explode(F.array(*(F.lit(x).cast("long") for x in levels))))
    at = at.withColumns({c: F.floor((F.col(v) - o) / side * F.pow(F.lit(2.0), F.col("__level"))).cast("long") for c, v, o in (("__i", "__x", x0), ("__j", "__y", y0))})
    pairs = at.join(cells, ["__level", "__i", "__j"])
    hit = pairs.filter(F.when(F.col("__whole"), True).otherwise(within_edges(F.col("__x"), F.col("__y"), F.col("__sides")))).groupBy("__x", "__y").agg(F.min_by("__zone", "__order").alias("__found"))
    return points.join(hit, (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y")), "left").withColumn("zone", F.col("__found")).drop("__x", "__y", "__found")


#: Levels a zone's cells go down from about its own size: so many at least, and at most while over SIDES sides concern a cell.
LEAST, MOST, SIDES, DEEPEST = 3, 8, 12, 40
SIDE = ("ax", "ay", "bx", "by")


def cover(sides: np.ndarray, frame: tuple[float, float, float]) -> Iterator[tuple[np.ndarray, ...]]:
    """Leaf cells of a quadtree over one ring: (level, i, j, whole, sides a cell, sides), level by level.

    sides: rows ax, ay, bx, by. All cells of a level are looked at together, as pairs of a cell and a side that concerns it.
    """
    x0, y0, side = frame
    low, high = np.minimum(sides[:2], sides[2:]).min(axis=1), np.maximum(sides[:2], sides[2:]).max(axis=1)
    size = max((high - low).max(), side / 2**DEEPEST)
    level = min(int(math.log2(side / size)), DEEPEST - MOST)
    (i0, j0), (i1, j1) = (((v - (x0, y0)) / side * 2**level).astype(np.int64) for v in (low, high))
    i, j = (g.ravel() for g in np.meshgrid(np.arange(i0, i1 + 1), np.arange(j0, j1 + 1)))
    cell, at = np.repeat(np.arange(len(i)), sides.shape[1]), np.tile(np.arange(sides.shape[1]), len(i))
    for depth in range(MOST + 1):
        half = side / 2.0**level / 2
        w = half * (1 + 1e-6)
        cx, cy = x0 + (2 * i[cell] + 1) * half, y0 + (2 * j[cell] + 1) * half
        ax, ay, bx, by = sides[:, at]
        dx, dy = bx - ax, by - ay
        concern = (np.maximum(ax, bx) >= cx - w) & (np.minimum(ay, by) <= cy + w) & (np.maximum(ay, by) >= cy - w)
        meets = concern & (np.minimum(ax, bx) <= cx + w) & (np.abs(dx * (cy - ay) - dy * (cx - ax)) <= w * (np.abs(dx) + np.abs(dy)) * (1 + 1e-6))
        crosses = (ay > cy) != (by > cy)
        right = crosses & (cx < ax + (cy - ay) * dx / np.where(crosses, dy, 1))
        border = np.bincount(cell[meets], minlength=len(i)) > 0
        whole = ~border & (np.bincount(cell[right], minlength=len(i)) % 2 == 1)
        yield np.full(whole.sum(), level), i[whole], j[whole], np.ones(whole.sum(), bool), np.zeros(whole.sum(), np.int64), np.empty(0, np.int64)
        kept = concern & border[cell]
        cell, at = cell[kept], at[kept]
        count = np.bincount(cell, minlength=len(i))
        split = border & ((depth < LEAST) | (count > SIDES)) & (depth < MOST)
        done = border & ~split
        yield np.full(done.sum(), level), i[done], j[done], np.zeros(done.sum(), bool), count[done], at[done[cell]]
        if not split.any():
            return
        number = np.cumsum(split) - 1
        at, cell = at[split[cell]], number[cell[split[cell]]]
        i, j, level = i[split], j[split], level + 1
        n = len(i)
        i, j = (np.concatenate([2 * v + q for q in o]) for v, o in ((i, (0, 0, 1, 1)), (j, (0, 1, 0, 1))))
        cell, at = np.concatenate([cell + q * n for q in range(4)]), np.tile(at, 4)


def zone_cells(zones: DataFrame, zone: str, order: str) -> tuple[DataFrame, tuple[float, float, float]]:
    """Leaf cells of a quadtree over each zone, and the frame (x, y, side) of the tree: (__zone, __order, __level, __i, __j, __whole, __sides).

    A zone starts with the few cells of about its size that hold it, and each is split where the outline runs through it. A cell that the outline doesn't meet is
    wholly in (__whole) or left out. The others keep those sides of the ring that can be met right of a point in
    them, so that they decide as the whole ring would. Cells count as a little larger than they are, which covers rounding.
    """
    rings = zones.filter(F.size("ring") > 2).select(F.col(zone).alias("__zone"), F.col(order).alias("__order"), edges(F.col("ring")).alias("__sides"))
    far = lambda f, g, a, b: f(F.transform("__sides", lambda e: g(e[a], e[b])))
    m = rings.agg(F.min(far(F.array_min, F.least, "ax", "bx")), F.max(far(F.array_max, F.greatest, "ax", "bx")), F.min(far(F.array_min, F.least, "ay", "by")), F.max(far(F.array_max, F.greatest, "ay", "by"))).first()
    if m[0] is None:
        m = (0.0, 1.0, 0.0, 1.0)
    frame = (m[0], m[2], max(m[1] - m[0], m[3] - m[2], 1e-300) * (1 + 1e-9))
    schema = StructType([*rings.schema.fields[:2], *(StructField(c, LongType()) for c in ("__level", "__i", "__j")), StructField("__whole", BooleanType()), rings.schema["__sides"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                ring = b.column(2).slice(r, 1).flatten()
                sides = np.stack([ring.field(c).to_numpy() for c in SIDE])
                for level, i, j, whole, count, at in cover(sides, frame):
                    if len(level):
                        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in sides[:, at]], SIDE))
                        same = [b.column(k).take(pa.array(np.full(len(level), r))) for k in (0, 1)]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(level), pa.array(i), pa.array(j), pa.array(whole), lists], names=schema.names)

    return staged(rings.mapInArrow(run, schema)), frame


def row_numbers(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (), name: str = "n") -> DataFrame:
    """1, 2, ... in the order, within groups of keys, and total_<name>, the group's rows."""
    return positions(df, keys, order, name)
