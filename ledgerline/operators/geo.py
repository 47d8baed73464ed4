"""Addresses to coordinates: interpolation along streets, centroids of lots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.geometry import along, centroid, line_centroid, xy
from ..functions.projection import line_to_wgs84
from .match import best_matches, last_of, looked_up
from .scans import forward_fill


def street_addresses(streets: DataFrame, legacy_pad: bool = False, reproject: bool = False) -> DataFrame:
    """(address, x, y) for the house numbers of streets: name, num_1..num_4 ('.' is missing), line ARRAY<STRUCT<x, y>>, row_idx.

    Each pair of numbers (1, 2) and (3, 4) spans its street. The numbers between lie at fractions i / n of the line, i from
    0 to n - 1 for n of them, from the smaller to the larger: the first on its start, none on its end. The pair
    itself lies on start and end as given; on a closed line both lie on its centroid. Later streets and pairs replace earlier ones, ends
    replace what is between. Streets without a line give nothing. legacy_pad: a missing number is the previous street's.
    reproject: lines are in the Berlin Soldner system and become longitude and latitude first.
    """
    numbers = ["num_1", "num_2", "num_3", "num_4"]
    known = streets.withColumns({c: F.nullif(F.col(c), F.lit(".")) for c in numbers})
    if legacy_pad:
        known = forward_fill(known, numbers, ["row_idx"])
    if reproject:
        known = known.withColumn("line", line_to_wgs84(F.col("line")))
    pairs = F.array(*(F.struct(F.lit(k).alias("pair"), F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")) for k, (a, b) in enumerate((("num_1", "num_2"), ("num_3", "num_4")))))
    rows = known.filter(F.size("line") > 0).select("row_idx", "name", "line", F.explode(pairs).alias("p")).filter("p.a is not null and p.b is not null").select("row_idx", "name", "line", "p.*")
    line, low, high = F.col("line"), F.least("a", "b"), F.greatest("a", "b")
    n = high - low - 1
    between = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit(0).alias("kind"), (low + 1 + i).alias("number"), along(line, i / n).alias("at"))))
    closed = line[0] == line[F.size(line) - 1]
    end = lambda kind, number, p: F.struct(F.lit(kind).alias("kind"), F.col(number).alias("number"), F.when(closed, line_centroid(line)).otherwise(xy(p["x"], p["y"])).alias("at"))
    ends = F.array(end(1, "a", line[0]), end(2, "b", line[F.size(line) - 1]))
    every = rows.select("row_idx", "pair", "name", F.explode(F.concat(F.coalesce(between, F.slice(ends, 1, 0)), ends)).alias("e"))
    points = every.select("row_idx", "pair", "e.kind", F.concat_ws(" ", F.coalesce("name", F.lit("None")), F.col("e.number").cast("string")).alias("address"), "e.at.x", "e.at.y")
    return last_of(points, "address", "row_idx", "pair", "kind")


def lot_addresses(lots: DataFrame, reproject: bool = False) -> DataFrame:
    """(address, x, y) of lots: adress1..adress3, ring ARRAY<STRUCT<x, y>> (one point: itself), row_idx. The last lot of an address counts, the third column over the second over the first.

    reproject: rings are in the Berlin Soldner system and become longitude and latitude first; centroids are those of the result.
    """
    ring = line_to_wgs84(F.col("ring")) if reproject else F.col("ring")
    named = lots.withColumn("__c", centroid(ring)).select("row_idx", "__c.x", "__c.y", "adress1", "adress2", "adress3")
    long = named.unpivot(["row_idx", "x", "y"], ["adress1", "adress2", "adress3"], "field", "address").filter("address is not null")
    return last_of(long, "address", "field", "row_idx")


def geocode_online(addresses: DataFrame, key: str, client: Callable[[str], tuple[float, float] | None], lead: str = "", trail: str = "", attempts: int = 3, metrics: Observation | None = None) -> DataFrame:
    """Rows with x and y of a geocoding service's answer to the address between lead and trail; NULL without one. client: question -> (x, y) or None.

    metrics: see external_lookup; filled when this returns.
    """
    return looked_up(addresses, key, lambda k: F.concat(F.lit(lead), k, F.lit(trail)), client, "x double, y double", attempts, metrics)


def geocode(addresses: DataFrame, key: str, table: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Rows with x and y of their address's best match; NULL without one."""
    found = best_matches(addresses, key, table, "address", cutoff).join(table.withColumnRenamed("address", "match"), "match").select(F.col("query").alias("__query"), "x", "y")
    return addresses.join(found, F.col(key) == F.col("__query"), "left").drop("__query")
