"""From structured lines to the referenced table, and from it to tract statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import spearman, top_shares
from ..functions.text import address
from ..operators.geo import geocode
from ..operators.labels import Crf, occupations, parse_entries
from ..operators.lines import structured
from ..operators.match import via_distinct, within_first
from ..operators.reshape import cascade
from ..operators.status import coded, scored


def occupation_table(lines: DataFrame, model: Crf, streets: DataFrame | None = None, fixes: DataFrame | None = None, **settings: object) -> DataFrame:
    """Structure, label and flatten; empty street, number and occupation are ''. settings: further arguments of structured()."""
    entries = parse_entries(structured(lines, streets, fixes, **settings), model)
    return occupations(entries, sanitized=True).na.fill("", ["street", "number", "occupation"]).withColumn("address", address("street", "number"))


def summary(lines: DataFrame) -> DataFrame:
    """(page_idx, columns, lines, streets, numbered): what a page holds, by kind of line."""
    kind = lambda k: F.count_if(F.col("linetype") == k)
    return lines.groupBy("page_idx").agg(F.count_distinct("col_idx").alias("columns"), F.count("*").alias("lines"), kind("STREETNAME").alias("streets"), kind("ENTRY_WITH_STREETNUMBER").alias("numbered"))


def headings(lines: DataFrame) -> DataFrame:
    """All street headings, in order."""
    return lines.filter("linetype = 'STREETNAME'").select("page_idx", "col_idx", "line_idx", "street").orderBy("page_idx", "col_idx", "line_idx")


def referenced(rows: DataFrame, places: Sequence[DataFrame], references: Sequence[DataFrame], scores: DataFrame, tracts: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Adds x_i, y_i, sb_i per table of addresses and hisco_i, hiscam_i per occupation list. Each lookup runs on distinct keys."""
    out = rows
    for i, place in enumerate(places, 1):
        found = via_distinct(rows.select("address"), "address", lambda keys, place=place: geocode(keys, "address", place)).distinct()
        zoned = within_first(found, tracts, "x", "y").select("address", F.col("x").alias(f"x_{i}"), F.col("y").alias(f"y_{i}"), F.col("zone").alias(f"sb_{i}"))
        out = out.join(zoned, "address", "left")
    for i, reference in enumerate(references, 1):
        codes = scored(coded(rows.select("occupation").distinct(), reference, f"hisco_{i}", cutoff), scores, f"hisco_{i}", f"hiscam_{i}")
        out = out.join(codes, "occupation", "left")
    return out


def long_form(table: DataFrame, methods: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(geo_m, status_m, id, hiscam): every combination of place and status method as rows."""
    pairs = F.array(*(F.struct(F.lit(g).alias("geo_m"), F.lit(s).alias("status_m"), F.expr(f"try_cast(sb_{g} as int)").alias("id"), F.col(f"hiscam_{s}").alias("hiscam")) for g in methods for s in methods))
    return table.select(F.explode(pairs).alias("r")).select("r.*")


def tract_statistics(long: DataFrame) -> DataFrame:
    return long.groupBy("geo_m", "status_m", "id").agg(F.count("hiscam").alias("n"), F.avg("hiscam").alias("mean"))


def tract_top_shares(long: DataFrame, stata_float: bool = False) -> DataFrame:
    rows = long.filter("id is not null").withColumn("__k", F.struct("geo_m", "status_m", "id"))
    return top_shares(rows, "__k", "hiscam", float32=stata_float).select("__k.*", "q", "share")


def share_panel(shares: DataFrame, methods: Sequence[int] = (1, 2, 3), buckets: int = 8) -> DataFrame:
    """(id, q) and hiscam_share_{geo}_{status} for every pair of methods, from tract_top_shares: nine tables joined without a shuffle."""
    tables = {f"hiscam_share_{g}_{s}": shares.filter((F.col("geo_m") == g) & (F.col("status_m") == s)) for g in methods for s in methods}
    return cascade(tables, ["id", "q"], "share", buckets)


def validation(shares: DataFrame, official: DataFrame) -> DataFrame:
    """Rank correlation of estimated with official top shares (id, q, top_share) over tracts, by methods and q."""
    both = shares.join(official, ["id", "q"])
    return spearman(both, "share", "top_share", ["geo_m", "status_m", "q"])
