"""Reshaping and merging of tables: recodes, appends, long and wide, merges with their outcome."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import bucketed, saved_path

#: Tract ids that stand for parts of another, for population and directory tables, and for tax tables.
POPULATION_RECODE = {1161: 116, 1621: 162, 1622: 162, 1841: 184, 1842: 184, 1111: 111, 1112: 111}
TAX_RECODE = {721: 72, 722: 72, 761: 76, 762: 76, 1111: 111, 1112: 111, 1841: 184, 1842: 184}


def recode(df: DataFrame, column: str, table: Mapping) -> DataFrame:
    """Replace values by a table; others stay."""
    return df.replace(dict(table), subset=[column])


def destring(column: str) -> Column:
    """A whole number, NULL where the text is none."""
    return F.expr(f"try_cast(`{column}` as int)")


def collapse_sum(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums by key, missing as 0."""
    return df.groupBy(*keys).agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values))


def append(*tables: DataFrame) -> DataFrame:
    """All rows, columns by name; what a table lacks is NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, failing when a key comes twice."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").limit(1)
    if not counts.isEmpty():
        raise ValueError(f"{list(keys)} does not identify the rows")
    return df


def merge(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = False, match_nulls: bool = False, indicator: str = "merge") -> DataFrame:
    """One-to-one full outer merge. indicator: 1 left only, 2 right only, 3 both. The left values win in columns of both.

    Missing keys match nothing unless match_nulls. check raises where a key comes twice on a side.
    """
    if check:
        unique(left, keys)
        unique(right, keys)
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns), F.lit(True).alias("l__"))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), F.lit(True).alias("r__"))
    on = F.lit(True)
    for k in keys:
        x, y = F.col(f"l_{k}"), F.col(f"r_{k}")
        on = on & (x.eqNullSafe(y) if match_nulls else x == y)
    both = a.join(b, on, "full_outer")
    shown = [F.coalesce(f"l_{c}", f"r_{c}").alias(c) if c in keys else F.when(F.col("l__"), F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(c) if c in left.columns and c in right.columns else F.col(f"l_{c}" if c in left.columns else f"r_{c}").alias(c) for c in dict.fromkeys([*left.columns, *right.columns])]
    return both.select(*shown, F.when(F.col("l__").isNull(), 2).when(F.col("r__").isNull(), 1).otherwise(3).alias(indicator))


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = False) -> DataFrame:
    """Rows whose keys both tables have, with the columns of both, the left one's values where both have a column; missing keys match nothing. check: keys must be unique on both sides."""
    if check:
        for side in (left, right):
            if not side.groupBy(*keys).count().filter("count > 1").isEmpty():
                raise ValueError(f"keys {list(keys)} are not unique")
    return left.join(right.drop(*(c for c in right.columns if c in left.columns and c not in keys)), list(keys))


def longer(df: DataFrame, keys: Sequence[str], stubs: Sequence[str], suffixes: Sequence, name: str) -> DataFrame:
    """Families of columns stub+suffix as rows: keys, name (the suffix), one column per stub. Missing members are NULL."""
    def member(s: str, x: object) -> Column:
        return (F.col(f"{s}{x}") if f"{s}{x}" in df.columns else F.lit(None)).alias(s)

    rows = F.array(*(F.struct(F.lit(x).alias(name), *(member(s, x) for s in stubs)) for x in suffixes))
    return df.select(*keys, F.explode(rows).alias("__r")).select(*keys, "__r.*")


def wider(df: DataFrame, keys: Sequence[str], name: str, value: str, suffixes: Sequence, stub: str | None = None) -> DataFrame:
    """Rows as columns stub+suffix; the suffixes are given, so the data aren't read for them."""
    stub = value if stub is None else stub
    out = df.groupBy(*keys).pivot(name, list(suffixes)).agg(F.first(value, ignorenulls=True))
    return out.select(*keys, *(F.col(f"`{x}`").alias(f"{stub}{x}") for x in suffixes))


def cascade(tables: Mapping[str, DataFrame], keys: Sequence[str], value: str, buckets: int = 8) -> DataFrame:
    """keys and one column per table (its name; its column ``value``), for every combination of keys that any table has.

    Each table, of unique keys, is written once, bucketed and sorted by the keys, and so are all keys; the joins then run bucket by bucket without a shuffle, however many tables
    there are. Rows with a missing key have no place. buckets: as many as give buckets of some 100 MB.
    """
    run = uuid.uuid4().hex[:12]
    names = {n: f"cascade_{run}_{i}" for i, n in enumerate(tables)}
    saved = [bucketed(df.select(*keys, F.col(value).alias(n)).na.drop(subset=list(keys)), names[n], keys, buckets) for n, df in tables.items()]
    # Their keys are read as plain files, so that rows of one key meet whatever the buckets say of a union.
    plain = (df.sparkSession.read.schema(df.schema).parquet(saved_path(df.sparkSession, n)).select(*keys) for n, df in zip(names.values(), saved, strict=True))
    out = bucketed(reduce(DataFrame.union, plain).distinct(), f"cascade_{run}_keys", keys, buckets)
    for df in saved:
        out = out.join(df.hint("merge"), list(keys), "left")
    return out


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(copies, observations, surplus): how many rows have keys that come so often."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).groupBy("copies").agg((F.count("*") * F.col("copies")).alias("observations"), (F.count("*") * (F.col("copies") - 1)).alias("surplus"))


def top_rows(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """The k largest; rows without a value don't count, ties go to the smaller tie."""
    return df.filter(F.col(by).isNotNull()).orderBy(F.desc(by), tie).limit(k)


def cumulative_by_year(df: DataFrame, year: str) -> DataFrame:
    """(year, sum_active): how many rows have come by then."""
    from pyspark.sql import Window

    w = Window.orderBy(year).rowsBetween(Window.unboundedPreceding, 0)  # one row per year
    return df.filter(F.col(year).isNotNull()).groupBy(year).agg(F.count("*").alias("__n")).select(year, F.sum("__n").over(w).alias("sum_active"))


def filled_years(counts: DataFrame, years: DataFrame, year: str, values: Sequence[str]) -> DataFrame:
    """A template of all years with the counts, each year without one taking the last before it."""
    from pyspark.sql import Window

    w = Window.orderBy(year).rowsBetween(Window.unboundedPreceding, 0)  # one row per year
    return years.select(year).join(counts, year, "left").select(year, *(F.last(v, True).over(w).alias(v) for v in values))
