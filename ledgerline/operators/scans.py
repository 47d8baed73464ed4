"""Ordered work over groups of any size: running sums, ranks, medians, forward fills and runs without one task per group.

Rows go to range partitions by group and order. Each partition works on its own stretch of a group; one summary row per partition and group
in it is carried on to the following ones. So a group that holds all rows uses all partitions, and what meets in one task is a row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

FIRST, NOW = Window.unboundedPreceding, Window.currentRow


def group(keys: Sequence[str]) -> Column:
    """The keys as one value, in which nulls are equal."""
    return F.struct(*keys) if keys else F.lit(0)


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """df in range partitions, with __group (the group) and __part (the partition). Only good for one evaluation: stage what comes of it."""
    return df.withColumn("__group", group(keys)).repartitionByRange("__group", *order).withColumn("__part", F.spark_partition_id())


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], **sums: Column) -> DataFrame:
    """df with before_<name> (the sum over the group's earlier rows, 0 for the first) and total_<name> (over the group) for each of sums.

    Missing values count 0. Rows of equal order come in any order.
    """
    local = Window.partitionBy("__part", "__group").orderBy(*order).rowsBetween(FIRST, -1)
    parts = ranged(df, keys, order).withColumns({f"__scan_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    parts = staged(parts.withColumns({f"__in_{n}": F.sum(f"__scan_{n}").over(local) for n in sums}))
    stretches = parts.groupBy("__group", "__part").agg(*(F.sum(f"__scan_{n}").alias(f"__scan_{n}") for n in sums))
    earlier, whole = Window.partitionBy("__group").orderBy("__part").rowsBetween(FIRST, -1), Window.partitionBy("__group")
    carried = stretches.select("__group", "__part", *(F.sum(f"__scan_{n}").over(earlier).alias(f"__at_{n}") for n in sums), *(F.sum(f"__scan_{n}").over(whole).alias(f"total_{n}") for n in sums))
    joined = parts.drop(*(f"__scan_{n}" for n in sums)).join(carried, ["__group", "__part"])
    filled = {f"before_{n}": F.coalesce(f"__in_{n}", F.lit(0)) + F.coalesce(f"__at_{n}", F.lit(0)) for n in sums}
    return joined.withColumns(filled).select(*df.columns, *filled, *(f"total_{n}" for n in sums))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "n") -> DataFrame:
    """df with each row's number in its group (from 1), and total_<name>, the group's number of rows."""
    counted = prefix_sums(df, keys, order, **{name: F.lit(1).cast("long")})
    return counted.withColumn(name, F.col(f"before_{name}") + 1).select(*(c for c in df.columns if c != name), name, f"total_{name}")


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """keys and the exact median of each group's non-missing values, by lookup of the middle positions among distinct values with their counts."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    placed = prefix_sums(counts, keys, ["__v"], n=F.col("__c"))
    holds = lambda p: (F.col("before_n") < p) & (p <= F.col("before_n") + F.col("__c"))
    middle = [F.max(F.when(holds(F.floor((F.col("total_n") + d) / 2)), F.col("__v"))) for d in (1, 2)]
    return placed.groupBy(*keys).agg((middle[0] / 2 + middle[1] / 2).alias(name))


def forward_fill(df: DataFrame, values: Sequence[str], order: Sequence[str], default: object = None) -> DataFrame:
    """df with each NULL of the values replaced by the last one before it in the order of all rows; before the first by default."""
    local = Window.partitionBy("__part").orderBy(*order).rowsBetween(FIRST, NOW)
    filled = {f"__{v}": F.last(v, True).over(local) for v in values}
    parts = staged(ranged(df, [], order).withColumns(filled).drop("__group"))
    last = parts.groupBy("__part").agg(*(F.max_by(F.struct(f"__{v}"), F.struct(*order))[f"__{v}"].alias(f"__{v}") for v in values))
    carried = last.select("__part", *(F.last(f"__{v}", True).over(Window.orderBy("__part").rowsBetween(FIRST, -1)).alias(f"__at_{v}") for v in values))
    rest = [] if default is None else [F.lit(default)]
    joined = parts.join(F.broadcast(carried), "__part")  # one row a partition
    return joined.withColumns({v: F.coalesce(f"__{v}", f"__at_{v}", *rest) for v in values}).select(*df.columns)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, last: bool = False) -> DataFrame:
    """(keys, run, label, n): stretches of equal labels in each group's order, numbered from 1, with their number of rows.

    A run that nothing ends, the group's last, is left out unless ``last``. NULL labels are equal. Partitions first
    make runs of their own. Only groups that go over several partitions, fewer than there are of these, need more: their stretches'
    first and last runs say how many came before and which are to be merged. All other runs stay where they are.
    """
    local = Window.partitionBy("__part", "__group").orderBy(*order)
    same = F.lag(F.struct(label)).over(local).eqNullSafe(F.struct(label))
    marked = ranged(df.select(*dict.fromkeys([*keys, *order, label])), keys, order).withColumn("__new", F.when(same, 0).otherwise(1))
    marked = marked.withColumn("__i", F.sum("__new").over(local.rowsBetween(FIRST, NOW)))
    pieces = marked.groupBy("__part", "__group", "__i").agg(F.first(F.struct(F.col(label).alias("label"))).alias("__l"), F.count("*").alias("n"))
    pieces = staged(pieces.withColumn("__m", F.max("__i").over(Window.partitionBy("__part", "__group"))))
    # Partitions are ranges, so a group that goes over several is the first or last one of each: two rows a partition, hence the broadcasts.
    bounds = pieces.groupBy("__part").agg(F.min("__group").alias("lo"), F.max("__group").alias("hi"))
    wide = bounds.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("__group")).groupBy("__group").agg(F.count("*").alias("c")).filter("c > 1").select("__group")
    ends = pieces.filter("__i = 1 or __i = __m").join(F.broadcast(wide), "__group").groupBy("__group", "__part")
    ends = ends.agg(F.min_by("__l", "__i").alias("__first"), F.max_by("__l", "__i").alias("__last"), F.max("__m").alias("__m"))
    over = Window.partitionBy("__group").orderBy("__part")
    linked = ends.withColumn("__on", F.when(F.lag("__last").over(over) == F.col("__first"), 1).otherwise(0)).withColumn("__m", F.col("__m") - F.col("__on"))
    shift = F.coalesce(F.sum("__m").over(over.rowsBetween(FIRST, -1)), F.lit(0)) - F.col("__on")
    shifts = linked.select("__group", "__part", shift.alias("__shift"), F.sum("__m").over(Window.partitionBy("__group")).alias("__runs"))
    numbered = pieces.join(F.broadcast(shifts), ["__group", "__part"], "left").withColumn("run", F.col("__i") + F.coalesce("__shift", F.lit(0)))
    kept = numbered if last else numbered.filter(F.col("run") < F.coalesce("__runs", "__m"))
    edge = F.col("__shift").isNotNull() & F.col("__i").isin(1, F.col("__m"))
    merged = kept.filter(edge).groupBy("__group", "run").agg(F.first("__l").alias("__l"), F.sum("n").alias("n"))
    merged = kept.filter(~edge).select("__group", "run", "__l", "n").union(merged)
    return merged.select(*(F.col(f"__group.{k}").alias(k) for k in keys), F.col("run").cast("int").alias("run"), F.col("__l.label").alias("label"), "n")
