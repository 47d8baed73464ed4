"""Statistics over groups as DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Non-missing count and mean of each group; a missing key is a group."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def sum_or_zero(value: Column | str) -> Column:
    """A sum in which missing values are 0, also where all are."""
    return F.coalesce(F.sum(value), F.lit(0))


def total_if(value: Column | str, condition: Column) -> Column:
    """The sum over the rows of a group that meet the condition; 0 where none does or all are missing."""
    return sum_or_zero(F.when(condition, F.col(value) if isinstance(value, str) else value))


def row_total(*values: str) -> Column:
    """Sum across columns, missing as 0."""
    out = F.lit(0)
    for v in values:
        out = out + F.coalesce(F.col(v), F.lit(0))
    return out


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), name: str = "rho") -> DataFrame:
    """Rank correlation over complete pairs; tied values have their mean rank. One row per group.

    Ranks come from running counts of the distinct values over range partitions: rows are aggregated before anything is ordered, and
    no group is one task.
    """
    from ..operators.scans import prefix_sums

    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("__a"), F.col(b).alias("__b"))

    def ranks(c: str) -> DataFrame:
        counts = both.groupBy(*keys, c).agg(F.count("*").alias("__n"))
        placed = prefix_sums(counts, keys, [c], n=F.col("__n"))
        return placed.select(*(F.col(k).alias(f"{c}_{k}") for k in keys), F.col(c).alias(f"{c}_v"), (F.col("before_n") + (F.col("__n") + 1) / 2).alias(f"{c}_rank"))

    def joined(rows: DataFrame, c: str) -> DataFrame:
        on = F.col(c) == F.col(f"{c}_v")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{c}_{k}"))
        return rows.join(ranks(c), on).drop(f"{c}_v", *(f"{c}_{k}" for k in keys))

    ranked = joined(joined(both.groupBy(*keys, "__a", "__b").agg(F.count("*").alias("__w")), "__a"), "__b")
    x, y, w = F.col("__a_rank"), F.col("__b_rank"), F.col("__w")
    sums = ranked.groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"))
    return sums.select(*keys, F.expr("try_divide(n * xy - x * y, sqrt((n * xx - x * x) * (n * yy - y * y)))").alias(name))


def ols(df: DataFrame, y: Column, x: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept of y on x."""
    rows = df.select(*keys, y.alias("__y"), x.alias("__x"))
    return rows.groupBy(*keys).agg(F.regr_slope("__y", "__x").alias("slope"), F.regr_intercept("__y", "__x").alias("intercept"))


def fitted(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """The points with the line through them, as a figure needs them: keys, x, y, fit."""
    line = ols(df, F.col(y), F.col(x), keys).select(*(F.col(k).alias(f"__{k}") for k in keys), "slope", "intercept")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = df.join(line, on) if keys else df.join(F.broadcast(line))  # one row without keys
    return both.select(*keys, x, y, (F.col("intercept") + F.col("slope") * F.col(x)).alias("fit"))


def borders(first: int, last: int, step: int, float32: bool) -> list[tuple[int, float]]:
    """(q, least position share that counts as at or above q %)."""
    out = []
    for q in range(first, last + 1, step):
        at = q / 100
        if float32:  # what rounds to the first single-precision number that isn't below
            f = np.float32(at)
            f = f if float(f) >= at else np.nextafter(f, np.float32(2))
            at = (float(f) + float(np.nextafter(f, np.float32(0)))) / 2
        out.append((q, at))
    return out


def top_shares(df: DataFrame, key: str, value: str, first: int = 30, last: int = 99, step: int = 1, least: int = 100, float32: bool = False) -> DataFrame:
    """(key, q, share): what part of a group's total the rows at or above position q % hold, rows in ascending order.

    Groups of ``least`` non-missing values or fewer have NULL shares. float32 compares positions in single
    precision, as a storage type of 32 bits does: for some q the row exactly on the border then falls below it.
    Each distinct value is one row with its range of positions (running sums over range partitions); it looks only at the few q
    whose borders can fall into that range.
    """
    from ..operators.scans import prefix_sums

    rows = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__c"))
    sums = prefix_sums(rows, [key], [value], n=F.col("__c"), s=F.col(value) * F.col("__c"))
    n, pos = F.col("total_n"), F.col("before_n")
    table = F.array(*(F.lit(at) for _, at in borders(first, last, step, float32)))

    def start(at: Column) -> Column:
        """The first position whose share of all is at least ``at``."""
        low = F.ceil(at * n) - 1
        return F.when((low > 0) & (low / n >= at), low).when((low + 1) / n >= at, low + 1).otherwise(low + 2)

    # Borders lie within a position of q n / 100, so only indexes from one below to one above the row's own range can meet it.
    index = lambda p: (p * 100.0 / n - first) / step
    low, high = F.greatest(F.floor(index(pos - 1)) - 1, F.lit(0)), F.least(F.ceil(index(pos + F.col("__c") + 1)) + 1, F.lit((last - first) // step))
    near = sums.withColumn("__low", low).withColumn("__high", high).filter("__low <= __high").withColumn("__i", F.explode(F.sequence("__low", "__high")))
    met = near.withColumn("__start", start(F.get(table, F.col("__i").cast("int")))).filter(F.col("__start").between(pos + 1, pos + F.col("__c")))
    top = F.col("total_s") - F.col("before_s") - F.col(value) * (F.col("__start") - pos - 1)
    return met.select(key, (F.col("__i") * step + first).cast("int").alias("q"), F.when(n > least, F.try_divide(top, F.col("total_s"))).alias("share"))


def precision_recall(pairs: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per label: support, precision, recall and F1 over (gold, predicted) rows; labels sorted without their first letter first."""
    counts = pairs.groupBy(gold, predicted).agg(F.count("*").alias("n"))
    right = counts.filter(F.col(gold) == F.col(predicted)).select(F.col(gold).alias("label"), F.col("n").alias("hit"))
    support = counts.groupBy(F.col(gold).alias("label")).agg(F.sum("n").alias("support"))
    given = counts.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("given"))
    rows = support.join(given, "label", "full").join(right, "label", "left").fillna(0)
    scored = rows.withColumn("precision", F.coalesce(F.try_divide("hit", "given"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("hit", "support"), F.lit(0.0)))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return scored.select("label", "support", "precision", "recall", f1.alias("f1")).orderBy(F.substring("label", 2, 1000), F.substring("label", 1, 1))


def weighted_f1(report: DataFrame, leave_out: Sequence[str] = ()) -> DataFrame:
    kept = report.filter(~F.col("label").isin(list(leave_out))) if leave_out else report
    return kept.agg(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1"))
