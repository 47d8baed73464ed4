"""Tax brackets, and top shares by generalized Pareto interpolation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the tax tables: lower bounds of the 13 brackets, incomes of the 12 classes, income of the exempt,
# taxed households among people with income tax in the whole city.
LOWER = (420, 660, 900, 1050, 1200, 1350, 1500, 1650, 1800, 2100, 2400, 2700, 3000)
MIDPOINT = (480, 720, 1020, 1170, 1320, 1470, 1620, 1770, 1920, 2220, 2520, 2820)
EXEMPT_INCOME = 150
HOUSEHOLDS, PEOPLE = 25200, 82062
EXEMPT = ("tax_exempt_under_cutoff", "tax_exempt_young", "tax_exempt_military", "tax_exempt_low_income2")


def tax_units(df: DataFrame) -> DataFrame:
    """Households and incomes of the exempt, the class taxed and the income taxed of each tract.

    The exempt live in households of the class taxed's size. What the classes and the exempt don't have of a tract's income is that of the
    income taxed; it is 0 where there are none.
    """
    total = lambda cols: sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    classes = [f"tax_class_{k}" for k in range(1, 13)]
    out = df.withColumns({"people_exempt": total(EXEMPT), "units_class": total(classes), "income": F.col("N_people") * F.col("income")})
    out = out.withColumn("people_class", F.col("N_people") - F.col("N_people_income_tax") - F.col("people_exempt"))
    out = out.withColumn("household", F.try_divide("people_class", "units_class"))
    out = out.withColumns({"units_exempt": F.try_divide("people_exempt", "household"), "units_income": F.col("N_people_income_tax") * (HOUSEHOLDS / PEOPLE)})
    out = out.withColumns({"income_class": sum((F.col(c) * m for c, m in zip(classes, MIDPOINT, strict=True)), F.lit(0.0)), "income_exempt": F.col("units_exempt") * EXEMPT_INCOME})
    rest = F.col("income") - F.col("income_class") - F.col("income_exempt")
    out = out.withColumn("income_tax", F.when(F.col("units_income") == 0, 0.0).otherwise(rest))
    out = out.withColumn("income", F.col("income_tax") + F.col("income_class") + F.col("income_exempt"))
    return out.withColumn("mean_income", F.try_divide("income", F.col("units_exempt") + F.col("units_class") + F.col("units_income")))


def bracket_rows(units: DataFrame, key: str = "id") -> DataFrame:
    """(key, bracket, n, lower, wealth, mean): the 13 brackets of each tract, the first with the exempt, the last with the income taxed."""
    def n(k: int):  # noqa: ANN202
        return F.col("units_income") if k == 13 else F.col(f"tax_class_{k}")

    def wealth(k: int):  # noqa: ANN202
        return F.col("income_tax") if k == 13 else F.col(f"tax_class_{k}") * MIDPOINT[k - 1]

    rows = F.array(*(F.struct(F.lit(k).alias("bracket"), n(k).cast("double").alias("n"), F.lit(float(LOWER[k - 1])).alias("lower"), wealth(k).cast("double").alias("wealth")) for k in range(1, 14)))
    return units.select(key, "mean_income", F.explode(rows).alias("b")).select(key, "b.*", F.col("mean_income").alias("mean"))


def positions(rows: DataFrame, key: str = "id", total: str | None = None) -> DataFrame:
    """Adds average and p, the share of a key's units below each bracket; brackets without units are dropped.

    total: a column with the key's number of units, where more of them lie below the first bracket.
    """
    up = Window.partitionBy(key).orderBy(F.desc("bracket"))
    whole = F.col(total) if total else F.sum("n").over(Window.partitionBy(key))
    above = F.sum(F.coalesce("n", F.lit(0.0))).over(up.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("p", 1 - F.try_divide(above, whole)).withColumn("average", F.try_divide("wealth", "n")).filter("average is not null")


def consistent(rows: DataFrame, key: str = "id", fail: bool = False) -> DataFrame:
    """Adds error: 0 where lower < average < the next bracket's lower bound; above the last there is none. fail raises at the first 1."""
    following = F.lead("lower").over(Window.partitionBy(key).orderBy("bracket"))
    good = (F.col("average") > F.col("lower")) & (following.isNull() | (F.col("average") < following))
    out = rows.withColumn("error", F.when(good, 0).otherwise(1))
    if fail:
        out = out.filter(F.when(F.col("error") == 1, F.raise_error(F.lit("the bounds and averages of the brackets are inconsistent")).cast("boolean")).otherwise(True))
    return out


class Interpolation:
    """A distribution through brackets, by generalized Pareto curves.

    With x = -ln(1 - p) and phi(x) = -ln(integral of the quantile function over (p, 1)), phi's values follow from the
    brackets' averages and its slopes from their bounds (slope = 1 / inverted Pareto coefficient). Between brackets phi is a quintic with
    these values and slopes; its second derivatives make the third ones continuous. Above the last bound a generalized Pareto tail
    goes on with the same value, slope and second derivative.
    """

    def __init__(self, p: Sequence[float], lower: Sequence[float], average: Sequence[float], mean: float) -> None:
        p, lower, average = (np.asarray(v, float) for v in (p, lower, average))
        share = np.diff(np.append(p, 1.0))
        self.above = np.cumsum((share * average)[::-1])[::-1]
        below = mean - self.above[0]
        if p[0] > 0:  # the rest, with the average it is left
            p, lower, self.above = np.append(0.0, p), np.append(0.0, lower), np.append(self.above[0] + max(below, 0.0), self.above)
        self.mean, self.p = float(self.above[0]), p
        self.x = -np.log1p(-p)
        self.y = -np.log(self.above)
        self.s = (1 - p) * lower / self.above
        self.a = self.curvature()

    def curvature(self) -> np.ndarray:
        n = len(self.x)
        if n < 2:
            return np.zeros(n)
        h = np.diff(self.x)
        m, r = np.zeros((n, n)), np.zeros(n)
        for k in range(n):
            for i, right in ((k - 1, True), (k, False)):
                if not 0 <= i < n - 1:
                    continue
                d = (self.y[i + 1] - self.y[i]) / h[i] ** 2
                # third derivative of the quintic at its end (right) or start, in terms of both curvatures
                if right:
                    m[k, i] += -3 / h[i]
                    m[k, i + 1] += 9 / h[i]
                    r[k] -= (60 * d - (24 * self.s[i] + 36 * self.s[i + 1]) / h[i]) / h[i]
                else:
                    m[k, i] += 9 / h[i]
                    m[k, i + 1] += -3 / h[i]
                    r[k] += (60 * d - (36 * self.s[i] + 24 * self.s[i + 1]) / h[i]) / h[i]
        return np.linalg.lstsq(m, r, rcond=None)[0]

    def phi(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phi and its derivative."""
        x = np.asarray(x, float)
        k = np.clip(np.searchsorted(self.x, x, "right") - 1, 0, len(self.x) - 1)
        value, slope = np.empty_like(x), np.empty_like(x)
        for i in range(len(self.x)):
            own = k == i
            if not own.any():
                continue
            if i == len(self.x) - 1:
                value[own], slope[own] = self.tail(x[own] - self.x[i])
                continue
            h = self.x[i + 1] - self.x[i]
            t = (x[own] - self.x[i]) / h
            y0, y1, s0, s1, a0, a1 = self.y[i], self.y[i + 1], self.s[i] * h, self.s[i + 1] * h, self.a[i] * h * h, self.a[i + 1] * h * h
            c3 = 10 * (y1 - y0) - 6 * s0 - 4 * s1 - 1.5 * a0 + 0.5 * a1
            c4 = -15 * (y1 - y0) + 8 * s0 + 7 * s1 + 1.5 * a0 - a1
            c5 = 6 * (y1 - y0) - 3 * s0 - 3 * s1 - 0.5 * a0 + 0.5 * a1
            value[own] = y0 + t * (s0 + t * (a0 / 2 + t * (c3 + t * (c4 + t * c5))))
            slope[own] = (s0 + t * (a0 + t * (3 * c3 + t * (4 * c4 + t * 5 * c5)))) / h
        return value, slope

    def tail(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Above the last bound: quantiles m + s ((1 - p) / (1 - p_k))^-xi, with the bracket's bound and average; xi from the slope and curvature."""
        y, s, a = self.y[-1], self.s[-1], self.a[-1]
        left, bound = math.exp(-self.x[-1]), s * math.exp(self.x[-1] - self.y[-1])
        average = math.exp(-y) / left
        if average <= bound:
            return y + d, np.ones_like(d)
        # d/dx of the quantile at the bound: (a - s (s - 1)) times the mean above it
        rise = (a - s * (s - 1)) * average
        xi = min(max(1 - rise / (average - bound), 0.01), 0.99) if rise > 0 else 0.5
        scale = (average - bound) * (1 - xi)  # GPD with the mean excess average - bound
        u = np.exp(-d)
        total = left * (u * bound + scale / xi * (u ** (1 - xi) / (1 - xi) - u))
        quantile = bound + scale / xi * (u**-xi - 1)
        return -np.log(total), left * u * quantile / total

    def top_share(self, p: np.ndarray) -> np.ndarray:
        return np.exp(-self.phi(-np.log1p(-np.asarray(p, float)))[0]) / self.mean

    def threshold(self, p: np.ndarray) -> np.ndarray:
        x = -np.log1p(-np.asarray(p, float))
        value, slope = self.phi(x)
        return slope * np.exp(x - value)


def fractiles() -> np.ndarray:
    """127 places: each percent, then tenths, hundredths and thousandths of the last one."""
    parts = [np.arange(100) / 100, 0.99 + np.arange(1, 10) / 1e3, 0.999 + np.arange(1, 10) / 1e4, 0.9999 + np.arange(1, 10) / 1e5]
    return np.round(np.concatenate(parts), 5)


TABULATION = "p double, threshold double, top_share double, bottom_share double, bracket_share double, top_average double, bottom_average double, bracket_average double, invpareto double"


def tabulation(p: Sequence[float], lower: Sequence[float], average: Sequence[float], mean: float) -> pd.DataFrame:
    """Threshold, shares, averages and inverted Pareto coefficient at each of the fractiles."""
    d, q = Interpolation(p, lower, average, mean), fractiles()
    top, threshold = d.top_share(q), d.threshold(q)
    width, share = np.diff(np.append(q, 1.0)), -np.diff(np.append(top, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return pd.DataFrame({
            "p": q, "threshold": threshold, "top_share": top, "bottom_share": 1 - top, "bracket_share": share,
            "top_average": top * d.mean / (1 - q), "bottom_average": np.where(q > 0, (1 - top) * d.mean / q, np.nan),
            "bracket_average": share * d.mean / width, "invpareto": np.where(threshold > 0, top * d.mean / (1 - q) / threshold, np.nan),
        })


def interpolate(rows: DataFrame, key: str = "id") -> DataFrame:
    """The tabulation of each key's brackets (at most 13 rows a key): p, lower, average and the key's mean."""
    kind = rows.schema[key].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bracket")
        out = tabulation(pdf["p"], pdf["lower"], pdf["average"], float(pdf["mean"].iloc[0]))
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return rows.select(key, "bracket", "p", "lower", "average", "mean").groupBy(key).applyInPandas(fit, f"{key} {kind}, {TABULATION}")


def wide_top_shares(table: DataFrame, key: str = "id") -> DataFrame:
    """top_share30 .. top_share99 as columns."""
    from .reshape import wider

    rows = table.filter("p > 0.29 and p <= 0.99").withColumn("q", F.round(F.col("p") * 100).cast("int"))
    return wider(rows, [key], "q", "top_share", list(range(30, 100)))
