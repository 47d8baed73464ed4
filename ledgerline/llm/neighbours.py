"""Approximate nearest neighbours by multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

OUT = "query_id long, vec_id long, score double"


@dataclass
class Plan:
    """Hash functions and what they were fitted to; bounded by tables * functions * dimension numbers."""

    a: np.ndarray  # tables, functions, dimension + 1
    b: np.ndarray  # tables, functions
    largest: float  # norm
    near: float  # distance at which a wanted neighbour lies


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """One more component makes all norms equal, so that the largest inner product is the least distance."""
    rest = np.sqrt(np.maximum(largest**2 - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def fit(sample: np.ndarray, n: int, largest: float, k: int, tables: int, functions: int, width: float, seed: int = 5) -> Plan:
    """Hash functions h(x) = floor(a x + b) with normal a of spread 1 / (width * largest / 2).

    The distance of the k-th of n neighbours is carried on from the sample by the normal law of its inner products.
    """
    r = np.random.default_rng(seed)
    scale = 2.0 / (width * largest)
    a, b = r.standard_normal((tables, functions, sample.shape[1] + 1)) * scale, r.random((tables, functions))
    some = sample[: min(len(sample), 256)]
    products = some @ sample.T
    z = NormalDist().inv_cdf(1 - min(0.5, k / max(n, 1)))
    kth = float((products.mean(axis=1) + z * products.std(axis=1)).mean())
    near = math.sqrt(max(float(largest**2 + (some * some).sum(axis=1).mean()) - 2 * kth, 1e-12))
    return Plan(a, b, largest, near)


_GRID = np.linspace(-8, 8, 16001)
_PHI = np.array([NormalDist().cdf(x) for x in _GRID])


def phi(x: np.ndarray) -> np.ndarray:
    return _PHI[np.clip((x + 8) * 1000, 0, 16000).astype(np.int32)]


def candidates(queries: np.ndarray, rows: np.ndarray, plan: Plan, mass: float, reach: int = 4) -> np.ndarray:
    """Which rows the queries meet in any table.

    In each table the buckets are visited in the order of their estimated success, the chance that a
    neighbour at distance plan.near falls in them: the product over functions of normal probabilities of the bucket's interval
    around the query's projection. Visits end when the visited buckets, perturbed ones included, hold ``mass`` of it.
    Where they end is read off 400 fixed normal draws of a neighbour.
    """
    met = np.zeros((len(queries), len(rows)), bool)
    lift_q, lift_r = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1), lifted(rows, plan.largest)
    draws = np.random.default_rng(9).standard_normal((400, plan.a.shape[1]))
    for a, b in zip(plan.a, plan.b, strict=True):
        spread = plan.near * np.sqrt((a * a).mean(axis=1))
        cells, which = np.unique(np.floor(lift_r @ a.T + b).astype(np.int32), axis=0, return_inverse=True)
        which = which.ravel()
        x = lift_q @ a.T + b
        base = np.floor(x).astype(np.int32)
        edge = (base[:, :, None] + np.arange(-reach, reach + 2)) - x[:, :, None]
        logs = np.log(np.maximum(np.diff(phi(edge / spread[:, None]), axis=2), 1e-12)).astype(np.float32)
        # The log chances of all cells are one product with their one-hot form.
        low = cells.min(axis=0)
        values = [np.arange(lo, hi + 1) for lo, hi in zip(low, cells.max(axis=0), strict=True)]
        start = np.cumsum([0, *map(len, values)])
        hot = np.zeros((start[-1], len(cells)), np.float32)
        for j, first in enumerate(start[:-1]):
            hot[first + cells[:, j] - low[j], np.arange(len(cells))] = 1
        for k in range(0, len(x), 256):
            part, at = logs[k : k + 256], base[k : k + 256]
            drawn = np.zeros((len(part), len(draws)), np.float32)
            chances = []
            for j, v in enumerate(values):
                fall = np.floor(x[k : k + 256, j, None] + draws[:, j] * spread[j]) - at[:, j, None] + reach
                drawn += np.take_along_axis(part[:, j], np.clip(fall, 0, 2 * reach).astype(np.int64), axis=1)
                chances.append(np.take_along_axis(part[:, j], np.clip(v - at[:, j, None] + reach, 0, 2 * reach), axis=1))
            least = np.partition(drawn, int((1 - mass) * len(draws)), axis=1)[:, int((1 - mass) * len(draws))]
            met[k : k + 256] |= (np.concatenate(chances, axis=1) @ hot >= least[:, None] - 1e-4)[:, which]
    return met


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, plan: Plan, mass: float, k: int) -> list[tuple[int, int, float]]:
    """The k largest exact inner products of each query among its candidates; ties to the smaller id. With mass 1 all buckets are visited."""
    met = candidates(queries, rows, plan, mass) if mass < 1 else np.ones((len(queries), len(rows)), bool)
    rough = queries @ rows.T
    out = []
    for q, name in enumerate(query_ids.tolist()):
        some = np.flatnonzero(met[q] & (ids != name))
        if len(some) > k:
            r = rough[q, some]
            least = np.partition(r, len(r) - k)[len(r) - k]
            some = some[r >= least - 1e-9 * (1 + abs(least))]
        # One row at a time, so equal vectors get equal scores wherever they are.
        score = (rows[some] * queries[q]).sum(axis=1)
        order = np.lexsort((ids[some], -score))[:k]
        out += [(name, int(ids[some[i]]), float(score[i])) for i in order]
    return out


def search(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    tables: int = 8,
    functions: int = 16,
    width: float = 2.0,
    mass: float = 0.24,
    block: int = 65_536,
    least_blocks: int = 16,
    query_block: int = 8192,
    sample: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each query, by largest inner product.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own. Rows
    are dealt by a hash of their id to blocks, and the query set meets all blocks, in blocks itself: a
    task holds one of each, indexes its rows in all tables and reranks what the queries meet by exact
    products. A query that meets fewer than k rows in all blocks together visits all buckets. Copies of a vector are rows like any others and are spread over the blocks; there is no cap on a bucket.
    The hash functions are fitted to at most ``sample`` rows (smallest hashes of the id).

    Vectors that are null, zero or of another length than most, or that hold null or non-finite components, take no
    part; nor do null ids. Repeated rows count once. Fewer than k candidates give fewer rows; an empty table none.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    facts = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(norm).alias("largest")).orderBy(F.desc("n"), "size").first()
    if facts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == facts["size"]).dropDuplicates(["vec_id", "v"])
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    plan = fit(np.array([r["v"] for r in some]), facts["n"], facts["largest"], k, tables, functions, width)
    n = facts["n"]
    blocks = max(math.ceil(n / block), min(least_blocks, math.ceil(n / 2048)))  # by the rows alone, whatever the cluster
    query_blocks = math.ceil(n / every / query_block)
    part = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(parts)).cast("int")
    data = rows.select("vec_id", "v", part(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("queries"))

    def nearest(queries: DataFrame, mass: float) -> DataFrame:
        def cell(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(queries) and len(data):
                ids = data["vec_id"].to_numpy()
                x = np.stack(data["v"].to_numpy())
                for at in range(0, len(queries), 1024):
                    part = queries.iloc[at : at + 1024]
                    found += best(np.stack(part["w"].to_numpy()), part["q"].to_numpy(), x, ids, plan, mass, k)
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

        asked = queries.select(F.col("vec_id").alias("q"), F.col("v").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part(query_blocks, 2).alias("queries"))
        near = asked.groupBy("block", "queries").cogroup(data.groupBy("block", "queries")).applyInPandas(cell, OUT)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return near.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asked = rows.filter(F.col("vec_id") % every == 0)
    first = materialize(nearest(asked, mass), "nearest")
    # Queries that met too few rows over all blocks go on through all buckets.
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = asked.join(enough, "vec_id", "left_anti")
    if short.isEmpty():
        return first
    return first.join(enough.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").union(nearest(short, 1.0))
