"""Centroid clustering: Lloyd's rounds that only look again at what can have changed (delta Lloyd)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Largest integer component: distances of 64 such components, and sums of 2^35 of them, fit 64 bits.
LIMIT = 1 << 27
#: Vectors compared at once.
ROWS = 4096
NOBODY = -1


def integers(vector: Column, dim: int, scale: int) -> Column:
    """floor(scale * x) of every component; NULL for vectors of another length or with null or non-finite components.

    Components beyond LIMIT raise, as their squared distances would not fit 64 bits.
    """
    xs = vector.cast("array<double>")
    whole = F.transform(xs, lambda x: F.floor(x * scale))
    usable = (F.size(xs) == dim) & F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    large = F.exists(xs, lambda x: F.abs(x * scale) > LIMIT)
    return F.when(usable & large, F.raise_error(F.lit(f"a component times {scale} is over {LIMIT}")).cast("array<int>")).when(usable, whole.cast("array<int>"))


def assigned(state: DataFrame, centroids: np.ndarray, changed: list[int]) -> DataFrame:
    """The state with every vector's nearest centroid, its squared distance, and whether and from where it moved.

    A vector whose own centroid stayed is compared with the changed centroids only, as its stored distance still holds
    against all others; one whose own centroid changed is compared with all. Equal distances: the smaller number.
    """
    k, dim = centroids.shape
    again = np.zeros(k + 1, bool)
    again[[*changed, NOBODY]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), ROWS):
                part = b.slice(i, ROWS)
                v = part.column("v").flatten().to_numpy().reshape(-1, dim).astype(np.int64)
                old = part.column("cluster").to_numpy()
                unsure = again[old]
                best = np.where(unsure, np.iinfo(np.int64).max, part.column("distance").to_numpy())
                owner = np.where(unsure, k, old)
                for j in range(k):
                    rows = np.arange(len(v)) if again[j] else np.flatnonzero(unsure)
                    d = ((v[rows] - centroids[j]) ** 2).sum(axis=1)
                    closer = (d < best[rows]) | ((d == best[rows]) & (j < owner[rows]))
                    best[rows[closer]], owner[rows[closer]] = d[closer], j
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("v"), pa.array(owner, pa.int32()), pa.array(best), pa.array(old, pa.int32()), pa.array(owner != old)], names=STATE
                )

    return materialize(state.mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long, before int, moved boolean"), "assigned")


STATE = ["vec_id", "v", "cluster", "distance", "before", "moved"]


def transfers(state: DataFrame, k: int, dim: int) -> list:
    """(owner, i, s): what each centroid gained less what it lost, its count at place -1; at most k * (dim + 1) rows.

    Each task adds up the signed vectors of its movers, so the shuffle carries one row a task, centroid and component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, dim + 1), np.int64)
        for b in batches:
            v = b.column("v").flatten().to_numpy().reshape(-1, dim).astype(np.int64)
            for ends, sign in ((b.column("cluster").to_numpy(), 1), (b.column("before").to_numpy(), -1)):
                for j in np.unique(ends):
                    total[j, :-1] += sign * v[ends == j].sum(axis=0)
                    total[j, -1] += sign * int((ends == j).sum())
        owner, i = np.nonzero(total[:k])
        yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(i), pa.array(total[owner, i])], names=["owner", "i", "s"])

    moves = state.filter("moved").select("v", "cluster", "before")
    return moves.mapInArrow(run, "owner long, i long, s long").groupBy("owner", "i").agg(F.sum("s").alias("s")).collect()


def cluster(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every usable vector (see integers).

    Centroids start as the vectors with the least sha256 of ``seed:id``; each round assigns all vectors, then moves every centroid that has
    any to the floor of their mean. The last assignment follows the last move. Arithmetic is in integers, so
    results don't depend on partitions. The driver holds centroids, sums and counts (clusters x dim numbers);
    vectors and their assignments are written after each round, and the round before is deleted.

    Where a round changes no centroid all later rounds would repeat it, so they are left out. Fewer vectors than
    clusters: one centroid each. Null ids take part, and start a cluster only if ids run out; rows of one id are vectors of their own, of which those with
    the least components start first. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), dim, scale).alias("v")).filter("v is not null")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = rows.orderBy(F.coalesce(digest, F.lit("none")), "v").limit(clusters).collect()  # at most one row a centroid
    k = len(starts)
    centroids = np.array([r.v for r in starts], np.int64).reshape(k, dim)
    sums = [[0] * (dim + 1) for _ in range(k)]  # components, then count
    state = rows.select("vec_id", "v", F.lit(NOBODY).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    changed, written = list(range(k)), False
    for turn in range(rounds + 1 if k else 0):
        new = assigned(state, centroids, changed)
        if written:
            release(state)
        state, written = new, True
        if turn == rounds:
            break
        for r in transfers(state, k, dim):
            sums[r.owner][r.i] += r.s
        moved = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else c.tolist() for row, c in zip(sums, centroids, strict=True)], np.int64).reshape(k, dim)
        changed = np.flatnonzero((moved != centroids).any(axis=1)).tolist()
        centroids = moved
        if not changed:
            break
    inertia = {r.cluster: int(r.d) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()} if k else {}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(j, inertia.get(j, 0), sum(inertia.values()), names[j]) for j in range(k)]
    small = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same clusters in DuckDB: every round assigns every vector to every centroid."""
    steps = [
        f"""kept as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
            from embeddings where len(embedding) = {dim} and list_count(embedding) = {dim} and list_bool_and(list_transform(embedding, lambda x: isfinite(x))))""",
        f"c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as cluster, v as c from kept qualify cluster < {clusters})",
    ]
    for t in range(rounds + 1):
        gap = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{t} as materialized (select rid, vec_id, any_value(v) as v, min({gap} * {clusters} + cluster) as nearest from kept, c{t} group by rid, vec_id)")
        if t < rounds:
            steps.append(f"""c{t + 1} as materialized (select cluster, coalesce(m, c) as c from c{t} left join (
                select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as m from (
                select nearest % {clusters} as cluster, i, sum(v[i]) as s, count(*) as n from a{t}, generate_series(1, {dim}) g(i) group by all) group by cluster) using (cluster))""")
    return f"""with {", ".join(steps)}, last as (select vec_id, nearest % {clusters} as cluster, nearest // {clusters} as distance from a{rounds})
        select vec_id, cast(cluster as integer) as cluster, cast(distance as bigint) as distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
            cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
        from last join c{rounds} using (cluster)"""
