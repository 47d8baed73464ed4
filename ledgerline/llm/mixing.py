"""Mixing sources to target weights by a Pfair schedule."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import before, materialize, numbered


def quotas(weights: Mapping[str | None, float], period: int) -> dict[str | None, int]:
    """Whole shares of period for each source: largest remainders of period * weight, raised to one where that is zero; they sum to period."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of as many blocks; it is {period}")
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    total = math.fsum(weights.values())
    share = {s: period * (weights[s] / total) for s in names}
    got = {s: int(share[s]) for s in names}
    for s in sorted(names, key=lambda s: int(share[s]) - share[s])[: period - sum(got.values())]:
        got[s] += 1
    got = {s: max(1, n) for s, n in got.items()}
    over = sum(got.values()) - period
    for s in sorted(names, key=lambda s: -got[s]):  # what raising took, from the largest
        less = min(over, got[s] - 1)
        got[s], over = got[s] - less, over - less
    return got


def exact(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """The weights as whole numbers in exactly the same ratio."""
    if bad := [s for s, w in weights.items() if not 0 < w < math.inf]:
        raise ValueError(f"weights that are not positive: {bad[:5]}")
    ratio = {s: w.as_integer_ratio() for s, w in weights.items()}
    whole = math.lcm(*(d for _, d in ratio.values()))
    return {s: ratio[s][0] * (whole // ratio[s][1]) for s in sorted(ratio, key=lambda s: (s is not None, s or ""))}


def edf(shares: Sequence[int], blocks: Sequence[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """Earliest deadline first over all blocks: (source, block, slot, release, deadline) by number of the source, slot after slot.

    Block j of a source with a share of a / q is released at floor(j q / a) and due by ceil((j + 1) q / a). No
    slot is left free while all sources have blocks, so every deadline is met (Pfair) and each source is less than one block from
    its share. A source that has run out leaves its slots free. Holds one block of each source at a time.
    """
    q = sum(shares)
    waiting = [(0, -(-q // a), n, 0) for n, (a, k) in enumerate(zip(shares, blocks, strict=True)) if k]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, due, n, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, n, j, release))
        due, n, j, release = heapq.heappop(ready)
        assert slot < due
        yield n, j, slot, release, due
        if (j := j + 1) < blocks[n]:
            a = shares[n]
            heapq.heappush(waiting, (j * q // a, -(-(j + 1) * q // a), n, j))
        slot += 1


def schedule(quota: Mapping[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """One period in which each source has as many blocks as its quota: (source, block, slot, release, deadline)."""
    names, a = list(quota), list(quota.values())
    return [(names[n], *rest) for n, *rest in edf(a, a)]


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    alpha: float = 0.5,
    block_docs: int = 16,
    period: int | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Give every document its place in the mix: source, block, slot, release, deadline, position, and the columns ``keep``.

    Each source, ordered by id, is cut into blocks of block_docs documents. Releases and deadlines are taken straight
    from the weights, for any number of sources (with ``period`` from quotas in so many blocks). One task deals out the blocks, not the documents, and writes them slot after slot, in
    memory for one block of each source. Without weights they are the sources' row counts to the power alpha.

    Nothing is dropped: once a source has run out its slots are skipped, and the others go on in
    their mutual ratio. Up to the first such end every source is less than one block from its weight's share.

    Null sources are a source of their own; rows with a null id come first in their source;
    repeated rows stay. A source without weight, or a weight that is not positive, raises ValueError. An empty table gives no rows.
    """
    key = ["doc_id", "source", *keep]
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *keep), key, "mix")
    counts = rows.groupBy("__part", "source").agg(F.count("*").alias("n"))
    found = {r["source"]: r["n"] for r in counts.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # one row per source
    if weights is None:
        weights = {s: n**alpha for s, n in found.items()}
    elif missing := [s for s in found if s not in weights]:
        raise ValueError(f"sources without weight: {missing[:5]}")
    quota = {} if not weights else exact(weights) if period is None else quotas(weights, period)
    names, shares = list(quota), list(quota.values())
    sizes = [-(-found.get(s, 0) // block_docs) for s in names]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            dealt = edf(shares, sizes)
            while part := list(islice(dealt, 20_000)):
                n, *rest = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in n], pa.string()), *(pa.array(c, pa.int64()) for c in rest)], names=["__s", "__j", "slot", "release", "deadline"])

    plan = materialize(docs.sparkSession.range(0, 1, 1, 1).mapInArrow(deal, "__s string, __j long, slot long, release long, deadline long"), "schedule")
    in_source = Window.partitionBy("__part", "source").orderBy("__k")
    blocks = (
        rows.withColumn("__i", F.row_number().over(in_source) - 1)
        .alias("r").join(before(counts, ["source"], ["n"]).alias("b"), F.expr("r.__part = b.__part and r.source <=> b.source"))
        .select(*(f"r.{c}" for c in key), (F.col("__before_n") + F.col("__i")).alias("__at"))
        .withColumn("block", F.expr(f"__at div {block_docs}"))
        .join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__j")))
        .select(*key, "block", "slot", "release", "deadline", F.expr(f"__at % {block_docs}").alias("__at"))
    )
    order = numbered(blocks, ["slot", "__at"], "mix")
    starts = before(order.groupBy("__part").agg(F.count("*").alias("n")), [], ["n"])
    in_part = Window.partitionBy("__part").orderBy("__k")
    return (
        order.withColumn("__i", F.row_number().over(in_part) - 1)
        .join(F.broadcast(starts), "__part")  # one row per partition
        .select("doc_id", "source", "block", "slot", "release", "deadline", *keep, (F.col("__before_n") + F.col("__i")).alias("position"))
    )
