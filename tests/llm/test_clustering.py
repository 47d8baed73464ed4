"""Delta Lloyd against plain Lloyd in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from ledgerline.llm.clustering import assigned, cluster

SCHEMA = "vec_id long, embedding array<float>, cluster int, moved string, v string"


def brute(rows, k, rounds, dim):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "none", r[1]))[:k]
    cents = [v for _, v in start]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, sum(y for _, y, x in last if x == j), sum(y for _, y, _ in last), names[j]) for i, d, j in last), key=str)


@pytest.mark.parametrize(("n", "k", "rounds", "spread"), [(150, 8, 10, 40), (150, 8, 1, 40), (60, 4, 10, 1), (3, 8, 10, 40), (80, 5, 0, 3)])
def test_equals_plain_lloyd(spark, n, k, rounds, spread):
    r = random.Random(n + k)
    rows = [(i, [r.randint(-spread, spread) / 64 for _ in range(4)]) for i in range(n)]
    rows += [(7, rows[2][1]), (8, [0.1] * 4), (8, [0.1] * 4), (None, [0.25] * 4), (900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [1.0, math.inf, 0.0, 0.0])]
    df = spark.createDataFrame([(*x, 1, "m", "v") for x in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, cluster(df, k, rounds, dim=4).collect()), key=str)
    assert got == brute(rows, k, rounds, 4)


def test_nothing_usable_and_too_large(spark):
    assert cluster(spark.createDataFrame([], SCHEMA), dim=4).collect() == []
    assert cluster(spark.createDataFrame([(1, None, 1, "m", "v")], SCHEMA), dim=4).collect() == []
    with pytest.raises(Exception, match="a component times 1024"):
        cluster(spark.createDataFrame([(1, [1e9] * 4, 1, "m", "v")], SCHEMA), dim=4).collect()


def test_stored_distances_hold_where_the_owner_stayed(spark):
    """Only what the changed centroids and moved owners can alter is compared: a wrong stored distance stays."""
    rows = spark.createDataFrame([(1, [0, 0], 0, 99), (2, [9, 9], 1, 0), (3, [5, 5], 1, 99)], "vec_id long, v array<int>, cluster int, distance long")
    got = {r.vec_id: (r.cluster, r.distance, r.before, r.moved) for r in assigned(rows, np.array([[1, 1], [9, 9], [6, 6]]), [2]).collect()}
    assert got == {1: (2, 72, 0, True), 2: (1, 0, 1, False), 3: (2, 2, 1, True)}
