"""Running sums, ranks, medians, fills and runs over range partitions against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import scans


@pytest.fixture(params=[1, 7], ids=["one partition", "seven partitions"])
def parts(spark, request):
    """Few rows still go to as many partitions."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(n=300, seed=1):
    r = random.Random(seed)
    return [(r.choice(["hot"] * 8 + ["b", None]), i, r.choice([None, r.randint(0, 9)]), r.choice("xxxxy")) for i in range(n)]


SCHEMA = "g string, i int, v int, l string"


def test_prefix_sums_of_a_hot_group(spark, parts):
    data = rows()
    got = scans.prefix_sums(spark.createDataFrame(data, SCHEMA).repartition(3), ["g"], ["i"], v=F.col("v"), n=F.lit(1)).collect()
    assert len(got) == len(data)
    for x in got:
        mine = [d for d in data if d[0] == x.g]
        before = [d for d in mine if d[1] < x.i]
        assert (x.before_v, x.before_n, x.total_v, x.total_n) == (sum(d[2] or 0 for d in before), len(before), sum(d[2] or 0 for d in mine), len(mine))


def test_one_group_uses_all_partitions(spark, parts):
    df = spark.range(1000).select(F.lit("one").alias("g"), F.col("id").alias("i"))
    held = scans.staged(scans.ranged(df, ["g"], ["i"])).groupBy("__part").count().collect()
    assert len(held) == parts and max(x["count"] for x in held) <= 2 * 1000 / parts


def test_positions_and_medians(spark, parts):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    by = {}
    for d in sorted(data, key=lambda d: d[1]):
        by.setdefault(d[0], []).append(d)
    got = scans.positions(df, ["g"], ["i"]).collect()
    assert {(x.g, x.n, x.i, x.total_n) for x in got} == {(g, k, d[1], len(ds)) for g, ds in by.items() for k, d in enumerate(ds, 1)}
    want = {g: statistics.median(x) for g, ds in by.items() if (x := [d[2] for d in ds if d[2] is not None])}
    assert {x.g: x["median"] for x in scans.medians(df, ["g"], "v").collect()} == want
    assert scans.medians(df.filter("v is null"), ["g"], "v").collect() == []
    assert scans.positions(df, [], [F.desc("i")]).filter("n = 1").first().i == 299


def test_fill_goes_over_all_partitions(spark, parts):
    data = [(None, i, 5 if i == 3 else 8 if i == 250 else None, "x") for i in range(300)]
    got = scans.forward_fill(spark.createDataFrame(data, SCHEMA).repartition(3), ["v"], ["i"], -1).orderBy("i").collect()
    assert [x.v for x in got] == [-1] * 3 + [5] * 247 + [8] * 50 and got[0].__fields__ == ["g", "i", "v", "l"]
    assert scans.forward_fill(spark.createDataFrame([], SCHEMA), ["v"], ["i"]).collect() == []


@pytest.mark.parametrize("last", [False, True])
def test_runs_are_merged_over_partitions(spark, parts, last):
    data = [*rows(), *(("long", i, None, "z" if i < 200 else None if i < 210 else "w") for i in range(230))]
    got = scans.runs(spark.createDataFrame(data, SCHEMA).repartition(3), ["g"], ["i"], "l", last).collect()
    want = set()
    for g in {d[0] for d in data}:
        labels, out = [d[3] for d in sorted((d for d in data if d[0] == g), key=lambda d: d[1])], []
        for x in labels:
            if out and out[-1][0] == x:
                out[-1][1] += 1
            else:
                out.append([x, 1])
        want |= {(g, k, x, n) for k, (x, n) in enumerate(out if last else out[:-1], 1)}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_runs_inside_a_partition_are_neither_shuffled_nor_broadcast(spark, parts, capsys):
    """What is joined and merged are stretches of groups that go over partitions: their number doesn't grow with the runs."""
    data = [*rows(), *((None, 1000 + i, None, "xy"[i % 5 == 0]) for i in range(200))]
    got = scans.runs(spark.createDataFrame(data, SCHEMA).repartition(3), [], ["i"], "l", True)
    got.explain()
    plan = capsys.readouterr().out
    outer = plan[plan.index("Union\n") :].splitlines()[1:]  # the first of the two is what stays where it is
    depth = next(k for k, line in enumerate(outer) if "BroadcastHashJoin" in line)
    assert not any("Exchange" in line or "Sort" in line for line in outer[:depth]) and "LeftOuter, BuildRight" in outer[depth]
    below = outer[depth + 1 :]
    streamed = below[: next(k for k, line in enumerate(below) if "BroadcastExchange" in line)]
    assert any("FileScan" in line for line in streamed) and not any("Exchange" in line for line in streamed)
    labels, want = [d[3] for d in sorted(data, key=lambda d: d[1])], []
    for x in labels:
        if want and want[-1][0] == x:
            want[-1][1] += 1
        else:
            want.append([x, 1])
    assert [tuple(x) for x in got.orderBy("run").collect()] == [(k, x, n) for k, (x, n) in enumerate(want, 1)]
