"""Text, geometry and statistics against hand-made values and plain Python."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import geometry, stats, text


def column(spark, values, expression):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c string").select("k", expression.alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.k)]


def test_leading_number(spark):
    assert column(spark, ["38aSilb", "1. a. d. Lin", "Kfm", "", ". ,", "12—14 x"], text.leading_number("c")) == ["38a", "1. ", None, None, None, "12—14 "]


def scan(content):
    out = ""
    for ch in content:
        if ch.isdigit() or ch in " .,;—-" or (ch.isalpha() and out and out[-1].isdigit()):
            out += ch
        else:
            break
    return out if any(c.isdigit() for c in out) else None


def test_leading_number_equals_a_scan_and_tokens_a_splitter(spark):
    r = random.Random(2)
    lines = ["".join(r.choice("0123456789abÄſ .,;—-&(") for _ in range(r.randint(0, 12))) for _ in range(400)]
    assert column(spark, lines, text.leading_number("c")) == [scan(x) for x in lines]

    def split(x):
        for m in ".,&":
            x = x.replace(m, f" {m} ")
        return [w for w in x.split(" ") if w]

    assert column(spark, lines, text.tokenize("c")) == [split(x) for x in lines]


def test_sanitize_tokens_and_codes(spark):
    assert column(spark, ["1. ", "Kfm .", " a.. ", ""], text.sanitize("c")) == ["1.", "Kfm", "a..", ""]
    assert column(spark, ["a,b&c. d"], text.tokenize("c", ends=True)) == [["START", "a", ",", "b", "&", "c", ".", "d", "END"]]
    assert column(spark, ["a,b&c. d"], text.truth_tokens("c")) == [["a", ",", "b&c", ".", "d"]]
    assert column(spark, ["1100", "123456", None], text.pad_code("c")) == ["01100", "123456", None]
    assert column(spark, ["1a1a1", None], text.without("c", F.lit("1"))) == ["aa", None]


def test_shapes_of_words(spark):
    words = ["Abc", "abc", "ABC", "a1", "1", "Ab Cd", "aB", "A", "ſ", ""]
    for ours, theirs in ((text.is_lower, str.islower), (text.is_upper, str.isupper), (text.is_title, str.istitle)):
        assert column(spark, [w for w in words if w != "ſ"], ours(F.col("c"))) == [theirs(w) for w in words if w != "ſ"]


def test_best_match_is_the_library_one():
    r = random.Random(4)
    names = ["".join(r.choice("abcd ") for _ in range(r.randint(1, 9))) for _ in range(60)]
    for _ in range(60):
        q = "".join(r.choice("abcd ") for _ in range(r.randint(1, 9)))
        got = text.best_match(q, names, 0.5)
        assert (difflib.get_close_matches(q, names, 1, 0.5) or [None])[0] == (got[0] if got else None)
    assert text.best_match("abcd", ["abce", "abcf"], 0.5)[0] == "abcf"


def test_points_of_coordinates(spark):
    rows = spark.createDataFrame([("3,1 1,5 2,2",)], "c string")
    r = rows.select(geometry.min_x(geometry.points("c")).alias("x"), geometry.rotated_sides(geometry.points("c")).alias("s")).first()
    assert r.x == 1 and r.s.width < r.s.length


def test_spearman_with_ties_and_gaps(spark):
    r = random.Random(3)
    data = [(k % 2, r.choice([None, *range(6)]), r.choice([None, *range(5)])) for k in range(200)]
    got = {x.g: x.rho for x in stats.spearman(spark.createDataFrame(data, "g int, a int, b int"), "a", "b", ["g"]).collect()}
    for g in (0, 1):
        import pandas as pd

        d = pd.DataFrame([x for x in data if x[0] == g and x[1] is not None and x[2] is not None])
        assert got[g] == pytest.approx(d[1].rank().corr(d[2].rank()), abs=1e-12)


@pytest.mark.parametrize("float32", [False, True])
def test_top_shares(spark, float32):
    r = random.Random(5)
    data = [(g, float(r.choice(range(40)))) for g, n in (("a", 100), ("b", 101), ("c", 400)) for _ in range(n)] + [("c", None)]
    got = {(x.g, x.q): x.share for x in stats.top_shares(spark.createDataFrame(data, "g string, v double"), "g", "v", float32=float32).collect()}
    assert len(got) == 3 * 70
    for (g, q), share in got.items():
        v = sorted(x for k, x in data if k == g and x is not None)
        if len(v) <= 100:
            assert share is None
            continue
        at = [float(np.float32(k / len(v))) if float32 else k / len(v) for k in range(1, len(v) + 1)]
        assert share == pytest.approx(sum(x for x, p in zip(v, at) if p >= q / 100) / sum(v), abs=1e-12)


def test_values_of_json_and_totals_of_some(spark):
    assert column(spark, ['{"k": 3}', '{"k": "x"}', "{}", "no", None], text.json_value("c", "$.k", "int")) == [3, None, None, None, None]
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 5.0)], "g int, v double")
    assert {(r.g, r.t) for r in df.groupBy("g").agg(stats.total_if("v", F.col("v") < 3).alias("t")).collect()} == {(1, 2.0), (2, 0.0)}


def test_missing_values_in_statistics(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (None, 1.0)], "g int, v double")
    assert {(r.g, r.n, r["mean"]) for r in stats.count_mean(df, ["g"], "v").collect()} == {(1, 0, None), (2, 1, 3.0), (None, 1, 1.0)}
    assert df.select(stats.safe_ln(F.lit(0.0)).alias("x")).first().x is None
