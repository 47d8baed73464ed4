"""Lines, labels, matches, reshapes, places and brackets on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import geo, labels, lines, match, pareto, reshape, status

LINE = "page_idx int, col_idx int, line_idx int, content string, linetype string, number string, street string, minx double, bbox_height double"


def page(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], *(list(r[5:]) + [None] * (4 - len(r[5:])))) for r in rows], LINE)


def test_merge_of_indented_lines(spark):
    e, i = lines.ENTRY, lines.INDENTED
    rows = page(spark, [(0, 0, 0, "lost", i), (0, 0, 1, "Bau⸗", e), (0, 0, 2, "meister", i), (0, 0, 3, "", e, "5"), (0, 0, 4, "Kfm", e), (0, 1, 0, "a", e)])
    merged = {(r.col_idx, r.line_idx): r.content for r in lines.merge_indented(rows).collect()}
    assert merged == {(0, 1): "Bau⸗meister ", (0, 4): "Kfm ", (1, 0): "a "}
    assert {(r.col_idx, r.lost) for r in lines.lost_indents(rows).collect()} == {(0, 1), (1, 0)}
    assert lines.merge_indented(rows, preserve_empty_headers=True).count() == 4


def test_numbers_leave_the_content_everywhere(spark):
    r = lines.tag_street_numbers(page(spark, [(0, 0, 0, "38a Silb 38a x", lines.ENTRY), (0, 0, 1, "Kfm", lines.ENTRY)])).orderBy("line_idx").collect()
    assert [(x.number, x.content, x.linetype) for x in r] == [("38a ", "Silb x", lines.NUMBERED), (None, "Kfm", lines.ENTRY)]


def test_addresses_go_on_over_columns_and_pages(spark):
    e, n, s = lines.ENTRY, lines.NUMBERED, lines.STREET
    rows = page(spark, [(0, 0, 0, "x", e), (0, 0, 1, "A", s, None, "Astr"), (0, 0, 2, "y", n, "1"), (0, 1, 0, "z", e), (1, 0, 0, "B", s, "7", "Bstr"), (1, 0, 1, "w", e)])
    got = [(r.street, r.number) for r in lines.distribute_addresses(rows).orderBy(*lines.ORDER).collect()]
    assert got == [("", ""), ("Astr", None), ("Astr", "1"), ("Astr", "1"), ("Bstr", "7"), ("Bstr", "1")]
    again = lines.distribute_addresses(lines.distribute_addresses(rows)).orderBy(*lines.ORDER).collect()
    assert [(r.street, r.number) for r in again] == got


def test_names_and_indents(spark):
    rows = page(spark, [(0, 0, k, f"l{k}", lines.ENTRY, None, None, 50.0 if k == 3 else 10.0, 9.0 if k == 5 else 1.0) for k in range(20)])
    named = lines.tag_street_names(rows)
    assert [r.line_idx for r in named.filter(F.col("linetype") == lines.STREET).collect()] == [5]
    streets = spark.createDataFrame([("l5x",), ("other",)], "name string")
    assert lines.tag_street_names(rows, streets).filter("line_idx = 5").first().street == "l5x"
    assert [r.line_idx for r in lines.tag_indented(named).filter(F.col("linetype") == lines.INDENTED).collect()] == [3]
    fixed = lines.correct_street_names(rows, spark.createDataFrame([(0, 0, 2, None), (0, 0, 4, "N")], "page_idx int, col_idx int, line_idx int, name string"))
    assert {(r.line_idx, r.street) for r in fixed.filter(F.col("linetype") == lines.STREET).collect()} == {(2, "l2"), (4, "N")}
    fixes = spark.createDataFrame([(0, 0, 2, ""), (0, 0, 4, "Astrasse"), (0, 0, 6, "none")], "page_idx int, col_idx int, line_idx int, name string")
    fixed = lines.correct_street_names(rows, fixes, spark.createDataFrame([("Astraße",), ("l2",)], "name string"), 0.6)
    assert {(r.line_idx, r.street) for r in fixed.filter(F.col("linetype") == lines.STREET).collect()} == {(2, "l2"), (4, "Astraße"), (6, "none")}
    assert fixed.count() == 20 and fixed.columns == rows.columns


def test_indents_do_not_gather_a_columns_lines(spark, capsys):
    """All lines are in three columns here; they are not dealt out by column."""
    rows = spark.range(3000).select(F.lit(0).alias("page_idx"), (F.col("id") % 3).alias("col_idx"), F.col("id").alias("line_idx"), (F.col("id") % 100).cast("double").alias("minx"), F.lit(lines.ENTRY).alias("linetype"))
    got = lines.tag_indented(rows)
    got.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert got.filter(F.col("linetype") == lines.INDENTED).select(F.min("minx"), F.count("*")).first()[:] == (79.0, 630)


def test_reduced_labels(spark):
    t, y = "Raſt , Maurer . x".split(), ["N", "D", "O", "O", "END"]
    df = spark.createDataFrame([(["START", *t], ["START", *y])], "t array<string>, y array<string>")
    r = df.select(labels.reduce_labels("t", "y").alias("c")).first().c
    assert (r.subjects, r.occupations, r.absentee, r.proprietor, r.other) == (["Raſt"], ["Maurer ."], [], [], [])
    df = spark.createDataFrame([(["a", ".b", "c", "d", "e", "f"], ["PA", "PA", "A", "P", "S", "S"])], "t array<string>, y array<string>")
    r = df.select(labels.reduce_labels("t", "y").alias("c")).first().c
    assert [(x.value, x.labels) for x in r.absentee] == [("c", ["a", "b"])] and r.proprietor == ["d"] and r.other == []


def test_field_learns_its_training_set(spark):
    made = []
    for k in range(30):
        made.append((["START", f"Name{k}", ",", "Kfm", ".", "END"], ["START", "N", "D", "O", "O", "END"]))
        made.append((["START", "Wwe", f"Frau{k}", "END"], ["START", "S", "N", "END"]))
    model = labels.train(made)
    right = [p == g for t, y in made for p, g in zip(model.predict(t), y)]
    assert np.mean(right) > 0.99
    df = spark.createDataFrame([("Neu, Kfm.", 0, 0, 0, "s", "1")], "content string, page_idx int, col_idx int, line_idx int, street string, number string")
    parsed = labels.parse_entries(df, model)
    assert parsed.first().labels[:2] == ["START", "N"] and labels.occupations(parsed).first().occupation == "Kfm ."
    gold = spark.createDataFrame([(t, y) for t, y in made[:4]], "tokens array<string>, labels array<string>")
    assert labels.confusion_rows(gold, model).count() == 20


def test_gradient_of_the_field():
    value = lambda x: (float(((x - 3) ** 2).sum()), 2 * (x - 3))
    assert np.allclose(labels.orthant_wise(value, np.zeros(4), 0.5, 100, 5), 2.75, atol=1e-4)
    assert np.allclose(labels.orthant_wise(lambda x: (float(x @ x), 2 * x + 0.1), np.zeros(3), 0.5, 100, 5), 0)


def test_matches(spark):
    names = spark.createDataFrame([("Albrechtſtraße", 0, "a"), ("abce", 1, "x"), ("abcf", 2, "y"), ("abcf", 3, "z"), (None, 4, "n")], "name string, row_idx int, code string")
    asked = spark.createDataFrame([("Albrechtſtr. (NW)",), ("abcd",), ("qqq",), (None,)], "q string")
    got = {r.query: (r.match, round(r.score, 4)) for r in match.best_matches(asked, "q", names, "name", 0.5).collect()}
    assert got == {"Albrechtſtr. (NW)": ("Albrechtſtraße", 0.7097), "abcd": ("abcf", 0.75)}
    coded = match.match_codes(asked, "q", names, "name", ["code"], "row_idx", 0.5)
    assert {(r.q, r.code) for r in coded.collect()} == {("Albrechtſtr. (NW)", "a"), ("abcd", "y"), ("qqq", None), (None, None)}


def test_blocking_loses_no_match(spark):
    import difflib
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("aeiouſtx.") for _ in range(r.randint(0, 12)))
    names, asked = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    for cutoff in (0.5, 0.8, 1.0):
        got = {x.query: x.match for x in match.best_matches(spark.createDataFrame([(a,) for a in asked], "q string"), "q", spark.createDataFrame([(n,) for n in names], "n string"), "n", cutoff).collect()}
        assert got == {a: m[0] for a in asked if (m := difflib.get_close_matches(a, names, 1, cutoff))}


def test_few_pairs_are_compared(spark, monkeypatch):
    """Misread street names find the same matches as by comparing all; of the pairs that lengths and letters leave, at most 5 % are compared."""
    import difflib
    import random
    from collections import Counter

    r = random.Random(2)
    stems = ["".join(r.choice(["al", "ber", "cha", "dor", "fried", "gra", "hein", "jo", "kant", "lin", "mar", "nol", "ot", "pots", "rei", "schil", "tau", "ur", "wil", "zim"]) for _ in range(r.randint(2, 3))) for _ in range(500)]
    streets = sorted({s.capitalize() + r.choice(["straße", "ſtraße", "platz", "allee", " Ufer", "gaſſe", "damm"]) for s in stems})
    misread = lambda s: "".join(r.choice("aeiou.") if r.random() < 0.06 else c for c in s)
    asked = sorted({misread(s) for s in streets[::2]} | {"??", "x" * 300, streets[0]})
    compared = []
    pairs = match.candidate_pairs

    def counted(*args):
        out = pairs(*args)
        compared.append(out.count())
        return out

    monkeypatch.setattr(match, "candidate_pairs", counted)
    got = match.best_matches(spark.createDataFrame([(a,) for a in asked], "q string"), "q", spark.createDataFrame([(s,) for s in streets], "n string"), "n", 0.5)
    assert {x.query: x.match for x in got.collect()} == {a: m[0] for a in asked if (m := difflib.get_close_matches(a, streets, 1, 0.5))}

    def letters(text):
        return Counter({"s": "s", "ſ": "s"}.get(c.lower(), c.lower()) if c.lower() in "eainrsſtl" else "" for c in text)

    known = [(s, letters(s)) for s in streets]
    before = sum(2 * sum((x & k).values()) >= 0.5 * (len(a) + len(s)) for a in asked for x in [letters(a)] for s, k in known)
    assert sum(compared) <= before / 20


def test_matches_of_odd_texts(spark):
    names = spark.createDataFrame([("",), ("a",), ("😀b",), ("ab" * 150,), ("\n",)], "n string")
    asked = spark.createDataFrame([("",), ("😀c",), ("ab" * 150,), ("ab" * 149 + "x",), ("\n",), (None,)], "q string")
    got = {x.query: (x.match, round(x.score, 3)) for x in match.best_matches(asked, "q", names, "n", 0.4).collect()}
    import difflib

    want = {a.q: m[0] for a in asked.collect() if a.q is not None and (m := difflib.get_close_matches(a.q, [x.n for x in names.collect()], 1, 0.4))}
    assert {k: v[0] for k, v in got.items()} == want and got[""] == ("", 1.0)
    assert match.best_matches(asked.limit(0), "q", names, "n", 0.4).collect() == [] == match.best_matches(asked, "q", names.limit(0), "n", 0.4).collect()


def test_lookups(spark):
    df, dim = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert {(r.k, r.v) for r in match.lookup(df, dim, "k").collect()} == {(1, "a"), (2, None)}
    with pytest.raises(Exception, match="no entry for 2"):
        match.lookup(df, dim, "k", strict=True).collect()
    got = match.external_lookup(df, "k", lambda k: (k * 2.0, 1.0) if k == 1 else 1 / 0, "x double, y double").collect()
    assert {(r.k, r.x, r.success) for r in got} == {(1, 2.0, True), (2, None, False)}


def test_online_lookups_count_what_they_asked(spark):
    from pyspark.sql import Observation

    from ledgerline.functions.text import latin_escape

    pages = {"Maurer": "<td>09510</td><td>12345</td><td>12345</td>", "Kfm+%FC": "<td>22222</td><td>11111</td>", "leer": "<p>none</p>"}

    def client(question):
        if question == "down":
            raise ConnectionError
        return pages.get(question)

    seen = Observation()
    df = spark.createDataFrame([("Maurer",), ("Maurer",), ("Kfm ü",), ("leer",), ("down",), ("unknown",), (None,)], "occupation string")
    got = status.codes_online(df, "occupation", client, attempts=4, metrics=seen)
    assert sorted(map(str, ((r.occupation, r.hisco) for r in got.collect()))) == sorted(map(str, [("Maurer", "12345")] * 2 + [("Kfm ü", "11111"), ("leer", None), ("down", None), ("unknown", None), (None, None)]))
    assert seen.get == {"asked": 5, "found": 3, "failed": 2, "calls": 8}
    assert latin_escape(F.lit("ü")) is not None
    seen = Observation()
    places = {"Berlin, Astr 1, 1880": (1.0, 2.0)}
    rows = spark.createDataFrame([("Astr 1", 7), ("Bstr", 8), (None, 9)], "address string, x_old int")
    got = geo.geocode_online(rows, "address", places.get, "Berlin, ", ", 1880", metrics=seen)
    assert {(r.address, r.x_old, r.x, r.y) for r in got.collect()} == {("Astr 1", 7, 1.0, 2.0), ("Bstr", 8, None, None), (None, 9, None, None)}
    assert seen.get == {"asked": 2, "found": 1, "failed": 1, "calls": 2}
    seen = Observation()
    assert geo.geocode_online(rows.limit(0), "address", places.get, metrics=seen).collect() == [] and seen.get["asked"] == 0


def test_tables_are_joined_without_a_shuffle(spark):
    tables = {f"t{k}": spark.createDataFrame([(i, q, float(i * q * k)) for i in range(40) for q in (1, 2) if (i + k) % 3] + [(None, 1, 9.0)], "id int, q int, v double") for k in range(9)}
    out = reshape.cascade(tables, ["id", "q"], "v", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 9
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 80 and all(r[f"t{k}"] == (float(r.id * r.q * k) if (r.id + k) % 3 else None) for r in rows for k in range(9))


def test_places(spark):
    street = "name string, num_1 string, num_2 string, num_3 string, num_4 string, line array<struct<x: double, y: double>>, row_idx int"
    line, closed = [(0.0, 0.0), (4.0, 0.0)], [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    rows = spark.createDataFrame([("S", "1", "5", ".", ".", line, 0), ("C", "2", "1", ".", ".", closed, 1), ("N", "1", "3", ".", ".", None, 2), ("R", "3", "1", "3", "3", line, 3)], street)
    got = {r.address: (round(r.x, 3), round(r.y, 3)) for r in geo.street_addresses(rows).collect()}
    assert got == {"S 1": (0, 0), "S 2": (0, 0), "S 3": (1.333, 0), "S 4": (2.667, 0), "S 5": (4, 0), "C 1": (1, 1), "C 2": (1, 1), "R 1": (4, 0), "R 2": (0, 0), "R 3": (4, 0)}
    lots = spark.createDataFrame([("a", "b", None, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], 0), ("b", None, None, [(9.0, 9.0)], 1)], "adress1 string, adress2 string, adress3 string, ring array<struct<x: double, y: double>>, row_idx int")
    assert {(r.address, r.x) for r in geo.lot_addresses(lots).collect()} == {("a", 1.0), ("b", 1.0)}
    zones = spark.createDataFrame([("z1", 1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), ("z0", 0, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)])], "id string, zone_idx int, ring array<struct<x: double, y: double>>")
    spots = spark.createDataFrame([(1.5, 1.5), (0.5, 0.5), (2.0, 0.5), (9.0, 9.0), (None, 1.0)], "x double, y double")
    assert {(r.x, r.zone) for r in match.within_first(spots, zones, "x", "y").collect()} == {(1.5, "z0"), (0.5, "z1"), (2.0, None), (9.0, None), (None, None)}
    assert geo.geocode(spark.createDataFrame([("S 3.",), ("??",)], "address string"), "address", geo.street_addresses(rows)).filter("x is not null").count() == 1


def test_status_codes(spark):
    scores = status.score_table(spark.createDataFrame([("1100", 82.82), ("12345", 50.0)], "HISCO string, HISCAM double"))
    rows = spark.createDataFrame([("01100*",), ("12345",), ("9",), (None,)], "hisco_1 string")
    assert {(r.hisco_1, r.hiscam_1) for r in status.scored(rows, scores, "hisco_1", "hiscam_1").collect()} == {("01100*", 82.82), ("12345", 50.0), ("9", None), (None, None)}


def test_merges(spark):
    a, b = spark.createDataFrame([(1, "x", "l"), (None, "n", "l")], "k int, v string, w string"), spark.createDataFrame([(1, "y"), (2, "z"), (None, "m")], "k int, v string")
    assert {(r.k, r.v, r.w, r.merge) for r in reshape.merge(a, b, ["k"]).collect()} == {(1, "x", "l", 3), (2, "z", None, 2), (None, "n", "l", 1), (None, "m", None, 2)}
    assert (None, "n", "l", 3) in {(r.k, r.v, r.w, r.merge) for r in reshape.merge(a, b, ["k"], match_nulls=True).collect()}
    with pytest.raises(ValueError):
        reshape.merge(a.union(a), b, ["k"], check=True)
    assert [tuple(r) for r in reshape.matched(a, b, ["k"], check=True).collect()] == [(1, "x", "l")]
    with pytest.raises(ValueError):
        reshape.matched(a.union(a), b, ["k"], check=True)
    wide = spark.createDataFrame([(1, 10, 20, 30)], "id int, a1 int, a2 int, b1 int")
    assert {(r.j, r.a, r.b) for r in reshape.longer(wide, ["id"], ["a", "b"], [1, 2], "j").collect()} == {(1, 10, 30), (2, 20, None)}


def test_brackets(spark):
    rows = spark.createDataFrame([(1, 1, 60.0, 0.0, 3000.0, 100.0), (1, 2, 30.0, 100.0, 4500.0, 100.0), (1, 3, 10.0, 200.0, 2500.0, 100.0), (1, 4, 0.0, 300.0, 0.0, 100.0)], "id int, bracket int, n double, lower double, wealth double, mean double")
    at = pareto.positions(rows)
    assert [(r.bracket, round(r.p, 6), r.average) for r in at.orderBy("bracket").collect()] == [(1, 0.0, 50.0), (2, 0.6, 150.0), (3, 0.9, 250.0)]
    assert [r.error for r in pareto.consistent(at).collect()] == [0, 0, 0]
    with pytest.raises(Exception, match="inconsistent"):
        pareto.consistent(at.withColumn("average", F.lit(1.0)), fail=True).collect()
    table = pareto.interpolate(at).orderBy("p").collect()
    assert len(table) == 127
    by = {r.p: r for r in table}
    assert by[0.6].top_share == pytest.approx(0.7) and by[0.9].top_share == pytest.approx(0.25) and by[0.6].threshold == pytest.approx(100) and by[0.9].threshold == pytest.approx(200)
    top = [r.top_share for r in table]
    assert all(x >= y for x, y in zip(top, top[1:])) and sum(r.bracket_share for r in table) == pytest.approx(1)
    assert len(pareto.wide_top_shares(pareto.interpolate(at)).columns) == 71


def test_interpolation_recovers_a_pareto_distribution():
    p, a, m = np.array([0, 0.3, 0.6, 0.8, 0.9, 0.97]), 2.0, 1.0
    low = m * (1 - p) ** (-1 / a)
    above = a / (a - 1) * m * (1 - p) ** (1 - 1 / a)
    average = -np.diff(np.append(above, 0)) / np.diff(np.append(p, 1))
    d = pareto.Interpolation(p, low, average, above[0])
    q = np.array([0.1, 0.45, 0.7, 0.85, 0.95, 0.99, 0.999])
    assert np.allclose(d.top_share(q), (1 - q) ** (1 - 1 / a), rtol=2e-3)
    assert np.allclose(d.threshold(q), (1 - q) ** (-1 / a), rtol=2e-2)


def test_sentences_labelled_together_get_the_labels_of_each(monkeypatch):
    from ledgerline.operators import labels

    made = [(["START", f"Customer#{k}", ",", w, ".", "END"], ["START", "N", "D", "O", "O", "END"]) for k, w in enumerate(("BUILDING", "MACHINERY", "FURNITURE"))]
    model = labels.train(made)
    texts = [[], ["Et"], ["START", "Customer#9", ",", "BUILDING", ".", "END"], ["a"] * 4, ["START", "geh", ",", "12"], ["x", ",", "MACHINERY", "."] * 9]
    calls = []
    real = labels.word_attributes
    monkeypatch.setattr(labels, "word_attributes", lambda w: calls.append(w) or real(w))
    monkeypatch.setattr(labels, "BLOCK", 5)  # sentences longer than a block too
    got = model.predict_all(texts * 3)
    assert len(calls) == len(set(calls))  # a word's attributes are found once
    for tokens, y in zip(texts * 3, got, strict=True):
        s = np.zeros((len(tokens), len(model.labels)))
        for t, own in enumerate(labels.attributes(tokens)):
            for name, w in own.items():
                if w and name in model.index:
                    s[t] += w * model.state[model.index[name]]
        assert (model.scores(tokens) == s).all() and y == model.predict(tokens)
