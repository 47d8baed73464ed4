"""Readers, the referencing plan from pages to scores, and the labeller over a stream."""

import csv
import json
import sqlite3
import struct

from pyspark.sql import functions as F

from ledgerline.operators import labels
from ledgerline.plans import master, referencing
from ledgerline.sources import pagexml, tables
from ledgerline.streaming import labeller

PAGE = """<?xml version="1.0"?><PcGts xmlns="http://x"><Page><ReadingOrder><OrderedGroup>
<RegionRefIndexed index="0" regionRef="r5"/><RegionRefIndexed index="1" regionRef="r2"/><RegionRefIndexed index="2" regionRef="other"/></OrderedGroup></ReadingOrder>
<TextRegion>{a}</TextRegion><TextRegion>{b}</TextRegion></Page></PcGts>"""


def line(points, *texts):
    return f'<TextLine><Coords points="{points}"/>' + "".join(f'<TextEquiv index="{i}"><Unicode>{t}</Unicode></TextEquiv>' for i, t in texts) + "</TextLine>"


def box(x, y, h=10):
    return f"{x},{y} {x + 90},{y} {x + 90},{y + h} {x},{y + h}"


def test_pages(spark, tmp_path):
    a, b = line(box(0, 0), (1, "second")) + line(box(0, 20), (0, "first"), (1, "x")), line(box(0, 0)) + line(box(9, 9), (0, ""))
    (tmp_path / "p2.xml").write_text(PAGE.format(a=a, b=b))
    (tmp_path / "p1.xml").write_text(PAGE.format(a=line(box(0, 0), (0, "one")), b=""))
    rows = {(r.page_idx, r.col_idx, r.line_idx): r.content for r in pagexml.read_pages(spark, str(tmp_path)).collect()}
    (tmp_path / "p0.xml").write_text(PAGE.format(a="", b=""))  # a page without lines has its number
    later = {(r.page_idx - 1, r.col_idx, r.line_idx): r.content for r in pagexml.read_pages(spark, str(tmp_path)).collect()}
    assert rows == later == {(0, 1, 0): "one", (1, 1, 0): "second", (1, 1, 1): "first", (1, 0, 0): "", (1, 0, 1): ""}


def test_training_and_score_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('1,START,START\n1,"Bon,ting",N\n1,END,END\n2,START,START\n2,END,END\n')
    got = {r.sentence_no: (r.tokens, r.labels) for r in tables.read_training(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {1: (["START", "Bon,ting", "END"], ["START", "N", "END"]), 2: (["START", "END"], ["START", "END"])}
    (tmp_path / "s.csv").write_text("HISCO,HISCAM\n1100,82.82\n")
    assert tables.read_scores(spark, str(tmp_path / "s.csv")).first().hisco == "01100"
    (tmp_path / "o.csv").write_text("occupation,hisco\nMaurer,09510\nMaurer,1\n")
    assert [(r.hisco, r.row_idx) for r in tables.read_occupations(spark, str(tmp_path / "o.csv")).collect()] == [("09510", 0), ("1", 1)]
    tables.write_statistics(spark.createDataFrame([(1.0,)], "x double"), str(tmp_path / "x.dta"))
    assert tables.read_statistics(spark, str(tmp_path / "x.dta")).first().x == 1.0


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "z.gpkg")
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]
    blob = b"GP\x00\x01" + struct.pack("<i", 0) + b"\x01" + struct.pack("<III", 3, 1, len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    with sqlite3.connect(path) as db:
        db.execute("create table gpkg_contents (table_name text, data_type text)")
        db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
        db.execute("create table zone (id text, geom blob)")
        db.execute("insert into gpkg_contents values ('zone', 'features')")
        db.execute("insert into gpkg_geometry_columns values ('zone', 'geom')")
        db.executemany("insert into zone values (?, ?)", [("a", blob), ("b", None)])
    rows = tables.read_layer(spark, path).orderBy("row_idx").collect()
    assert [(r.id, r.ring and [(p.x, p.y) for p in r.ring]) for r in rows] == [("a", ring[:3]), ("b", None)]
    assert tables.wkb_rings(b"\x01" + struct.pack("<Idd", 1, 3.0, 4.0)) == [[(3.0, 4.0)]]


def model():
    made = []
    for k in range(20):
        made.append((["START", f"Name{k}", ",", "Maurer", ".", "END"], ["START", "N", "D", "O", "O", "END"]))
    return labels.train(made)


def test_ground_truth_file(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 1, "START,b"), (0, 0, 0, "a"), (1, 0, 0, "z")], "page_idx int, col_idx int, line_idx int, content string")
    pagexml.write_ground_truth(rows, 0, str(tmp_path / "g"))
    (part,) = (tmp_path / "g").glob("*.csv")
    with part.open(newline="") as f:
        got = [tuple(r) for r in csv.reader(f)]
    assert got == [("1", "START", "START"), ("1", "a", ""), ("1", "END", "END"), ("2", "START", "START"), ("2", "START", ""), ("2", ",", ""), ("2", "b", ""), ("2", "END", "END")]


def test_ground_truth(spark):
    rows = spark.createDataFrame([(0, 0, 0, "a&b, c", "p", "1,2 3,4")], "page_idx int, col_idx int, line_idx int, content string, page_file string, coords string")
    assert [r.token for r in pagexml.ground_truth(rows).orderBy("pos").collect()] == ["START", "a&b", ",", "c", "END"]
    r = pagexml.line_texts(rows).first()
    assert (r.x0, r.y0, r.x1, r.y1) == (1, 2, 3, 4)
    assert pagexml.image_urls(spark, "u/%s.jpg", 9, 10, 3).orderBy("page").collect()[1].url == "u/010.jpg"


def referenced_rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_from_pages_to_scores(spark, tmp_path):
    body = [("Astr", 40, 0), ("1 Adam, Maurer.", 10, 0), ("Bonk,", 10, 0), ("Maurer.", 10, 60)] + [(f"Name{k}, Maurer.", 10, 0) for k in range(14)]
    a = "".join(line(box(x, 50 * k, h), (0, t)) for k, (t, h, x) in enumerate(body))
    (tmp_path / "p1.xml").write_text(PAGE.format(a=a, b=""))
    rows = referencing.occupation_table(pagexml.read_pages(spark, str(tmp_path)), model(), spark.createDataFrame([("Astr",)], "name string")).cache()
    assert {(r.street, r.number, r.occupation) for r in rows.collect()} == {("Astr", "1", "Maurer")}
    assert rows.count() == 16
    places = spark.createDataFrame([("Astr 1", 0.5, 0.5)], "address string, x double, y double")
    jobs = spark.createDataFrame([("Maurer", "09510*", 0)], "occupation string, hisco string, row_idx long")
    scores = spark.createDataFrame([("09510", 50.0)], "hisco string, hiscam double")
    tracts = spark.createDataFrame([("7", 0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], "id string, zone_idx int, ring array<struct<x: double, y: double>>")
    out = referencing.referenced(rows, [places] * 3, [jobs] * 3, scores, tracts)
    assert referenced_rows(referencing.referenced(rows, [places] * 3, [jobs] * 3, scores, tracts)) == referenced_rows(out)
    long = referencing.long_form(out)
    assert {(r.geo_m, r.status_m, r.id, r.n, r["mean"]) for r in referencing.tract_statistics(long).collect()} == {(g, s, 7, 16, 50.0) for g in (1, 2, 3) for s in (1, 2, 3)}
    assert referencing.tract_top_shares(long).filter("share is not null").count() == 0
    given = master.Inputs(str(tmp_path / "pages"), model(), [places] * 3, [jobs] * 3, scores, tracts, spark.createDataFrame([(7, 30, 0.5)], "id int, q int, top_share double"), spark.createDataFrame([("Astr",)], "name string"))
    (tmp_path / "pages").mkdir()
    (tmp_path / "p1.xml").rename(tmp_path / "pages" / "p1.xml")
    done = master.run(spark, given, str(tmp_path / "export"))
    assert referenced_rows(done.referenced) == referenced_rows(out) and spark.read.parquet(str(tmp_path / "export")).columns == done.exported.columns and len(done.exported.columns) == 12
    assert done.statistics.count() == 9 and done.panel.count() == 70 and len(done.panel.columns) == 11 and {r.rho for r in done.validation.collect()} <= {None}


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Adam, Maurer.\n\nBonk, Maurer.\n")
    m = model()
    labeller.listen(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), m).awaitTermination(60)
    streamed = {(r.value, r.json) for r in spark.read.schema("value string, json string").json(str(tmp_path / "out")).collect()}
    batch = {(r.value, r.json) for r in labeller.label_lines(spark.read.text(str(tmp_path / "in")), m).collect()}
    assert streamed == batch and json.loads(next(j for v, j in batch if v.startswith("Adam")))["occupations"] == ["Maurer ."]


def test_label_stream_labels_every_line(spark, tmp_path):
    from ledgerline.plans import driver_queries

    texts = [(1, 0, "Et, le.\nIn the\n\nle, Et."), (1, 1, "In the"), (2, 0, None), (2, 1, "")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in texts], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn, r.line): (r.value, r.json) for r in driver_queries.QUERIES["label_stream"](spark, str(tmp_path)).collect()}
    lines = {(c, t, k): x for c, t, text in texts for k, x in enumerate([None] if text is None else text.split("\n"))}
    assert {k: v for k, (v, _) in got.items()} == lines
    made = [(["START", "Et", ",", "le", ".", "END"], ["START", "N", "D", "O", "O", "END"]), (["START", "In", "the", "END"], ["START", "N", "O", "END"])]
    batch = labeller.label_lines(spark.createDataFrame([(x,) for x in lines.values()], "value string"), labels.train(made))
    assert set(got.values()) == {(r.value, r.json) for r in batch.collect()}
