"""Page-layout XML to lines, and back to ground-truth files."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES = "page_file string, col_idx int, line_idx int, content string, coords string"


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def children(node: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in node.iter() if c is not node and local(c.tag) == name]


def parse_page(xml: bytes) -> list[tuple[int, int, str, str]]:
    """(column, line, content, coords) of a page. Tags are found in any case and namespace, at any depth.

    Columns are the text regions in reading order: the numbers N of references rN, ranked, point at the regions.
    A line's text is its alternative of index 0, else of index 1, else the first; a missing text is ''.
    """
    root = ET.fromstring(xml)
    regions = children(root, "textregion")
    refs = sorted({int(m[1]) for r in children(root, "regionrefindexed") for k, v in r.attrib.items() if local(k) == "regionref" and (m := re.fullmatch(r"r(\d+)", v or ""))})
    refs_in_order = [int(m[1]) for r in children(root, "regionrefindexed") for k, v in r.attrib.items() if local(k) == "regionref" and (m := re.fullmatch(r"r(\d+)", v or ""))]
    rank = {n: k for k, n in enumerate(refs)}
    order = [rank[n] for n in refs_in_order if rank[n] < len(regions)] or list(range(len(regions)))
    out = []
    for c, k in enumerate(order):
        for n, line in enumerate(children(regions[k], "textline")):
            coords = next((x.attrib.get("points", "") for x in children(line, "coords")), "")
            texts = children(line, "textequiv")
            chosen = next((t for i in ("0", "1") for t in texts if t.attrib.get("index") == i), texts[0] if texts else None)
            text = next((u.text for u in children(chosen, "unicode")), None) if chosen is not None else None
            out.append((c, n, text or "", coords))
    return out


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all pages of a folder; pages are numbered by file name, those without lines too."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path).select(F.element_at(F.split("path", "/"), -1).alias("page_file"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, *r) for f, xml in zip(b["page_file"], b["content"], strict=True) for r in parse_page(xml)], columns=["page_file", "col_idx", "line_idx", "content", "coords"])

    lines = files.mapInPandas(parse, LINES)
    # One row per page, from the listing: contents are read for the lines alone.
    names = files.select("page_file").distinct().withColumn("page_idx", F.row_number().over(Window.orderBy("page_file")) - 1)
    return lines.join(names, "page_file").select("page_idx", "col_idx", "line_idx", "content", "coords", "page_file")


def ground_truth(lines: DataFrame) -> DataFrame:
    """(line, pos, token): START, the tokens and END of every line, in page order: what a labelled training file is made from."""
    from ..functions.text import truth_tokens

    tokens = F.concat(F.array(F.lit("START")), truth_tokens("content"), F.array(F.lit("END")))
    return lines.select(F.struct("page_idx", "col_idx", "line_idx").alias("line"), F.posexplode(tokens).alias("pos", "token"))


def write_ground_truth(lines: DataFrame, page_idx: int, path: str) -> None:
    """A page's tokens as one quoted CSV (sentence, token, label), to be labelled by hand: START and END have their labels, the others none."""
    rows = ground_truth(lines.filter(F.col("page_idx") == page_idx))
    last = F.max("pos").over(Window.partitionBy("line"))
    numbered = rows.select(F.dense_rank().over(Window.orderBy("line")).alias("sentence"), "pos", "token", last.alias("last"))  # one page
    label = F.when(F.col("pos") == 0, "START").when(F.col("pos") == F.col("last"), "END")
    numbered.orderBy("sentence", "pos").select("sentence", "token", label.alias("label")).coalesce(1).write.csv(path, quoteAll=True, nullValue="")


def line_texts(lines: DataFrame) -> DataFrame:
    """(page_file, col_idx, line_idx, text, x0, y0, x1, y1): each line's text for a recognizer's training, with the box to cut from the page's image."""
    from ..functions.geometry import points

    p = points("coords")
    side = lambda f, c: f(F.transform(p, lambda q: q[c]))
    return lines.select("page_file", "col_idx", "line_idx", F.replace(F.col("content"), F.lit("\ueedc"), F.lit("ß")).alias("text"), side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))


def image_urls(spark: SparkSession, template: str, first: int, last: int, digits: int = 8) -> DataFrame:
    """(page, url) of page images; template holds %s for the padded number."""
    pages = spark.range(first, last + 1).withColumnRenamed("id", "page")
    return pages.select("page", F.replace(F.lit(template), F.lit("%s"), F.lpad(F.col("page").cast("string"), digits, "0")).alias("url"))
