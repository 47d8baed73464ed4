"""Language of web pages by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .urls import domain_of, host_of, suffix_of

BINS = 1 << 15
#: Elements whose content is not shown, and the language that an html tag declares.
HIDDEN = re.compile(r"<(script|style|template|noscript)\b", re.ASCII)
ENDS = {name: re.compile(rf"</{name}[ \t\n\x0b\f\r]*>") for name in ("script", "style", "template", "noscript")}
DECLARED = re.compile(r"[ \t\n\x0b\f\r]lang[ \t\n\x0b\f\r]*=[ \t\n\x0b\f\r]*[\"']?([a-z]{2,3})")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trigrams(text: str | None) -> np.ndarray:
    """A bin of each character trigram of the lower-cased text; runs of anything but letters are one space."""
    if not text:
        return np.empty(0, np.int64)
    line = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    g = (c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (g >> np.uint64(49)).astype(np.int64)


def visible(html: str | None) -> str:
    """The text a reader sees, roughly: without scripts, styles, comments and tags.

    One pass in linear time: what has no end is looked for once only. An element or comment without end is taken as a tag, a tag without end as text.
    """
    if not html:
        return ""
    low, out, at, endless = html.translate(LOWER), [], 0, set()
    while (i := html.find("<", at)) >= 0:
        out.append(html[at:i])
        end = -1
        if html.startswith("<!--", i):
            if "" not in endless and (end := html.find("-->", i + 4)) < 0:
                endless.add("")
            end += 3 if end >= 0 else 0
        elif (m := HIDDEN.match(low, i)) and m[1] not in endless:
            if close := ENDS[m[1]].search(low, m.end()):
                end = close.end()
            else:
                endless.add(m[1])
        if end < 0:
            end = html.find(">", i) + 1
            if not end:
                at = i
                break
        out.append(" ")
        at = end
    return "".join([*out, html[at:]])


def declared(html: str | None) -> str | None:
    """The first language that an html tag declares, two or three letters in lower case; '' where none does, null for null."""
    if html is None:
        return None
    low, at = html.translate(LOWER), 0
    while (i := low.find("<html", at)) >= 0:
        end = low.find(">", i)
        if m := DECLARED.search(low, i + 5, end if end >= 0 else len(low)):
            return m[1]
        if end < 0:
            break
        at = end
    return ""


@dataclass
class TextModel:
    """log P(trigram bin | language) of every language: what a bin not seen has, and by bin what the languages that have it add."""

    names: list[str]
    unseen: np.ndarray  # languages
    start: np.ndarray  # bins + 1: where each bin's entries begin
    whose: np.ndarray  # entries: the language
    more: np.ndarray  # entries: log P less the unseen bin's

    def likely(self, grams: np.ndarray) -> np.ndarray:
        """The log-likelihood of a text's trigrams under each language."""
        first, n = self.start[grams], self.start[grams + 1] - self.start[grams]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return len(grams) * self.unseen + np.bincount(self.whose[at], self.more[at], len(self.names))


def text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """The model of every language in docs from all its documents, counted by grouped aggregation.

    One number for each language and each bin seen in it comes to the driver, and goes to the tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in held:
                    held[lang] = np.zeros(BINS, np.int64)
                held[lang] += np.bincount(trigrams(text), minlength=BINS)
            if len(held) > 256:
                yield from rows(held)
                held = {}
        yield from rows(held)

    def rows(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(c[some])], names=["lang", "bin", "n"])

    known = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    counts = known.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    whose = pc.index_in(counts["lang"], pa.array(names, pa.string())).to_numpy()
    bins, n = counts["bin"].to_numpy(), counts["n"].to_numpy()
    unseen = np.log(0.5) - np.log(np.bincount(whose, n, len(names)) + 0.5 * BINS)
    order = np.lexsort((whose, bins))
    start = np.concatenate([[0], np.cumsum(np.bincount(bins, minlength=BINS))])
    return TextModel(names, unseen, start, whose[order].astype(np.int32), np.log(2.0 * n[order] + 1).astype(np.float32))


def identify(
    pages: DataFrame,
    docs: DataFrame,
    per_gram: float = 0.25,
    kappas: tuple[float, float, float] = (50.0, 20.0, 10.0),
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """page_id, host, declared, n_grams, text_lang, lang and posterior of every page.

    log P(lang | page) adds up
    - per_gram times the log-likelihood of the visible text's trigrams (neighbouring trigrams overlap, hence the factor),
    - log P(declared | lang): how often other pages whose text looks like lang declare this; half a page is added to each
      declared value, the ones never seen with lang too,
    - log P(lang | host): the languages of texts of the host's other pages, shrunk to those of its registered domain, those to its suffix and
      those to all pages, all counted by grouped aggregation and less the page itself.
    So a page with much text is judged by it, one with little by what it declares and where it lies.

    docs: (lang, text), the text model. Null html has no text and declares nothing; a null url has the host ''.
    Without any language in docs lang is null. Repeated rows are judged alike; an empty table gives no rows.
    """
    model = text_model(docs)
    names = model.names
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    if not names:
        return rows.select("page_id", "host", F.lit(None).cast("string").alias("declared"), F.lit(0).cast("long").alias("n_grams"), *(F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")), F.lit(None).cast("double").alias("posterior"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.slice(k, 256)
                pages_ = part.column(2).to_pylist()
                grams = [trigrams(visible(h)) for h in pages_]
                likely = [model.likely(g).tolist() for g in grams]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(map(declared, pages_), pa.string()), pa.array([len(g) for g in grams], pa.int64()), pa.array(likely, pa.list_(pa.float64()))], names=["page_id", "host", "declared", "n_grams", "likely"])

    n, langs = len(names), F.array(*map(F.lit, names))
    scored = materialize(rows.mapInArrow(score, "page_id long, host string, declared string, n_grams long, likely array<double>"), "language")
    top = F.when(F.col("n_grams") > 0, F.array_position("likely", F.array_max("likely")).cast("int"))
    scored = scored.withColumn("top", top)
    looks = scored.filter("top is not null").withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    # Vectors over the languages are made of the pairs that occur, so that the plan is the same for any number of them.
    each = lambda f: F.transform(F.sequence(F.lit(1), F.lit(n)), f)
    pairs = lambda value: F.map_from_entries(F.collect_list(F.struct("top", F.col(value).cast("double")))).alias("m")
    per_host = materialize(looks.groupBy("suffix", "domain", "host", "top").agg(F.count("*").alias("seen")), "hosts")

    def counts(keys: Sequence[str], name: str) -> DataFrame:
        totals = per_host.groupBy(*keys, "top").agg(F.sum("seen").alias("seen")).groupBy(*keys).agg(pairs("seen"))
        return totals.select(*keys, each(lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias(name))

    everywhere = F.broadcast(counts([], "c0"))  # one row
    hosts = counts(["suffix", "domain", "host"], "c3").join(counts(["suffix", "domain"], "c2"), ["suffix", "domain"]).join(counts(["suffix"], "c1"), "suffix")
    # What pages of each language declare: declared values are short codes, the table is languages times these.
    said = looks.groupBy("declared", "top").agg(F.count("*").alias("seen"))
    values = F.broadcast(said.agg((F.count_distinct(F.coalesce("declared", F.lit("-"))) + 1).alias("values")))  # one row
    says = said.groupBy("declared").agg(pairs("seen")).select(F.col("declared").alias("__declared"), each(lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("said"))
    zero = F.array_repeat(F.lit(0.0), n)
    own = each(lambda k: F.when(F.col("top") == k, 1.0).otherwise(0.0))
    less = lambda c: F.zip_with(F.coalesce(c, zero), "own", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)

    def shrunk(df: DataFrame, c: str, parent: str, kappa: float, name: str) -> DataFrame:
        """(count + kappa * the parent's probability) / (all + kappa)."""
        df = df.withColumn(c, less(F.col(c))).withColumn("__all", total(c))
        return df.withColumn(name, F.zip_with(c, parent, lambda x, p: (x + kappa * p) / (F.col("__all") + kappa)))

    known = scored.join(hosts.drop("suffix", "domain"), "host", "left").join(says, F.col("declared").eqNullSafe(F.col("__declared")), "left").join(everywhere).join(values)
    known = known.withColumn("own", own).withColumn("uniform", F.array_repeat(F.lit(1.0 / n), n))
    known = shrunk(known, "c0", "uniform", float(n), "p0")  # c0 is less the page itself from here on
    for k, kappa in enumerate(kappas, 1):
        known = shrunk(known, f"c{k}", f"p{k - 1}", kappa, f"p{k}")
    known = known.withColumn("says", F.zip_with(less(F.col("said")), "c0", lambda x, t: (x + 0.5) / (t + 0.5 * F.col("values"))))
    joined = (
        known.withColumn("logs", F.transform(F.arrays_zip("likely", F.col("p3").alias("prior"), "says"), lambda x: per_gram * x["likely"] + F.ln(x["prior"]) + F.ln(x["says"])))
        .withColumn("best", F.array_max("logs"))
        .withColumn("whole", F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best"))))
    )
    return joined.select(
        "page_id", "host", "declared", "n_grams",
        F.when(F.col("top").isNotNull(), F.element_at(langs, F.col("top"))).alias("text_lang"),
        F.element_at(langs, F.array_position("logs", F.col("best")).cast("int")).alias("lang"),
        F.round(1 / F.col("whole"), 9).alias("posterior"),
    )
