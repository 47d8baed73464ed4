"""Quality rules whose cutoffs come with an exact bound on the good documents they reject."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binomial import upper_bound
from .common import materialize

SYMBOLS = b"#*$%&|<>"
STATS = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: Rule: what it measures, as SQL over the statistics, and its scale. Higher is worse; each may be cut at any of steps(GRID) of its scale.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 1.0),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 1.0),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 1.0),
}
GRID, FINEST = 64, 1e-4


def steps(grid: int) -> np.ndarray:
    """Cutoffs as parts of a scale: 0, then in equal ratios from FINEST to just under 1, as most measures lie near 0. They don't depend on the data."""
    return np.concatenate(([0.0], FINEST ** (1 - np.arange(1, grid) / grid)))


def text_stats(text: str | None, window: int = 8) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a whole text.

    Words are runs of anything but ASCII white space. Lines count if they hold a word.
    n_repeat_words counts the words that lie in a window of 8 words found twice or more.
    """
    if not text:
        return (0,) * 6
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r")))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > window:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
        if len(seen) < n:
            # Pair numbers up to windows of 2, 4, 8: equal numbers exactly for equal windows.
            width = 1
            while width < window and len(ids) - width > 0:
                pair = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
                ids = np.unique(pair, return_inverse=True)[1]
                width *= 2
            again = np.flatnonzero(np.bincount(ids)[ids] > 1)
            if len(again):
                mark = np.zeros(n + 1, np.int64)
                np.add.at(mark, again, 1)
                np.add.at(mark, again + window, -1)
                repeated = int((np.cumsum(mark)[:n] > 0).sum())
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row of STATS for each document; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(text_stats, b.column(2).to_pylist()), strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)], names=[f.split()[0] for f in STATS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("text")).mapInArrow(run, STATS)


def cuts_below(measure: Column, cuts: np.ndarray) -> Column:
    """How many of the cuts reject the measure."""
    return F.size(F.filter(F.array(*map(F.lit, cuts.tolist())), lambda c: measure > c))


def cutoffs(labelled: DataFrame, alpha: float = 0.02, delta: float = 0.05, grid: int = GRID) -> DataFrame:
    """(stratum, rule, cutoff, n_good, false_rejects, bound): the certified cutoff of each rule and stratum.

    labelled: STATS of a holdout with ``good``. For each stratum and rule the cutoffs are tried from the loosest to
    ever stricter ones, up to the first whose Clopper-Pearson bound on the good documents above it passes
    alpha / rules (fixed-sequence testing, which needs no further correction within the
    sequence). The level is delta / (rules * strata), Bonferroni's correction over the sequences, so
    with probability 1 - delta all strata together keep their false rejections to alpha. Among the
    certified cutoffs the loosest that rejects the most bad documents is taken. No row where
    none is certified or none rejects anything bad.
    """
    rules = list(RULES)
    long = labelled.select(
        "stratum", "good",
        F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), cuts_below(F.expr(RULES[r][0]), RULES[r][1] * steps(grid)).alias("bin")) for r in rules))).alias("x"),
    ).select("stratum", "x.rule", "x.bin", "good")
    bins = long.groupBy("stratum", "rule", "bin").agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("*").alias("n"))
    strata = labelled.agg(F.greatest(F.count_distinct(F.coalesce("stratum", F.lit("\0"))), F.lit(1)).alias("strata"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:  # at most grid + 1 rows
        good, bad = np.zeros(grid + 1), np.zeros(grid + 1)
        np.add.at(good, pdf["bin"].to_numpy(int), pdf["good"].to_numpy(float))
        np.add.at(bad, pdf["bin"].to_numpy(int), (pdf["n"] - pdf["good"]).to_numpy(float))
        above, caught = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
        k = np.arange(grid - 1, -1, -1)  # cutoff k rejects the bins above k
        bound = upper_bound(above[k + 1], np.full(grid, good.sum()), delta / (len(rules) * float(pdf["strata"].iloc[0])))
        passed = int(np.argmin(np.append(bound <= alpha / len(rules), False)))
        rows = []
        if passed and caught[k[passed - 1] + 1] > 0:
            i = int(np.argmax(caught[k[:passed] + 1]))
            rule = pdf["rule"].iloc[0]
            rows.append((pdf["stratum"].iloc[0], rule, steps(grid)[k[i]] * RULES[rule][1], int(good.sum()), int(above[k[i] + 1]), float(bound[i])))
        return pd.DataFrame(rows, columns=["stratum", "rule", "cutoff", "n_good", "false_rejects", "bound"])

    return bins.join(F.broadcast(strata)).groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cutoff double, n_good long, false_rejects long, bound double")  # strata is one row


def judge(
    docs: DataFrame,
    labels: DataFrame,
    alpha: float = 0.02,
    delta: float = 0.05,
    stratum_col: str = "lang",
    id_col: str = "doc_id",
) -> DataFrame:
    """Statistics, base rules and certified rules of every document.

    labels: (doc_id, quality 1 good / 0 bad). The rules' measures are fixed, so all labelled documents that
    pass the base rules are the holdout. Null labels and ids don't count; of several labels of a document the lowest holds.
    Base rules: fewer than 20 words, or more than 30 % repeated words. kept is false if they or a certified cutoff of the
    document's stratum reject it. Strata with too few labels get no cutoff, so nothing more is rejected there.
    Null text has no words; a null stratum is one of its own; repeated rows are judged alike; an empty table gives no rows.
    """
    stats = materialize(statistics(docs, id_col=id_col, stratum_col=stratum_col), "quality").withColumn(
        "base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    )
    truth = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    found = cutoffs(stats.filter("not base_failed").join(truth, "doc_id"), alpha, delta)
    wide = found.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))
    wide = materialize(wide.withColumnRenamed("stratum", "__stratum"), "cutoffs")
    rejected = F.lit(False)
    for r, (measure, _) in RULES.items():
        rejected = rejected | F.coalesce(F.expr(f"{measure} > cut_{r}"), F.lit(False))
    return stats.join(wide, F.col("stratum").eqNullSafe(F.col("__stratum")), "left").withColumn("kept", ~F.col("base_failed") & ~rejected).drop("__stratum")
