"""Occupations to codes and status scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import html_codes, latin_escape, pad_code, strip_code
from .match import first_of, looked_up, lookup, match_codes


def score_table(rows: DataFrame, code: str = "HISCO", score: str = "HISCAM") -> DataFrame:
    """(hisco, hiscam) with codes of five digits."""
    return rows.select(pad_code(F.col(code).cast("string")).alias("hisco"), F.col(score).cast("double").alias("hiscam"))


def coded(df: DataFrame, reference: DataFrame, name: str, cutoff: float = 1.0) -> DataFrame:
    """Adds ``name``: the hisco of the occupation's best match in reference (occupation, hisco, row_idx)."""
    return match_codes(df, "occupation", reference, "occupation", ["hisco"], "row_idx", cutoff).withColumnRenamed("hisco", name)


def scored(df: DataFrame, scores: DataFrame, code: str, name: str) -> DataFrame:
    """Adds ``name``: the score of the code without its ``*``; NULL for unknown codes."""
    table = scores.select(F.col("hisco").alias("__code"), F.col("hiscam").alias(name))
    return lookup(df.withColumn("__code", strip_code(code)), table, "__code").drop("__code")


def modal_code(df: DataFrame, key: str, code: str) -> DataFrame:
    """The most frequent code of each key; of equally frequent ones the smallest."""
    return df.groupBy(key).agg(F.mode(code, True).alias(code))


def codes_online(df: DataFrame, key: str, client: Callable[[str], str | None], name: str = "hisco", attempts: int = 3, metrics: Observation | None = None) -> DataFrame:
    """Adds ``name``: the most frequent five-digit cell of the page that a service returns for the occupation, of equally frequent ones the smallest.

    The question has a Latin-1 web form's escapes. client: question -> page or None. NULL without an answer or a code in it. metrics: see external_lookup.
    """
    pages = looked_up(df.select(key).distinct(), key, latin_escape, lambda q: (p,) if (p := client(q)) is not None else None, "__page string", attempts, metrics)
    codes = pages.select(F.col(key).alias("__of"), F.explode(html_codes("__page")).alias(name))
    return df.join(modal_code(codes, "__of", name), F.col(key) == F.col("__of"), "left").drop("__of")


def retained(df: DataFrame, methods: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """The columns a referenced table keeps."""
    return df.select(*(f"{c}_{m}" for c in ("hiscam", "x", "y", "sb") for m in methods))


__all__ = ["coded", "codes_online", "first_of", "modal_code", "retained", "score_table", "scored"]
