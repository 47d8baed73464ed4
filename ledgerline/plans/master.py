"""All steps in their order: from page files to the exported table and the validation against official figures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.labels import Crf
from ..operators.status import retained
from ..sources.pagexml import read_pages
from ..sources.staging import staged
from . import referencing


@dataclass
class Inputs:
    """What a run reads: a folder of page files, a labelling model, tables of addresses, occupation lists, scores, tracts and official top shares."""

    pages: str
    model: Crf
    places: Sequence[DataFrame]
    references: Sequence[DataFrame]
    scores: DataFrame
    tracts: DataFrame
    official: DataFrame
    streets: DataFrame | None = None
    fixes: DataFrame | None = None
    cutoff: float = 0.5
    settings: dict = field(default_factory=dict)


@dataclass
class Results:
    referenced: DataFrame
    exported: DataFrame
    statistics: DataFrame
    shares: DataFrame
    panel: DataFrame
    validation: DataFrame


def run(spark: SparkSession, given: Inputs, export_path: str | None = None, stata_float: bool = False) -> Results:
    """Pages, entries, places, codes, scores and tracts; the export (written to export_path, where given); tract statistics, top shares, their panel and rank correlations.

    The referenced table, which all later steps read, is written once.
    """
    rows = referencing.occupation_table(read_pages(spark, given.pages), given.model, given.streets, given.fixes, **given.settings)
    table = staged(referencing.referenced(staged(rows), given.places, given.references, given.scores, given.tracts, given.cutoff))
    exported = retained(table)
    if export_path:
        exported.write.mode("overwrite").parquet(export_path)
    long = referencing.long_form(table)
    shares = staged(referencing.tract_top_shares(long, stata_float))
    return Results(table, exported, referencing.tract_statistics(long), shares, referencing.share_panel(shares), referencing.validation(shares, given.official))
