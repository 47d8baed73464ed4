"""Readers and writers of tables: delimited files, vector layers, workbooks, statistics files."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from ..operators.labels import sentences
from ..operators.status import score_table


def read_training(spark: SparkSession, path: str, rows_to_ignore: int = 0) -> DataFrame:
    """(sentence_no, tokens, labels) of a headerless file sentence_no,token,label; the first rows_to_ignore rows are left out."""
    rows = spark.read.csv(path, schema="sentence_no int, token string, label string", quote='"', escape='"')
    # Files are small and in order; the place within the file orders a sentence's tokens.
    rows = rows.coalesce(1).withColumn("pos", F.monotonically_increasing_id())
    return sentences(rows.filter(F.col("pos") >= rows_to_ignore))


def read_occupations(spark: SparkSession, path: str) -> DataFrame:
    """(occupation, hisco, row_idx), codes as text so that leading zeros stay."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    return rows.coalesce(1).select("occupation", "hisco", F.monotonically_increasing_id().alias("row_idx"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return score_table(spark.read.csv(path, header=True, schema="HISCO string, HISCAM double"))


def read_delimited(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet whose first row names the columns; needs a workbook library beside pandas."""
    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """A Stata file, whole on the driver: such files are small."""
    return spark.createDataFrame(pd.read_stata(path))


def write_statistics(df: DataFrame, path: str, limit: int = 5_000_000) -> None:
    """A Stata file of at most ``limit`` rows; more raise, for they belong in Parquet."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows; write Parquet")
    df.toPandas().to_stata(path, write_index=False)


def wkb_rings(blob: bytes) -> list[list[tuple[float, float]]]:
    """The first ring, line or point of each part of a well-known binary geometry, or of a GeoPackage one around it."""
    if blob[:2] == b"GP":
        blob = blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7] :]
    out: list[list[tuple[float, float]]] = []

    def read(at: int) -> int:
        order = "<" if blob[at] else ">"
        (kind,) = struct.unpack_from(order + "I", blob, at + 1)
        at, dims = at + 5, 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)

        def points(n: int, at: int) -> tuple[list[tuple[float, float]], int]:
            return [struct.unpack_from(order + "dd", blob, at + 8 * dims * k) for k in range(n)], at + 8 * dims * n

        match kind % 1000:
            case 1:
                p, at = points(1, at)
                out.append(p)
            case 2:
                p, at = points(struct.unpack_from(order + "I", blob, at)[0], at + 4)
                out.append(p)
            case 3:
                rings, at = struct.unpack_from(order + "I", blob, at)[0], at + 4
                for k in range(rings):
                    p, at = points(struct.unpack_from(order + "I", blob, at)[0], at + 4)
                    if k == 0:
                        out.append(p[:-1] if len(p) > 1 and p[0] == p[-1] else p)
            case _:
                parts, at = struct.unpack_from(order + "I", blob, at)[0], at + 4
                for _ in range(parts):
                    at = read(at)
        return at

    read(0)
    return out


class GeoPackage(DataSource):
    """spark.read.format("geopackage").option("layer", name).load(path): the attributes as text, and ring ARRAY<STRUCT<x, y>>, row_idx.

    One row per feature with the first part of its geometry. The file must be where the reader runs.
    """

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def columns(self) -> tuple[str, str, list[str]]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            layer = self.options.get("layer") or db.execute("select table_name from gpkg_contents where data_type = 'features'").fetchone()[0]
            (shape,) = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()
            names = [r[1] for r in db.execute(f'pragma table_info("{layer}")') if r[1] != shape]
        return layer, shape, names

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self.columns()[2]) + ", ring array<struct<x: double, y: double>>, row_idx bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeoPackageReader(self.options["path"], *self.columns())


class GeoPackageReader(DataSourceReader):
    def __init__(self, path: str, layer: str, shape: str, names: Sequence[str]) -> None:
        self.path, self.layer, self.shape, self.names = path, layer, shape, names

    def read(self, partition) -> Iterator[tuple]:  # noqa: ANN001
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            cols = ", ".join(f'cast("{c}" as text)' for c in self.names)
            for k, row in enumerate(db.execute(f'select {cols}, "{self.shape}" from "{self.layer}" order by rowid')):
                parts = wkb_rings(row[-1]) if row[-1] else []
                yield (*row[:-1], parts[0] if parts else None, k)


def read_layer(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    spark.dataSource.register(GeoPackage)
    reader = spark.read.format("geopackage")
    return (reader.option("layer", layer) if layer else reader).load(path)
