"""Contiguous shards of nearly equal size from global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import before, numbered, utf8


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, ordered by id, into contiguous shards at equal byte targets.

    Every range partition sums its sizes; prefix sums over these totals (one row per partition)
    give each row its global start. A row goes to the shard whose target interval holds its
    start, so shard sizes differ from the mean by less than the largest document.

    Law ``bytes``. Null text counts as no bytes (size is the overhead), crc32 of no bytes is 0.
    Repeated rows and ids stay separate rows in adjacent slots; null ids come first. Rows with
    equal id are ordered by crc32 and size. An empty table gives no rows. Other columns are ignored.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.length(utf8(text_col)) + overhead).cast("long").alias("size"),
        F.crc32(utf8(text_col)).alias("text_crc32"),
    )
    rows = numbered(sized, ["doc_id", "text_crc32", "size"], "shard")
    in_part = Window.partitionBy("__part").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    starts = before(rows.groupBy("__part").agg(F.sum("size").alias("size")), [], ["size"])
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(1)).alias("__total"))
    # One row per range partition, and one row: both bounded by the number of partitions.
    placed = (
        rows.withColumn("__run", F.coalesce(F.sum("size").over(in_part), F.lit(0)))
        .join(F.broadcast(starts), "__part")
        .join(F.broadcast(total))
        .withColumn("shard", F.floor((F.col("__before_size") + F.col("__run")) * shards / F.col("__total")).cast("int"))
        .withColumn("shard", F.least("shard", F.lit(shards - 1)))
    )
    counts = placed.groupBy("__part", "shard").agg(F.count("*").alias("n"))
    slots = before(counts, ["shard"], ["n"])
    in_shard = Window.partitionBy("__part", "shard").orderBy("__k")
    return (
        placed.withColumn("__i", F.row_number().over(in_shard) - 1)
        .join(F.broadcast(slots), ["__part", "shard"])  # at most partitions + shards rows
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("__before_n") + F.col("__i")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def oracle(shards: int = 40, overhead: int = 16) -> str:
    """The same shards in DuckDB, for unique ids; crc32 byte by byte with its table of 256 entries."""
    half = "if(x & 1 = 1, xor(x >> 1, 3988292384), x >> 1)"
    entry = "i"
    for _ in range(8):
        entry = f"list_transform([{entry}], lambda x: {half})[1]"
    return f"""with crc as (select list_transform(range(256), lambda i: {entry}) as entries),
        bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        sized as (select doc_id, length(h) // 2 + {overhead} as size, xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::bigint)),
            lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) as text_crc32 from bytes, crc),
        placed as (select *, least(floor(cast((sum(size) over (order by doc_id) - size) * {shards} as double) / sum(size) over ()), {shards - 1})::int as shard from sized)
        select doc_id, size::bigint as size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id) - 1 as slot, null::int as grown_shard from placed"""
