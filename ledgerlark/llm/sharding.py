"""Sharding along a Hilbert curve over document metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerlark.llm.common import cut, partitions, text_or_empty

BITS = 8
SHARDS = 8


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``points`` (integers below 2**bits in every column).

    Skilling's transform (2004): undo the rotations from the highest bit down, Gray-encode, interleave bits.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] ^= np.where(high, low, swap)
            x[i] ^= np.where(high, 0, swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def curve(bits: int = BITS):
    """A column function from integer columns to the curve index."""

    @F.pandas_udf(LongType())
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    return index


def category_cell(column: Column, bits: int = BITS) -> Column:
    """A cell for a category: equal values share one; null has the first."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit((1 << bits) - 1)) + 1, F.lit(0)).cast("int")


def size_cell(column: Column, bits: int = BITS) -> Column:
    """A cell for a size on a logarithmic scale; null has the first."""
    top = (1 << bits) - 1
    return F.coalesce(F.least(F.lit(top), F.floor(F.log2(1 + F.greatest(column, F.lit(0))) * top / 40)), F.lit(0)).cast("int")


def hilbert_shards(docs: DataFrame, cells: dict[str, Column], *, shards: int = SHARDS, bits: int = BITS, tie: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` with hilbert, shard and slot: rows in curve order, cut into runs whose counts differ by one at most.

    ``cells`` are the quantised dimensions. Rows are range-partitioned by (curve index, ``tie``) and sorted; the row
    counts of the partitions (one number each) give each row its place in the whole order, from which shard and
    slot (gapless from 0) follow. ``tie`` spreads rows of one cell over partitions. Rows alike in all of that
    take any of their places. With fewer rows than shards the last shards stay empty.
    """
    indexed = docs.withColumn("hilbert", curve(bits)(*cells.values()))
    placed = cut(
        indexed.repartitionByRange(partitions(docs), "hilbert", *tie)
        .sortWithinPartitions("hilbert", *tie)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33).cast("int"))
    )
    counts = sorted((r[0], r[1]) for r in placed.groupBy("_part").count().collect())  # a row per partition
    total, starts = 0, []
    for part, count in counts:
        starts.append((part, total))
        total += count
    spark = docs.sparkSession
    offsets = F.broadcast(spark.createDataFrame(starts, "_part int, _start bigint"))  # as many rows as partitions
    base, more = divmod(total, shards)
    place = F.col("_start") + F.col("_id") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    edge = F.lit((base + 1) * more)  # the first ``more`` shards have one row more
    shard = F.when(F.col("_at") < edge, F.floor(F.col("_at") / F.lit(base + 1))).otherwise(
        F.lit(more) + F.floor((F.col("_at") - edge) / F.lit(max(base, 1)))
    )
    start = F.col("shard") * F.lit(base) + F.least(F.col("shard"), F.lit(more))
    return (
        placed.join(offsets, "_part")
        .withColumn("_at", place)
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("_at") - start).cast("bigint"))
        .drop("_part", "_id", "_start", "_at")
    )


def document_shards(docs: DataFrame, *, shards: int = SHARDS) -> DataFrame:
    """Documents without their texts in Hilbert order of language, source, length and identifier.

    Returns doc_id, lang, source, size, text_crc32, hilbert, shard, slot. Null texts are empty.
    """
    size = F.octet_length(text_or_empty()).cast("bigint") + 1
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", size.alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    cells = {
        "lang": category_cell(F.col("lang")),
        "source": category_cell(F.col("source")),
        "size": size_cell(F.col("size")),
        "doc_id": size_cell(F.col("doc_id")),
    }
    return hilbert_shards(rows, cells, shards=shards, tie=("doc_id", "text_crc32"))
