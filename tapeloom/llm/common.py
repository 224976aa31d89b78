"""What several corpus operators share: words, stored tables, spread ranks and local components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
#: Longer texts are cut into words piece by piece, so that a task never holds all of them as objects.
PIECE = 1 << 21
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def word_lists(text: bytes | None, overlap: int = 0) -> Iterator[list[bytes]]:
    """Words of a text with A-Z in lower case; long texts in several lists that share ``overlap`` words."""
    if not text:
        return
    if len(text) <= PIECE:
        yield text.lower().split()
        return
    held: list[bytes] = []
    for match in _WORD.finditer(text):
        held.append(match.group().lower())
        if len(held) == 200_000 + overlap:
            yield held
            held = held[len(held) - overlap :]
    if held:
        yield held


def in_slices(batch, rows: int) -> Iterator:
    """Slices of an Arrow batch."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def word_count(text: Column) -> Column:
    """Number of words, without building them: zero for null and for blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def spread_offsets(df: DataFrame, by: list[str], order: list[Column], size: Column, salts: int) -> DataFrame:
    """Adds ``_start``: the summed ``size`` of the rows before a row in its group, no group in one task.

    The columns of ``by`` must not be null.

    The order of a group is (bucket, order), where the bucket is a hash of the
    order.  Sums of the buckets give the start of each; only rows of one bucket
    are put in order by one task.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")).withColumn("_size", size)
    sums = bucketed.groupBy(*by, "_bucket").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    joined = placed.join(starts, [*by, "_bucket"])
    return joined.select(*df.columns, (F.col("_inside") + F.col("_first")).alias("_start"))


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_rank`` from 0 in the order of the columns; range-partitioned, so no task sees all rows.

    Rows that are equal in all of ``order`` are ranked in any order.  The sorted rows
    are stored: a lost executor can't change the place of rows already counted.
    """
    dealt = df.repartitionByRange(shuffle_partitions(df), *order).sortWithinPartitions(*order)
    stored = materialize(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = materialize(counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first")))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn("_part", part).join(starts, "_part").withColumn("_rank", inside + F.col("_first")).drop("_id", "_part", "_first")


def hook(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Joins the sets of ``left`` and ``right`` in place; a root is the smallest member of its set."""
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
