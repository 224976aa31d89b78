"""Shards along a Hilbert curve over metadata, for file pruning in several dimensions at once.

Source, language, size and doc_id are quantised to a few bits each, the cell is
turned into its index on the Hilbert curve, and the rows are cut into runs of equal
length in that order.  Each run covers a small box of every dimension, so readers
that filter on any of them skip whole files.  Only DataFrame functions are used.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.session import materialize

from .common import ranked

BITS = 5


@functools.cache
def curve(dims: int) -> tuple[list[int], list[int]]:
    """For state * 2**dims + cell of one bit plane: the digit on the curve, and the next state.

    A state is an entry corner and a direction; the rule follows from the Gray code,
    which walks the corners of a cube along its edges.
    """
    size = 1 << dims
    turn = lambda x, k: ((x << k % dims) | (x >> (dims - k % dims))) & (size - 1)
    gray = lambda x: x ^ (x >> 1)
    rank = {gray(w): w for w in range(size)}
    ones = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  trailing ones
    digits, after = [], []
    for entry in range(size):
        for direction in range(dims):
            for cell in range(size):
                w = rank[turn(cell ^ entry, dims - (direction + 1) % dims)]
                corner = 0 if w == 0 else gray(2 * ((w - 1) // 2))
                axis = 0 if w == 0 else ones(w if w % 2 else w - 1) % dims
                digits.append(w)
                after.append((entry ^ turn(corner, direction + 1)) * dims + (direction + axis + 1) % dims)
    return digits, after


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of non-negative integer coordinates below 2**bits."""
    dims = len(coordinates)
    digits, after = curve(dims)

    def plane(state: Column, level: Column) -> Column:
        cell = sum(F.call_function("shiftright", c.cast("int"), level).bitwiseAND(F.lit(1)) * (1 << k) for k, c in enumerate(coordinates))
        at = state["state"] * (1 << dims) + cell
        return F.struct(F.get(F.lit(after), at).alias("state"), (state["index"] * (1 << dims) + F.get(F.lit(digits), at)).alias("index"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, plane)["index"]


def _ordinal(rows: DataFrame, name: str, bits: int) -> DataFrame:
    """Adds the coordinate of a text column: the rank of its value among all values, nulls first."""
    values = ranked(rows.groupBy(name).agg(F.count("*").alias("_n")), [name])
    total = values.count()
    cells = materialize(values.select(F.col(name).alias("_value"), F.floor(F.col("_rank") * (1 << bits) / max(total, 1)).cast("int").alias(f"_{name}_cell")))
    return rows.join(cells, rows[name].eqNullSafe(cells["_value"]), "left").drop("_value")


def shards(docs: DataFrame, count: int = 8, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert of every row.

    Law ``rows``: shards differ by one row at most.  Along the curve rows of one cell
    are in the order of checksum, size and doc_id, so equal texts of a cell are
    neighbours.  Null source, lang or doc_id have the first cell; a null text has size
    1 and a null checksum.  Repeated rows are placed as often; no rows give no rows.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    rows = materialize(docs.select("doc_id", "source", "lang", size.alias("size"), F.crc32("text").alias("text_crc32")))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    cells = (1 << bits) - 1
    # In doubles: the ids of a table may lie further apart than a long can say.
    width = max(float(high or 0) - float(low or 0), 1.0)
    place = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(float(low or 0))) * cells / F.lit(width)), F.lit(0)).cast("int")
    octave = F.least(F.length(F.bin("size")) - 1, F.lit(cells))
    for name in ("source", "lang"):
        rows = _ordinal(rows, name, bits)
    index = hilbert_index([F.col("_source_cell"), F.col("_lang_cell"), octave, place], bits)
    placed = ranked(rows.select("doc_id", "size", "text_crc32", index.alias("hilbert")), ["hilbert", "text_crc32", "size", "doc_id"])
    total = rows.count()
    placed = placed.withColumn("shard", F.expr(f"cast((_rank * {count}) div {max(total, 1)} as int)"))
    first = F.expr(f"(shard * {total}L + {count - 1}) div {count}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_rank") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Writes the documents as one folder per shard, in curve order; needs unique doc_ids."""
    rows = docs.join(placed.select("doc_id", "shard", "slot", "hilbert"), "doc_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def box(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """What each shard covers: rows, bytes and the range of every dimension, for pruning."""
    rows = docs.select("doc_id", "source", "lang").join(placed.select("doc_id", "shard", "size"), "doc_id")
    ranges = [f(c).alias(f"{n}_{c}") for c in ("source", "lang", "size", "doc_id") for n, f in (("least", F.min), ("most", F.max))]
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges)
