"""Interval joins whose cost follows the size of their result.

No join here compares all rows of a recording or of a time bucket with each
other.  Points are numbered inside a chunk, a range finds the numbers of its
first and last point with one ordered pass, and only real partners are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import CHUNK, slot

BY = ("rec_id",)

#: Points that travel as one row to the ranges that hold some of them.
PACK = 256


def stab(
    ranges: DataFrame,
    points: DataFrame,
    at: str,
    lo: str,
    hi: str,
    by: Sequence[str] = BY,
    chunk=CHUNK,
    lo_open: bool = False,
    hi_open: bool = False,
) -> DataFrame:
    """Pairs ``(range, point)`` with ``lo <= at <= hi`` (open ends on request).

    Rows of both sides need orderable columns.  Copies of a range are kept.
    Points of a chunk are packed in the order of their numbers, a range is sent once
    per pack, and pairs are made after the join: no pair is shuffled.
    """
    by = list(by)
    numbered = points.select(*by, slot(F.col(at), chunk).alias("_ck"), F.col(at).alias("_t"), F.struct(*points.columns).alias("point"))
    inside = Window.partitionBy(*by, "_ck")
    numbered = numbered.withColumn("_i", F.row_number().over(inside.orderBy("_t", "point")).cast("long"))
    spread = (
        ranges.where(F.col(hi) >= F.col(lo))
        .select(*by, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.struct(*ranges.columns).alias("range"))
        .groupBy(*by, "_lo", "_hi", "range")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_ck", F.explode(F.sequence(slot(F.col("_lo"), chunk), slot(F.col("_hi"), chunk))))
    )
    # Order at equal time: probes that exclude the points, points, probes that include them.
    low = F.struct(F.col("_lo").alias("t"), F.lit(2 if lo_open else 0).alias("o"), F.lit(True).alias("low"))
    high = F.struct(F.col("_hi").alias("t"), F.lit(0 if hi_open else 2).alias("o"), F.lit(False).alias("low"))
    probes = spread.select(*by, "_ck", "range", "_copies", F.explode(F.array(low, high)).alias("_p"))
    probes = probes.select(*by, "_ck", "range", "_copies", F.col("_p.t").alias("_t"), F.col("_p.o").alias("_o"), F.col("_p.low").alias("_low"))
    marks = numbered.select(
        *by,
        "_ck",
        F.lit(None).cast(probes.schema["range"].dataType).alias("range"),
        F.lit(None).cast("long").alias("_copies"),
        "_t",
        F.lit(1).alias("_o"),
        F.lit(None).cast("boolean").alias("_low"),
    )
    seen = F.count(F.when(F.col("_o") == 1, 1)).over(
        inside.orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    )
    counted = probes.unionByName(marks).withColumn("_seen", seen).where(F.col("_o") != 1)
    spans = counted.groupBy(*by, "_ck", "range", "_copies").agg(
        F.max(F.when(F.col("_low"), F.col("_seen"))).alias("_from"),
        F.max(F.when(~F.col("_low"), F.col("_seen"))).alias("_to"),
    )
    pack = lambda n: F.floor((n - 1) / PACK).cast("long")
    packs = numbered.groupBy(*by, "_ck", pack(F.col("_i")).alias("_p")).agg(F.sort_array(F.collect_list(F.struct("_i", "point"))).alias("_points"))
    wanted = spans.where(F.col("_to") > F.col("_from")).withColumn(
        "_p", F.explode(F.sequence(pack(F.col("_from") + 1), pack(F.col("_to"))))
    )
    # Points of a pack have consecutive numbers, so a range holds a slice of it.
    first = F.greatest(F.col("_from") - F.col("_p") * PACK + 1, F.lit(1)).cast("int")
    last = F.least(F.col("_to") - F.col("_p") * PACK, F.lit(PACK)).cast("int")
    pairs = wanted.join(packs, by + ["_ck", "_p"]).select(*by, "range", "_copies", F.explode(F.slice("_points", first, last - first + 1)).alias("_x"))
    pairs = pairs.select(*by, "range", "_copies", F.col("_x.point").alias("point"))
    return pairs.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*by, "range", "point")


def range_join(left: DataFrame, right: DataFrame, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """All pairs ``(l, r)`` of rows that overlap by a positive length.

    Either the right row begins inside the left one, or the left row begins
    after the begin of the right one and before its end: the two cases are
    disjoint and together complete.
    """
    by = list(by)
    solid = F.col("end") > F.col("start")
    left, right = left.where(solid), right.where(solid)
    ahead = stab(left, right, "start", "start", "end", by, chunk, hi_open=True)
    behind = stab(right, left, "start", "start", "end", by, chunk, lo_open=True, hi_open=True)
    return ahead.select(*by, F.col("range").alias("l"), F.col("point").alias("r")).unionByName(
        behind.select(*by, F.col("point").alias("l"), F.col("range").alias("r"))
    )


def covering(
    points: DataFrame,
    spans: DataFrame,
    at: str,
    slack=0,
    by: Sequence[str] = BY,
    chunk=CHUNK,
    reach: bool = False,
) -> DataFrame:
    """As-of lookup of the last span with ``start <= at + slack``.

    A span is offered to every chunk it touches, so a point sees each span that
    can still be open; spans that ended before the chunk of the point give NULL.
    Adds ``span`` (the row) or, with ``reach``, the largest end among the spans
    begun so far.
    """
    by = list(by)
    margin = F.lit(slack)
    offered = spans.where(F.col("end") > F.col("start")).withColumn(
        "_slot_", F.explode(F.sequence(slot(F.col("start") - margin, chunk), slot(F.col("end") + margin, chunk)))
    )
    offered = offered.select(*by, "_slot_", (F.col("start") - margin).alias("_when_"), F.lit(0).alias("_probe_"), F.struct(*spans.columns).alias("_span_"))
    asked = points.withColumn("_slot_", slot(F.col(at), chunk)).withColumn("_when_", F.col(at)).withColumn("_probe_", F.lit(1))
    rows = asked.unionByName(offered, allowMissingColumns=True)
    # Spans with equal start: the longest comes last.
    upto = Window.partitionBy(*by, "_slot_").orderBy("_when_", "_probe_", "_span_.end").rowsBetween(Window.unboundedPreceding, 0)
    value = F.max("_span_.end").over(upto).alias("reach") if reach else F.last("_span_", ignorenulls=True).over(upto).alias("_found_")
    found = rows.select(*[F.col(c) for c in points.columns], "_probe_", value).where(F.col("_probe_") == 1).drop("_probe_")
    return found if reach else found.withColumnRenamed("_found_", "span")
