"""Ordered scans that do not put a whole recording into one task.

A plain ``Window.partitionBy(rec_id)`` sends every row of a recording to one
task.  Here a recording is cut into time chunks, each chunk is scanned on its
own, and only one summary row per chunk is scanned across the recording.  The
summary is joined back, which makes the result identical to the plain window.

Order expressions are ascending and must be total where ties would matter.
Keys and the chunked column must not be NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

CHUNK = 600.0


def slot(value: Column, chunk) -> Column:
    return F.floor(value / F.lit(chunk)).cast("long")


def _ordering(order) -> Column:
    return F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])


def _total(kind: str, value: Column, order) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    if kind == "min":
        return F.min(value)
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), _ordering(order)))
    raise ValueError(f"unknown scan {kind}")


def _over(kind: str, value: Column, window) -> Column:
    if kind == "sum":
        return F.sum(value).over(window)
    if kind == "max":
        return F.max(value).over(window)
    if kind == "min":
        return F.min(value).over(window)
    return F.last(value, ignorenulls=True).over(window)


def _joined(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried + local, local, carried)
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def running(
    df: DataFrame,
    scans: dict[str, tuple[str, Column]],
    order: Sequence[str],
    by: Sequence[str] = ("rec_id",),
    chunk=CHUNK,
    inclusive: bool = False,
) -> DataFrame:
    """Running sum, max, min or last non-NULL value over all earlier rows.

    ``order[0]`` is the clock that is cut into chunks.  With ``inclusive`` the
    current row takes part.
    """
    by, order = list(by), list(order)
    keyed = df.withColumn("_ck", slot(F.col(order[0]), chunk))
    stop = 0 if inclusive else -1
    local = Window.partitionBy(*by, "_ck").orderBy(*order).rowsBetween(Window.unboundedPreceding, stop)
    across = Window.partitionBy(*by).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*by, "_ck").agg(*[_total(k, v, order).alias(n) for n, (k, v) in scans.items()])
    carried = totals.select(*by, "_ck", *[_over(k, F.col(n), across).alias(f"_c_{n}") for n, (k, _) in scans.items()])
    scanned = keyed.select("*", *[_over(k, v, local).alias(f"_l_{n}") for n, (k, v) in scans.items()])
    joined = scanned.join(carried, by + ["_ck"])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_joined(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in scans.items()],
    )


def neighbours(
    df: DataFrame,
    order: Sequence[str],
    before: int = 0,
    after: int = 0,
    fields: Sequence[str] | None = None,
    by: Sequence[str] = ("rec_id",),
    chunk=CHUNK,
) -> DataFrame:
    """Add ``prev`` / ``next``: arrays of the rows just before / after each row.

    ``prev`` is in time order (the nearest row is last), ``next`` too (the
    nearest row is first).  At chunk edges the rows come from the neighbouring
    chunks: every chunk holds at least one row, so ``before`` (``after``)
    chunk summaries always contain enough of them.
    """
    by, order = list(by), list(order)
    fields = list(fields or df.columns)
    item = F.struct(*fields)
    keyed = df.withColumn("_ck", slot(F.col(order[0]), chunk))
    inside = Window.partitionBy(*by, "_ck").orderBy(*order)
    numbered = keyed.withColumn("_n", F.row_number().over(inside))
    size = F.count(F.lit(1)).over(Window.partitionBy(*by, "_ck"))
    chunks = Window.partitionBy(*by).orderBy("_ck")
    edges = numbered.withColumn("_z", size).groupBy(*by, "_ck").agg(
        F.array_sort(F.collect_list(F.when(F.col("_n") <= after, F.struct("_n", item.alias("row"))))).alias("_heads"),
        F.array_sort(F.collect_list(F.when(F.col("_n") > F.col("_z") - before, F.struct("_n", item.alias("row"))))).alias(
            "_tails"
        ),
    )
    rows = lambda c: F.transform(c, lambda x: x["row"])
    empty = F.array().cast(f"array<{_type_of(df, fields)}>")
    lead_in = F.flatten(F.collect_list(rows(F.col("_tails"))).over(chunks.rowsBetween(-before, -1))) if before else empty
    lead_out = F.flatten(F.collect_list(rows(F.col("_heads"))).over(chunks.rowsBetween(1, after))) if after else empty
    edges = edges.select(*by, "_ck", lead_in.alias("_in"), lead_out.alias("_out"))
    local_prev = F.collect_list(item).over(inside.rowsBetween(-before, -1)) if before else empty
    local_next = F.collect_list(item).over(inside.rowsBetween(1, after)) if after else empty
    joined = numbered.select("*", local_prev.alias("_lp"), local_next.alias("_ln")).join(edges, by + ["_ck"])
    outputs = [F.col(c) for c in df.columns]
    if before:
        whole = F.when(F.size("_lp") >= before, F.col("_lp")).otherwise(F.concat("_in", "_lp"))
        outputs.append(F.slice(whole, F.greatest(F.size(whole) - before + 1, F.lit(1)), F.lit(before)).alias("prev"))
    if after:
        whole = F.when(F.size("_ln") >= after, F.col("_ln")).otherwise(F.concat("_ln", "_out"))
        outputs.append(F.slice(whole, F.lit(1), F.lit(after)).alias("next"))
    return joined.select(*outputs)


def _type_of(df: DataFrame, fields) -> str:
    return "struct<" + ",".join(f"`{f}`:{df.schema[f].dataType.simpleString()}" for f in fields) + ">"


_MERGES = {
    "count": (lambda v, o: F.count(v), lambda c: F.sum(c)),
    "sum": (lambda v, o: F.sum(v), lambda c: F.sum(c)),
    "min": (lambda v, o: F.min(v), lambda c: F.min(c)),
    "max": (lambda v, o: F.max(v), lambda c: F.max(c)),
    "first": (lambda v, o: F.min_by(v, o), lambda c: F.min_by(c, F.struct("_ck", "_run"))),
    "last": (lambda v, o: F.max_by(v, o), lambda c: F.max_by(c, F.struct("_ck", "_run"))),
}


def stitch(parts: DataFrame, breaks: Callable, merged: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """Join runs that were cut at chunk edges.

    ``parts`` holds one row per run and chunk: ``_ck``, ``_run`` (1, 2, … in the
    chunk), ``_first`` and ``_last`` (what ``breaks`` needs of the edge rows)
    and partial aggregates, which ``merged`` combines.
    """
    by = list(by)
    chunks = Window.partitionBy(*by).orderBy("_ck")
    edges = (
        parts.groupBy(*by, "_ck")
        .agg(
            F.max("_run").alias("_n"),
            F.min_by("_first", "_run").alias("_f"),
            F.max_by("_last", "_run").alias("_l"),
        )
        .withColumn("_p", F.lag(F.struct("_l")).over(chunks))
        .withColumn("_glue", F.col("_p").isNotNull() & ~breaks(F.col("_p._l"), F.col("_f")))
        .withColumn("_anchor", F.when(~F.col("_glue") | (F.col("_n") > 1), F.struct("_ck", F.col("_n").alias("_run"))))
        .select(
            *by,
            "_ck",
            "_glue",
            F.last("_anchor", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1)).alias("_head"),
        )
    )
    own = F.struct("_ck", "_run")
    return (
        parts.join(edges, by + ["_ck"])
        .withColumn("_id", F.when((F.col("_run") == 1) & F.col("_glue"), F.col("_head")).otherwise(own))
        .groupBy(*by, "_id")
        .agg(*merged)
        .drop("_id")
    )


def islands(
    df: DataFrame,
    aggs: dict[str, tuple[str, Column]],
    breaks: Callable,
    order: Sequence[str] = ("start", "end"),
    uses: Sequence[str] = ("start", "end"),
    by: Sequence[str] = ("rec_id",),
    chunk=CHUNK,
    stored: bool = False,
) -> DataFrame:
    """Group consecutive rows into runs.

    ``breaks(previous, current)`` sees structs with the columns in ``uses`` and
    says whether a new run starts.  ``aggs`` maps an output name to a kind
    (count, sum, min, max, first, last) and a value.  With ``stored`` the runs of the
    chunks become a table, so that large inputs are sorted once for both readers.
    """
    by, order = list(by), list(order)
    inside = Window.partitionBy(*by, "_ck").orderBy(*order)
    rows = (
        df.withColumn("_ck", slot(F.col(order[0]), chunk))
        .withColumn("_cur", F.struct(*uses))
        .withColumn("_prev", F.lag("_cur").over(inside))
        .withColumn(
            "_run",
            F.sum(
                F.when(F.col("_prev").isNull() | breaks(F.col("_prev"), F.col("_cur")), F.lit(1)).otherwise(F.lit(0))
            ).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        )
    )
    position = _ordering(order)
    parts = rows.groupBy(*by, "_ck", "_run").agg(
        F.min_by("_cur", position).alias("_first"),
        F.max_by("_cur", position).alias("_last"),
        *[_MERGES[k][0](v, position).alias(n) for n, (k, v) in aggs.items()],
    )
    if stored:
        parts = materialize(parts)
    return stitch(parts, breaks, [_MERGES[k][1](F.col(n)).alias(n) for n, (k, _) in aggs.items()], by)


def framed(
    df: DataFrame,
    index: str,
    before: int,
    after: int,
    columns: Callable,
    by: Sequence[str] = ("rec_id",),
    block: int = 8192,
) -> DataFrame:
    """Add columns computed over a frame of neighbouring indices.

    ``columns(frame)`` gets a function ``frame(lo, hi)`` that returns the window
    of rows whose integer index differs by lo … hi.  Blocks of indices are
    scanned separately; the few rows near a block edge are repeated in the
    neighbouring block, so the plan has one exchange and no join.
    """
    by = list(by)
    at = F.col(index)
    own = F.floor(at / block).cast("long")
    # A row is read by the blocks of the indices that look at it.
    low, high = F.floor((at - after) / block).cast("long"), F.floor((at + before) / block).cast("long")
    rows = df.withColumn("_own", own).withColumn("_blk", F.explode(F.sequence(low, high)))
    base = Window.partitionBy(*by, "_blk").orderBy(index)
    added = columns(lambda lo, hi: base.rangeBetween(lo, hi))
    for name, value in added.items():
        rows = rows.withColumn(name, value)
    return rows.where(F.col("_blk") == F.col("_own")).drop("_own", "_blk")
