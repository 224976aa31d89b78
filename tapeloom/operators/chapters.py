"""Chapters of a finished output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import format_short_clock
from ..functions.vocabulary import TITLES
from .joins import range_join
from .scan import CHUNK, islands, running

BY = ("rec_id",)


def chapters(windows: DataFrame, findings: DataFrame, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """Touching windows of equal category and equal alternatives become one chapter.

    ``findings`` lists the start and end of the findings a chapter overlaps, in order,
    and ``review_findings`` counts them; :func:`chapter_findings` has the pairs.
    """
    by = list(by)
    rows = windows.withColumn("alternatives", F.sort_array("alternatives"))
    aggs = {
        "start": ("first", F.col("start")),
        "end": ("last", F.col("end")),
        "category": ("first", F.col("category")),
        "alternatives": ("first", F.col("alternatives")),
        "windows": ("count", F.lit(1)),
    }
    differs = lambda a, b: (
        (a["category"] != b["category"]) | (a["alternatives"] != b["alternatives"]) | (F.abs(a["end"] - b["start"]) >= 1e-5)
    )
    runs = islands(rows, aggs, differs, uses=["start", "end", "category", "alternatives"], by=by, chunk=chunk)
    runs = running(runs, {"index": ("sum", F.lit(1))}, ["start"], by, chunk, inclusive=True)
    hits = chapter_findings(runs, findings, by, chunk).groupBy(*by, "index").agg(
        F.count(F.lit(1)).alias("review_findings"),
        F.array_sort(F.collect_list(F.struct(F.col("finding.start").alias("start"), F.col("finding.end").alias("end")))).alias("findings"),
    )
    out = runs.join(hits, [*by, "index"], "left")
    return out.select(
        *by,
        "index",
        "start",
        "end",
        (F.col("end") - F.col("start")).alias("duration"),
        "category",
        _title(F.col("category"), TITLES).alias("title"),
        "alternatives",
        "windows",
        F.coalesce("review_findings", F.lit(0).cast("long")).alias("review_findings"),
        F.coalesce("findings", F.array().cast(out.schema["findings"].dataType)).alias("findings"),
        F.col("category").isin("unknown", "mixed").alias("needs_confirmation"),
    )


def chapter_findings(rows: DataFrame, findings: DataFrame, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """Pairs of a chapter number and an overlapping finding."""
    spans = rows.select(*by, "index", "start", "end")
    pairs = range_join(spans, findings, by, chunk)
    return pairs.select(*by, F.col("l.index").alias("index"), F.col("r").alias("finding"))


def _title(category, titles: dict[str, str]):
    names = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])
    return F.coalesce(F.element_at(names, category), category)


def chapter_text(rows: DataFrame, titles: dict[str, str] | None = None, by: Sequence[str] = BY) -> DataFrame:
    """One line per chapter: times, title, alternatives and a review mark."""
    title = lambda c: _title(c, titles or TITLES)
    others = F.array_join(F.transform("alternatives", title), "、")
    line = F.concat(
        format_short_clock(F.col("start")),
        F.lit(" — "),
        format_short_clock(F.col("end")),
        F.lit("  "),
        title(F.col("category")),
        F.when(F.size("alternatives") > 0, F.concat(F.lit("（"), others, F.lit("）"))).otherwise(F.lit("")),
        F.when(F.col("review_findings") > 0, F.lit(" · 含待复听位置")).otherwise(F.lit("")),
    )
    return rows.select(*by, "index", line.alias("line"))
