"""Moving intervals between the source clock and the clock of an edited output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import intervals as iv
from .frames import output_clock
from .scan import CHUNK

BY = ("rec_id",)


def _hard(findings: DataFrame) -> DataFrame:
    """Findings that may change a plan; review-only ones may not."""
    if "review_only" not in findings.columns:
        return findings
    return findings.where(~F.coalesce(F.col("review_only"), F.lit(False)))


def _moved(
    rows: DataFrame, spans: DataFrame, to: str, by: Sequence[str], chunk, limit: str | None = None
) -> DataFrame:
    """Clip rows to spans and move them to the clock that begins at column ``to``."""
    # The join reads the spans four times, and these come out of an ordered scan.
    pairs = iv.intersect(rows.select(*by, "start", "end"), materialize(spans), by, chunk)
    shift = F.col(f"r.{to}") - F.col("r.start")
    end = F.col("end") + shift
    if limit:
        end = F.least(F.col(f"r.{limit}"), end)
    return pairs.select(*by, (F.col("start") + shift).alias("start"), end.alias("end")).where(F.col("end") > F.col("start"))


def output_to_source(
    findings: DataFrame, keeps: DataFrame, dt, gap=0.25, by: Sequence[str] = BY, chunk=CHUNK
) -> DataFrame:
    """Findings on the joined output of frame intervals, back on the source clock.

    ``keeps`` is in frames of ``dt`` seconds.  A finding across a seam is split.
    """
    step = dt if isinstance(dt, Column) else F.lit(dt)
    seconds = keeps.select(*by, (F.col("start") * step).alias("start"), (F.col("end") * step).alias("end"))
    clock = output_clock(seconds, by, chunk).select(
        *by, F.col("output_start").alias("start"), F.col("output_end").alias("end"), F.col("start").alias("source")
    )
    return iv.merge(_moved(_hard(findings), clock, "source", by, chunk), gap, by, chunk)


def mapped_output_to_source(
    findings: DataFrame, mapping: DataFrame, gap=0.25, by: Sequence[str] = BY, chunk=CHUNK
) -> DataFrame:
    """The same over an explicit mapping with an analysis clock."""
    spans = mapping.select(*by, F.col("output_start").alias("start"), F.col("output_end").alias("end"), "analysis_start")
    return iv.merge(_moved(_hard(findings), spans, "analysis_start", by, chunk), gap, by, chunk)


def source_to_output(intervals: DataFrame, mapping: DataFrame, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """Source intervals on the output clock; rows without an analysis clock are ignored."""
    known = mapping.where(F.col("analysis_start").isNotNull() & F.col("analysis_end").isNotNull())
    spans = known.select(
        *by, F.col("analysis_start").alias("start"), F.col("analysis_end").alias("end"), "output_start", "output_end"
    )
    return iv.merge(_moved(intervals, spans, "output_start", by, chunk, limit="output_end"), 0, by, chunk)


def apply_permissions(
    findings: DataFrame, reviews: DataFrame, mask: DataFrame, key: Sequence[str], by: Sequence[str] = BY, chunk=CHUNK
) -> tuple[DataFrame, DataFrame]:
    """Take permitted time out of findings and decide each review again.

    ``mask`` is on the output clock.  Only reviews that passed or found speech
    change.  Returns the cut findings (``permitted`` or not) and the reviews.
    """
    by, key = list(by), [k for k in key if k not in by]
    open_ = reviews.where(F.col("status").isin("passed", "speech_found")).select(*by)
    live = findings.join(open_, by, "left_semi")
    closed = findings.join(open_, by, "left_anti")
    cut = iv.split_by(live, mask, key, by, chunk)
    rows = cut.unionByName(closed.select(*by, *key, "start", "end", F.lit(False).alias("permitted")))
    left = rows.where(~F.col("permitted")).select(*by).distinct().withColumn("_left", F.lit(True))
    status = F.when(
        F.col("status").isin("passed", "speech_found"),
        F.when(F.col("_left"), "speech_found").otherwise("passed"),
    ).otherwise(F.col("status"))
    return rows, reviews.join(left, by, "left").withColumn("status", status).drop("_left")


def source_intervals(keeps: DataFrame, frames: DataFrame, dt, by: Sequence[str] = BY) -> DataFrame:
    """Frame intervals on the source clock: first frame time to last frame time plus one frame."""
    by = list(by)
    step = dt if isinstance(dt, Column) else F.lit(dt)
    times = frames.select(*by, "frame_idx", "source_time")
    first = times.select(*by, F.col("frame_idx").alias("start"), F.col("source_time").alias("source_start"))
    last = times.select(*by, (F.col("frame_idx") + 1).alias("end"), (F.col("source_time") + step).alias("source_end"))
    rows = keeps.select(*by, "start", "end").join(first, [*by, "start"]).join(last, [*by, "end"])
    return rows.select(
        *by,
        "start",
        "end",
        "source_start",
        "source_end",
        (F.col("start") * step).alias("analysis_start"),
        (F.col("end") * step).alias("analysis_end"),
    )


def audit_map(findings: DataFrame, keeps: DataFrame, dt, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """Speech found on a joined clip, on the source clock, merged with gap 0.65."""
    return output_to_source(findings, keeps, dt, 0.65, by, chunk)
