"""Report tables and their sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import format_clock
from ..operators.chapters import chapter_text
from . import published as pb

# Report name -> (clock columns, other columns).
REPORTS = {
    "cut_list": (("source_start", "source_end", "output_start", "output_end"), ("seq",)),
    "quiet_check": (("start", "end"), ("duration", "limit_seconds")),
    "seam_fades": (("time",), ("fade_out_seconds", "fade_in_seconds", "left_rms_db", "right_rms_db", "level_difference_db")),
    "edge_fades": (("start", "end"), ("kind", "seconds")),
    "speech_findings": (("start", "end"), ("text", "status", "reason")),
    "transition_decisions": (("start", "end"), ("decision", "reason")),
    "drink_decisions": (("start", "end"), ("decision", "reason")),
    "whisper_list": (("start", "end"), ("reason",)),
}


def report_table(df: DataFrame, name: str, by: Sequence[str] = ("rec_id",)) -> DataFrame:
    """Columns of a report; times become clock text and absent columns NULL."""
    clocks, others = REPORTS[name]
    has = set(df.columns)
    column = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    return df.select(*by, *[format_clock(F.col(c)).alias(c) for c in clocks], *[column(c).alias(c) for c in others])


def write_reports(tables: dict[str, DataFrame], path: str, by: Sequence[str] = ("rec_id",)) -> None:
    """One CSV table per report, partitioned by recording, replaced as a whole per partition."""
    for name, df in tables.items():
        overwrite_partitions(report_table(df, name, by), f"{path}/{name}", by, "csv", header="true")


def publish_reports(tables: dict[str, DataFrame], root: str, by: Sequence[str] = ("rec_id",), note: dict | None = None) -> int:
    """All reports of a run as one set: readers see the old set until the last one is written; returns the set's number."""
    if not tables:
        raise ValueError("a set has at least one report")

    def writer(name, df):
        rows = report_table(df, name, by)
        return lambda path: rows.write.partitionBy(*by).csv(path, header=True)

    spark = next(iter(tables.values())).sparkSession
    return pb.publish(spark, root, {name: writer(name, df) for name, df in tables.items()}, note)


def published_report(spark: SparkSession, root: str, name: str, by: str = "rec_id string", number: int | None = None) -> DataFrame:
    """A report of the current (or an older) set, all columns as text."""
    clocks, others = REPORTS[name]
    schema = ", ".join(f"`{c}` string" for c in (*clocks, *others))
    return pb.published(spark, root, name, f"{schema}, {by}", "csv", number, header=True)


def write_chapters(rows: DataFrame, path: str, by: Sequence[str] = ("rec_id",)) -> None:
    """Chapters as JSON, as lines of text and as CSV."""
    overwrite_partitions(rows, f"{path}/json", by, "json")
    lines = chapter_text(rows, by=by)
    # A range exchange keeps the lines of a recording in order without one task per recording.
    ordered = lines.repartitionByRange(*by, "index").sortWithinPartitions(*by, "index")
    overwrite_partitions(ordered.select(*by, "line"), f"{path}/text", by, "text")
    flat = rows.withColumn("alternatives", F.array_join("alternatives", "|"))
    overwrite_partitions(flat, f"{path}/csv", by, "csv", header="true")


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str] = ("rec_id",), kind: str = "parquet", **options) -> None:
    """Replace exactly the partitions present in ``df``; the commit publishes all or nothing."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.format(kind).options(**options).save(path)
