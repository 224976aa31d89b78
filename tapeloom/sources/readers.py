"""Readers for checkpoint lines and stored score files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_resumable_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Append-only JSON lines whose last line may be torn.

    A broken line is dropped when only blank lines follow it in its file;
    anywhere else the read fails.  The place of a line is its split and its
    number in the split, so files stay splittable.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    probe = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    lines = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("_file"),
            F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("_at"),
            "value",
        )
        .where(F.length(F.trim("value")) > 0)
    )
    parsed = lines.withColumn("_row", F.from_json("value", probe, {"columnNameOfCorruptRecord": "_broken"}))
    parsed = parsed.withColumn("_bad", F.coalesce(F.col("_row._broken").isNotNull(), F.lit(True)))
    last = parsed.groupBy("_file").agg(F.max("_at").alias("_last"))
    joined = parsed.join(last, "_file")
    inner = F.col("_bad") & (F.col("_at") < F.col("_last"))
    fault = F.raise_error(F.concat(F.lit("broken line inside "), F.col("_file")))
    kept = F.when(inner, fault.cast("boolean")).otherwise(~F.col("_bad"))
    return joined.where(kept).select("_row.*").drop("_broken")


SCORE_ROW = "start double, end double, quiet boolean, top map<string,double>, semantic map<string,double>"


def read_scores(
    spark: SparkSession, path: str, row: str = SCORE_ROW, wrapped: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """Window scores from JSON documents: ``{description, rows: [...]}`` or plain arrays.

    Extra score fields are named in ``row``; label maps stay open maps.  ``keep``
    names partition columns of the path.
    """
    extra = "".join(f", `{k}` string" for k in keep)
    if not wrapped:
        return spark.read.schema(row + extra).json(path, multiLine=True)
    whole = spark.read.schema(f"description string, rows array<struct<{_fields(row)}>>{extra}").json(path, multiLine=True)
    return whole.select(*keep, F.explode("rows").alias("_r")).select(*keep, "_r.*")


def _fields(row: str) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(row).fields)


def unfinished(chunks: DataFrame, done: DataFrame, keys=("rec_id", "start")) -> DataFrame:
    """Chunks of a scan that no finished row covers yet."""
    return chunks.join(done.select(*keys).distinct(), list(keys), "left_anti")
