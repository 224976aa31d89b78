"""Session helpers: local defaults, lineage cuts and per-recording lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, name: str = "tapeloom", shuffle: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: store a table in the shared checkpoint folder and read it back.

    Multi-stage operators read one intermediate table several times.  Stored as
    Parquet it is a pruned, columnar file scan with known size, and it survives
    the loss of executors.  The folder is the one named by
    ``spark.checkpoint.dir``; only where nothing is configured (tests on one
    machine) a temporary folder is used.
    """
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{_shared_folder(spark)}/tapeloom-{name}-{uuid.uuid4().hex}"


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tapeloom-checkpoint-", dir="/tmp"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def opaque(condition: Column) -> Column:
    """The same condition for a column that a filter reads afterwards.

    The optimizer moves a filter below projections and repeats their expressions in it.
    With the row number in the condition (never negative) the filter stays above,
    and what a condition is made of is evaluated once per row.
    """
    return condition & (F.monotonically_increasing_id() >= 0)


def sorted_(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and stays off the driver.

    Spark takes a table for as small as its compressed files, and rows made by ``explode``
    for as few as before; a broadcast chosen on that ground passes through the driver.
    """
    return df.hint("merge")


def attach(df: DataFrame, dims: DataFrame, by, spread, salts: int = 16, how: str = "inner") -> DataFrame:
    """Join a one-row-per-key table to a big table whose keys may be skewed.

    ``spread`` is a column of ``df`` (usually its time) that differs inside one
    key.  The big side is salted by it and the small side is repeated per salt,
    so a key that owns a third of all rows is read by ``salts`` tasks.  No
    broadcast is forced: Spark chooses one at run time when the size allows it.
    """
    by = list(by)
    if how not in ("inner", "left"):
        raise ValueError("attach supports inner and left joins")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    repeated = dims.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(repeated, by + ["_salt"], how).drop("_salt")
