"""Memoised scoring with injected scorers, and retention of scratch artifacts.

A scorer is a function from an iterator of pandas batches to an iterator of
pandas batches; it loads its model once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import sigmoid, span_key
from ..session import attach, materialize
from ..sources import published as pb
from . import intervals as iv
from .scan import CHUNK, running

BY = ("rec_id",)
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def valid_cache(cache: DataFrame, model: str, required: Sequence[str] = ()) -> DataFrame:
    """Cached rows of the current model that hold every required label."""
    rows = cache.where(F.col("model") == model)
    for label in required:
        rows = rows.where(F.map_contains_key("scores", label))
    return rows


def score_missing(
    windows: DataFrame, cache: DataFrame, scorer: Scorer, model: str, required: Sequence[str] = (), by: Sequence[str] = BY
) -> tuple[DataFrame, DataFrame]:
    """Score windows that the cache lacks, each distinct window once.

    ``cache`` is ``(by, key, model, scores)``.  The scorer sees ``by, key, start,
    end`` and returns ``by, key, scores``.  Of cached rows with one key the latest
    ``scored_at`` counts, where the cache has that column.  Returns every requested row (order
    columns and duplicates preserved) with its scores, and the new cache rows.
    """
    by = list(by)
    keyed = windows.withColumn("key", span_key(F.col("start"), F.col("end")))
    return _memoise(keyed, ["start", "end"], cache, scorer, model, required, by)


def score_by_content(
    windows: DataFrame, cache: DataFrame, scorer: Scorer, model: str, required: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """The same keyed by the samples: moved but identical sound is not scored again."""
    keyed = windows.withColumn("key", F.sha2(F.to_json(F.struct("samples")), 256))
    return _memoise(keyed, ["samples"], cache, scorer, model, required, [])


def _memoise(keyed, payload, cache, scorer, model, required, by):
    lookup = [*by, "key"]
    order = F.struct(*[F.col(c) for c in ("scored_at",) if c in cache.columns], F.to_json("scores"))
    known = valid_cache(cache, model, required).groupBy(*lookup).agg(F.max_by("scores", order).alias("scores"))
    first = [F.first(c).alias(c) for c in payload]
    pending = keyed.select(*lookup, *payload).groupBy(*lookup).agg(*first).join(known.select(*lookup), lookup, "left_anti")
    fields = [pending.schema[c] for c in lookup] + [T.StructField("scores", T.MapType(T.StringType(), T.DoubleType()))]
    # Stored once: both results read the same scores, and no key is scored again.
    fresh = materialize(pending.mapInPandas(scorer, T.StructType(fields)))
    rows = keyed.join(known.unionByName(fresh), lookup, "left").drop("key")
    return rows, fresh.withColumn("model", F.lit(model)).select(*lookup, "model", "scores")


STORED = "key string, model string, scores map<string,double>, scored_at timestamp"


def stored_scores(spark, root: str, keys: str = "rec_id string") -> DataFrame:
    """The committed rows of a score store: ``keys``, key, model, scores, scored_at."""
    return pb.published(spark, root, "scores", f"{keys}, {STORED}")


def score_durably(
    windows: DataFrame, root: str, scorer: Scorer, model: str, batch_rows: int = 1_000_000, required: Sequence[str] = (), by: Sequence[str] = BY
) -> DataFrame:
    """Score what the store at ``root`` lacks, one committed batch of distinct windows after the other.

    A batch that fails ends the run with its error; the batches before it are committed
    and a later run scores only the rest.  Rows of other models stay in the store and
    don't count.  Returns every requested row with its scores, as ``score_missing`` does.
    """
    by = list(by)
    spark = windows.sparkSession
    keys = ", ".join(f"{c} {windows.schema[c].dataType.simpleString()}" for c in by)
    lookup = [*by, "key"]
    keyed = windows.withColumn("key", span_key(F.col("start"), F.col("end")))
    known = lambda: valid_cache(stored_scores(spark, root, keys), model, required)
    asked = keyed.groupBy(*lookup).agg(F.first("start").alias("start"), F.first("end").alias("end"))
    pending = materialize(asked.join(known().select(*lookup), lookup, "left_anti"))
    count = pending.count()
    batches = -(-count // batch_rows)
    part = F.pmod(F.xxhash64(*lookup), F.lit(max(batches, 1)))
    fields = [pending.schema[c] for c in lookup] + [T.StructField("scores", T.MapType(T.StringType(), T.DoubleType()))]
    for number in range(batches):
        fresh = pending.where(part == number).mapInPandas(scorer, T.StructType(fields))
        pb.appended(spark, root, "scores", fresh.select(*lookup, F.lit(model).alias("model"), "scores", F.current_timestamp().alias("scored_at")))
    newest = known().groupBy(*lookup).agg(F.max_by("scores", F.struct("scored_at", F.to_json("scores"))).alias("scores"))
    return keyed.join(newest, lookup, "left").drop("key")


def compact_scores(spark, root: str, models: Sequence[str], keys: str = "rec_id string", files: int = 8) -> int:
    """Rewrite the store as one folder with the newest row of each key and model, of the named models only."""
    names = [f.name for f in T.StructType.fromDDL(keys).fields]
    newest = lambda df: (
        df.where(F.col("model").isin(list(models)))
        .groupBy(*names, "key", "model")
        .agg(F.max_by(F.struct("scores", "scored_at"), F.struct("scored_at", F.to_json("scores"))).alias("_s"))
        .select(*names, "key", "model", "_s.scores", "_s.scored_at")
    )
    return pb.compacted(spark, root, "scores", f"{keys}, {STORED}", newest, files)


def cosine_scores(vectors: DataFrame, prompts: DataFrame, cap: int = 65536) -> DataFrame:
    """Similarity of every window vector with every prompt, in prompt order, as ``values``.

    The prompts are a fixed list of the model; all of them go to every task as one
    matrix.  More than ``cap``, or two with one ``idx``, is an error.
    """
    rows = prompts.select("idx", "embedding").orderBy("idx").limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError(f"more than {cap} prompts")
    if len({r["idx"] for r in rows}) < len(rows):
        raise ValueError("prompts share an idx")
    if not rows:
        return vectors.withColumn("values", F.array().cast("array<double>"))
    return vectors.withColumn("values", _against(np.stack([np.asarray(r["embedding"], np.float64) for r in rows]))(F.col("embedding")))


def _against(matrix: np.ndarray):
    """Arrow function: dot products of a batch of vectors with all prompts."""

    @F.pandas_udf("array<double>")
    def score(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack([np.asarray(v, np.float64) for v in column]) @ matrix.T))

    return score


def probabilities(logits: Column, labels: Sequence[str]) -> Column:
    """Independent label probabilities as a map."""
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.transform(logits, sigmoid))


def tag_permitted(windows: DataFrame, mask: DataFrame, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """Add ``retained_whisper``: one permitted interval covers the window."""
    return iv.covered(windows, mask, 1e-6, by, chunk).withColumnRenamed("covered", "retained_whisper")


def retention_sweep(
    artifacts: DataFrame, now: Column, free: Column, retention=7 * 86400, budget=8 * 1024**3, min_free=2 * 1024**3,
    by: Sequence[str] = ("root",), chunk=86400,
) -> DataFrame:
    """Add ``purge`` to artifacts ``(id, last_used, size, completed, active)``.

    Completed ones go first, then the oldest, until the rest fits the budget;
    active ones are skipped.  The purged artifacts are a prefix of that order, so
    the space left before each one is the total minus a running sum.
    """
    by = list(by)
    idle = artifacts.where(~F.col("active"))
    done = [*by, "completed"]
    rows = running(idle, {"_before": ("sum", F.col("size"))}, ["last_used", "id"], done, chunk)
    totals = idle.groupBy(*by).agg(
        F.sum("size").alias("_total"), F.coalesce(F.sum(F.when(F.col("completed"), F.col("size"))), F.lit(0)).alias("_done")
    )
    rows = attach(rows, totals, by, F.col("id"))
    limit = F.greatest(
        F.lit(0), F.least(F.lit(budget), F.col("_total") - F.greatest(F.lit(0), F.lit(min_free) - free))
    )
    earlier = F.coalesce("_before", F.lit(0)) + F.when(F.col("completed"), F.lit(0)).otherwise(F.col("_done"))
    purge = F.col("completed") | (now - F.col("last_used") > retention) | (F.col("_total") - earlier > limit)
    return rows.withColumn("purge", purge).drop("_before", "_total", "_done")
