"""Mixing sources to target weights with fixed-length blocks of words.

The words of each source form one stream, in a hashed order of its documents, and
the stream is cut into blocks of a fixed length (the last one may be shorter).  The
output is dealt into shards of a fixed number of slots.  For every shard the number
of slots of each source is a multinomial draw over what the targets say.  Slots of a
source are numbered through all shards; slot i takes the block that a pseudorandom
permutation of the source's blocks puts at i, and a second permutation serves
a second round.  Draws of a source beyond its quota are left out and one closing
shard takes what the draws left short, so every source meets its quota exactly.
The blocks taken are joined with the documents by block number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import materialize

from .common import ranked, shuffle_partitions, spread_offsets, word_count

#: Repeated over the sources in order of code point, null last.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 64
SHARD_SLOTS = 8192
#: Sources whose draws are made together; a shard's draw goes to groups first, then to the sources of each group.
GROUP = 4096
SEED = 20240


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, blocks ... one row per source, from (source, source_size).

    All sources together get ``SHARE`` times all words by weight; a source stops at
    ``MOST`` times its size and its excess goes to the others by weight.  Stopped sources
    are found round by round from three sums, so no list of sources leaves Spark.
    """
    named = ranked(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"])
    named = materialize(named.drop("_null").withColumnRenamed("_rank", "_i"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("_i") % len(WEIGHTS) + 1).cast("int"))
    rows = named.withColumn("weight", weight)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        stopped = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("source_size") * MOST
        used, free = rows.agg(F.sum(F.when(stopped, F.col("source_size") * MOST)), F.sum(F.when(~stopped, F.col("weight")))).first()
        if free is None:
            break
        now = (SHARE * total - (used or 0.0)) / free
        if level is not None and now <= level * (1 + 1e-12):
            break
        level = now
    capped = F.col("source_size") * F.lit(MOST)
    target = capped if level is None else F.least(F.col("weight") * F.lit(level), capped)
    return rows.select("source", "_i", "source_size", target.cast("double").alias("target"))


def permute(x: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0 .. size-1 for each key, at the positions ``x``.

    Four Feistel rounds over the next power of four; what falls outside walks on.
    """
    bits = np.maximum(np.ceil(np.log2(np.maximum(size, 2).astype(float)) / 2), 1).astype(np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    x, size, key = x.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        half, mask = bits[todo], low[todo]
        left, right = x[todo] >> half, x[todo] & mask
        for turn in range(4):
            z = (right + key[todo] + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= size[todo]]
    return x.astype(np.int64)


def _draws(sources: DataFrame, shards: int) -> DataFrame:
    """shard, _i and n: how many slots of a shard each source gets, before quotas; one multinomial draw per shard.

    The draw goes to groups of ``GROUP`` sources, then to the sources inside each group.
    The list of groups, one number per group, is the only thing that tasks share.
    """
    spark = sources.sparkSession
    grouped = sources.withColumn("g", F.floor(F.col("_i") / GROUP).cast("long"))
    totals = {r["g"]: float(r["q"]) for r in grouped.groupBy("g").agg(F.sum("quota").alias("q")).collect()}
    names = np.array(sorted(totals), dtype=np.int64)
    share = np.array([totals[g] for g in names])
    share = share / share.sum()

    def outer(batches):
        import pandas as pd

        for pdf in batches:
            for shard in pdf["shard"]:
                n = np.random.default_rng([SEED, int(shard)]).multinomial(SHARD_SLOTS, share)
                yield pd.DataFrame({"shard": int(shard), "g": names[n > 0], "slots": n[n > 0]})

    def inner(key, left, right):
        import pandas as pd

        right = right.sort_values("_i")
        out = []
        if len(left) and len(right):
            p = right["quota"].to_numpy(dtype=float)
            for shard, slots in zip(left["shard"], left["slots"], strict=True):
                n = np.random.default_rng([SEED, int(shard), int(key[0])]).multinomial(int(slots), p / p.sum())
                out.append(pd.DataFrame({"shard": shard, "_i": right["_i"].to_numpy()[n > 0], "n": n[n > 0]}))
        return pd.concat(out) if out else pd.DataFrame({"shard": [], "_i": [], "n": []}).astype("int64")

    drawn = spark.range(shards).withColumnRenamed("id", "shard").mapInPandas(outer, "shard long, g long, slots long")
    part = F.floor(F.col("shard") / 64).cast("long")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((shards - 1) // 64).cast("long")))
    keyed = drawn.withColumn("part", part)
    weights = grouped.select("g", F.col("_i").cast("long").alias("_i"), F.col("quota").cast("long").alias("quota")).withColumn("part", parts)
    return keyed.groupBy("g", "part").cogroup(weights.groupBy("g", "part")).applyInPandas(inner, "shard long, _i long, n long")


def plan(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed documents (with ``_start`` in their stream), sources with quotas, and taken blocks (_i, block, times).

    ``_i`` numbers the sources; ``times`` lists the rounds (0, 1) that take the block.
    """
    slim = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_h")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    shares = targets(sizes.select("source", "source_size"))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    quota = F.round(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))).cast("long")
    sources = materialize(shares.withColumn("blocks", blocks).withColumn("quota", F.least(quota, F.col("blocks") * int(MOST))))
    count, rows = sources.agg(F.sum("quota"), F.count("*")).first()
    salts = max(256, slim.count() // 20_000)
    placed = slim.join(sources.select(F.col("source").alias("_s"), "_i", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    placed = spread_offsets(placed, ["_i"], [F.col("doc_id"), F.col("_h"), F.col("size")], F.col("size"), salts)
    placed = materialize(placed)
    if not count:
        taken = sources.select("_i", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("round")).filter(F.lit(False))
        return placed, sources, taken
    shards = -(-count // SHARD_SLOTS)
    drawn = materialize(_draws(sources.filter("quota > 0"), shards))
    before = Window.partitionBy("_i").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    all_ = drawn.groupBy("_i").agg(F.sum("n").alias("drawn"))
    state = sources.filter("quota > 0").join(all_, "_i", "left").select("_i", "blocks", "quota", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    # Runs of slots: what each shard drew, as far as the quota goes, and the closing shard in pieces.
    runs = numbered.join(state.select("_i", "blocks", "quota"), "_i").select("_i", "blocks", "first", F.least(F.col("first") + F.col("n"), "quota").alias("end"))
    short = state.filter("drawn < quota").select("_i", "blocks", F.explode(F.sequence("drawn", F.col("quota") - 1, F.lit(SHARD_SLOTS).cast("long"))).alias("first"), "quota")
    runs = runs.unionByName(short.select("_i", "blocks", "first", F.least(F.col("first") + SHARD_SLOTS, "quota").alias("end"))).filter("first < end")
    slots = runs.repartition(shuffle_partitions(docs), "_i", "first").select("_i", "blocks", F.explode(F.sequence("first", F.col("end") - 1)).alias("slot"))
    taken = _permuted(slots)
    return placed, sources, taken


def _permuted(slots: DataFrame) -> DataFrame:
    """(_i, block, round) of every slot: each round of a source has its own permutation of its blocks."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            i, blocks, slot = (batch.column(k).to_numpy() for k in range(3))
            turn = slot // np.maximum(blocks, 1)
            key = (i.astype(np.uint64) * np.uint64(2) + turn.astype(np.uint64) + np.uint64(SEED)) * np.uint64(0xD6E8FEB86659FD93)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(permute(slot - turn * blocks, blocks, key)), pa.array(turn)], names=["_i", "block", "round"])

    return slots.select(F.col("_i").cast("long"), F.col("blocks").cast("long"), F.col("slot").cast("long")).mapInArrow(run, "_i long, block long, round long")


def _pieces(placed: DataFrame, taken: DataFrame, block: int) -> DataFrame:
    """One row for each document, block and round that takes a part of it: words [low, high) of the document."""
    size, start = F.col("size"), F.col("_start")
    first, last = F.floor(start / block).cast("long"), F.floor((start + size - 1) / block).cast("long")
    parts = placed.filter("size > 0").select("_i", "_start", "size", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("block") * block - start, F.lit(0))
    parts = parts.select("_i", "block", "_start", low.alias("low"), F.least((F.col("block") + 1) * block - start, size).alias("high"))
    # Blocks unfold from small tables, so their estimated size is far too low for a broadcast.
    return parts.join(taken.hint("merge"), ["_i", "block"])


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: the words of it that the mix takes, repeats counted.

    Sizes count words; a null or blank text has none and is never taken.  A null source
    is a source, the last one.  Repeated rows are placed one by one.  Every source
    takes its target up to one block and a rounding; no document is taken more than
    twice.  An empty table gives no rows.  Reruns give the same rows.
    """
    placed, _, taken = plan(docs, block)
    sums = _pieces(placed, taken, block).groupBy("_i", "_start").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    some = placed.filter("size > 0").join(sums, ["_i", "_start"], "left")
    rows = some.unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself with the columns of ``docs``: a row for each unbroken run of words that a round takes of a document.

    A run that covers a document has its text as it is; others have its words with the
    white space between them.  ``n_chars`` counts the characters of the run.
    """
    placed, _, taken = plan(docs, block)
    pieces = _pieces(placed, taken, block)
    own = Window.partitionBy("_i", "_start", "round").orderBy("block")
    runs = pieces.withColumn("_run", F.col("block") - F.row_number().over(own)).groupBy("_i", "_start", "round", "_run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    lists = runs.groupBy("_i", "_start").agg(F.array_sort(F.collect_list(F.struct("round", "low", "high"))).alias("_runs"))
    key = [F.coalesce("doc_id", F.lit(-1)).alias("_d"), F.col("doc_id").isNull().alias("_n")]
    chosen = placed.filter("size > 0").join(lists, ["_i", "_start"]).select(*key, "_h", F.col("size").alias("_size"), "_runs")
    chosen = chosen.groupBy("_d", "_n", "_h", "_size").agg(F.flatten(F.collect_list("_runs")).alias("_runs"))
    text = docs.select(F.struct(*docs.columns).alias("_row"), *key, F.xxhash64("text").alias("_h"))
    once = text.withColumn("_k", F.row_number().over(Window.partitionBy("_d", "_n", "_h").orderBy("_h"))).filter("_k = 1").drop("_k")
    rows = once.join(chosen, ["_d", "_n", "_h"])
    words = F.when(F.exists("_runs", lambda r: r["high"] - r["low"] < F.col("_size")), F.regexp_extract_all(F.col("_row.text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)))
    rows = rows.withColumn("_words", words).select("_row", "_size", "_words", F.explode("_runs").alias("_r"))
    length = F.col("_r.high") - F.col("_r.low")
    part = F.when(length == F.col("_size"), F.col("_row.text")).otherwise(F.array_join(F.slice("_words", (F.col("_r.low") + 1).cast("int"), length.cast("int")), ""))
    rows = rows.select("_row", part.alias("_text"))
    made = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*[made.get(c, F.col(f"_row.{c}")).alias(c) for c in docs.columns])
