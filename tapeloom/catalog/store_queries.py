"""Memoised scoring, retention, report tables, readers and streams."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import identity_key
from ..operators import scoring as sc
from ..session import materialize, shared_path
from ..sources import readers, reports
from ..streaming import ordered as od
from ..streaming import runs as st
from .fixtures import HOP_CHUNK, scored, spans, sql_merge, table, vectors, with_views
from .registry import query


def spot(batches):
    """A stand-in scorer: the score of a window is a fixed function of its times."""
    for batch in batches:
        out = batch[[c for c in ("rec_id", "key") if c in batch.columns]].copy()
        out["scores"] = [{"spot": float((round(a * 10) * 7 + round(b * 10)) % 100) / 100} for a, b in zip(batch["start"], batch["end"])]
        yield out


@query(
    "score_missing",
    with_views(
        "SELECT vec_id, dup, CASE WHEN vec_id % 3 = 0 THEN 200 ELSE (CAST(s * 10 AS BIGINT) * 7 + CAST(e * 10 AS BIGINT)) % 100 END AS score FROM vectors, (SELECT unnest([1, 2]) AS dup)",
        "vectors",
    ),
)
def score_missing(spark, sf):
    """Every third window is cached with another value; each request comes twice."""
    from ..functions.clock import span_key

    w = vectors(spark, sf).select("rec_id", "start", "end", "vec_id")
    known = w.where(F.pmod("vec_id", F.lit(3)) == 0).select("rec_id", span_key(F.col("start"), F.col("end")).alias("key"), F.lit("m1").alias("model"), F.create_map(F.lit("spot"), F.lit(2.0)).alias("scores"))
    stale = w.select("rec_id", span_key(F.col("start"), F.col("end")).alias("key"), F.lit("m0").alias("model"), F.create_map(F.lit("spot"), F.lit(9.0)).alias("scores"))
    asked = w.withColumn("dup", F.explode(F.array(F.lit(1), F.lit(2))))
    rows, _ = sc.score_missing(asked, known.unionByName(stale), spot, "m1")
    return rows.select("vec_id", "dup", F.round(F.col("scores")["spot"] * 100).cast("long").alias("score"))


@query("score_backfill", "SELECT vec_id FROM embeddings WHERE list_contains(list_transform([1, 2], lambda i: embedding[i] > 0), FALSE)")
def score_backfill(spark, sf):
    """Cached rows that lack one of two required labels must be scored again."""
    from .fixtures import LABELS

    cache = scored(spark, sf).select("vec_id", "scores", F.lit("m1").alias("model"))
    good = sc.valid_cache(cache, "m1", LABELS[:2])
    return cache.join(good.select("vec_id"), "vec_id", "left_anti").select("vec_id")


def loudness(batches):
    for batch in batches:
        yield pd.DataFrame({"key": batch["key"], "scores": [{"sum": float(sum(s))} for s in batch["samples"]]})


@query(
    "score_by_content",
    "SELECT conv_id, turn, CAST(coalesce(list_sum(list_transform(string_split(text, ''), lambda x: unicode(x))), 0) AS BIGINT) AS total FROM conversations",
)
def score_by_content(spark, sf):
    """Equal content is scored once, wherever it lies."""
    c = table(spark, sf, "conversations")
    w = c.select("conv_id", "turn", F.transform(F.split("text", ""), lambda x: F.ascii(x).cast("double")).alias("samples"))
    empty = w.limit(0).select(F.lit("").alias("key"), F.lit("").alias("model"), F.lit(None).cast("map<string,double>").alias("scores"))
    rows, _ = sc.score_by_content(w, empty, loudness, "m1")
    return rows.select("conv_id", "turn", F.col("scores")["sum"].cast("long").alias("total"))


_PROMPTS = "SELECT label, min_by(embedding, vec_id) AS pe FROM embeddings GROUP BY label"


@query(
    "score_cosine",
    f"SELECT vec_id, CAST(label AS BIGINT) AS idx, CAST(round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(pe AS DOUBLE[])) * 1000000) AS BIGINT) AS score FROM (SELECT vec_id, embedding FROM embeddings), ({_PROMPTS})",
)
def score_cosine(spark, sf):
    """First vector of each label as its prompt."""
    e = table(spark, sf, "embeddings")
    prompts = materialize(e.groupBy(F.col("label").alias("idx")).agg(F.min_by("embedding", "vec_id").alias("embedding")))
    rows = sc.cosine_scores(e.select("vec_id", "embedding"), prompts)
    # The prompts are the labels of the model, a short fixed list.
    order = F.array(*[F.lit(r["idx"]).cast("long") for r in prompts.select("idx").orderBy("idx").collect()])
    numbered = rows.select("vec_id", F.posexplode("values").alias("pos", "v"))
    return numbered.select("vec_id", F.get(order, "pos").alias("idx"), F.round(F.col("v") * 1000000).cast("long").alias("score"))


@query(
    "score_probabilities",
    "SELECT vec_id, CAST(round(1000000 / (1 + exp(-CAST(embedding[1] AS DOUBLE)))) AS BIGINT) AS a, CAST(round(1000000 / (1 + exp(-CAST(embedding[2] AS DOUBLE)))) AS BIGINT) AS b FROM embeddings",
)
def score_probabilities(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("logits"))
    m = sc.probabilities(F.col("logits"), ["a", "b"])
    return e.select("vec_id", *[F.round(m[n] * 1000000).cast("long").alias(n) for n in ("a", "b")])


@query(
    "score_tag_permitted",
    with_views(
        "SELECT vec_id, EXISTS (SELECT 1 FROM mask m WHERE m.rec_id = v.rec_id AND m.s <= v.s + 1e-6 AND m.e >= v.e - 1e-6) AS retained_whisper FROM vectors v",
        "vectors",
        mask="SELECT rec_id, s, s + 12 AS e FROM vectors WHERE vec_id % 11 = 0",
    ),
)
def score_tag_permitted(spark, sf):
    w = vectors(spark, sf).select("rec_id", "start", "end", "vec_id")
    mask = w.where(F.pmod("vec_id", F.lit(11)) == 0).select("rec_id", "start", (F.col("start") + 12).alias("end"))
    return sc.tag_permitted(w, mask, chunk=HOP_CHUNK).select("vec_id", "retained_whisper")


_ART = dict(
    art="SELECT d.lang AS root, d.doc_id AS id, d.doc_id * 3600 AS last_used, d.n_chars AS size, coalesce(l.quality = 1, FALSE) AS completed, d.doc_id % 10 = 9 AS active FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    idle="SELECT *, sum(size) OVER (PARTITION BY root) AS total, (SELECT max(doc_id) * 3600 FROM documents) AS now, "
    "coalesce(sum(size) OVER (PARTITION BY root ORDER BY NOT completed, last_used, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM art WHERE NOT active",
)


@query(
    "retention_sweep",
    with_views(
        "SELECT id, completed OR now - last_used > 604800 OR total - before > greatest(0, least(300000, total - greatest(0, 50000 - 20000))) AS purge FROM idle",
        **_ART,
    ),
)
def retention_sweep(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    art = d.select(
        F.col("lang").alias("root"), F.col("doc_id").alias("id"), (F.col("doc_id") * 3600).alias("last_used"), F.col("n_chars").alias("size"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("completed"), (F.pmod("doc_id", F.lit(10)) == 9).alias("active"),
    )
    now = table(spark, sf, "documents").agg(F.max("doc_id") * 3600).first()[0]
    return sc.retention_sweep(art, F.lit(now), F.lit(20000), budget=300000, min_free=50000).select("id", "purge")


_HMS = "format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"


@query(
    "report_cut_list",
    with_views(
        f"SELECT rec_id, id AS seq, {_HMS.format(c='a')} AS source_start, {_HMS.format(c='b')} AS source_end FROM (SELECT rec_id, id, CAST(round_even(s / 1000000.0::DOUBLE * 1000, 0) AS BIGINT) AS a, CAST(round_even(e / 1000000.0::DOUBLE * 1000, 0) AS BIGINT) AS b FROM spans)",
        "spans",
    ),
)
def report_cut_list(spark, sf):
    """Written as partitioned CSV and read back."""
    s = spans(spark, sf)
    at, to = F.col("start") / 1e6, F.col("end") / 1e6
    rows = s.select("rec_id", F.col("id").alias("seq"), at.alias("source_start"), to.alias("source_end"), at.alias("output_start"), to.alias("output_end"))
    path = shared_path(spark, "reports")
    reports.write_reports({"cut_list": rows}, path)
    schema = "source_start string, source_end string, output_start string, output_end string, seq long, rec_id string"
    return spark.read.schema(schema).csv(f"{path}/cut_list", header=True).select("rec_id", "seq", "source_start", "source_end")


@query(
    "report_set",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{name}' AS report, rec_id, count(*) AS rows, min(format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000)) AS first "
            "FROM (SELECT rec_id, CAST(round_even(s / 1000000.0::DOUBLE * 1000, 0) AS BIGINT) AS a FROM spans) GROUP BY rec_id"
            for name in reports.REPORTS
        ),
        "spans",
    ),
)
def report_set(spark, sf):
    """All eight reports published as one set, a set whose last report fails, and the reports read back."""
    root = shared_path(spark, "set")
    s = spans(spark, sf)
    at, to = F.col("start") / 1e6, F.col("end") / 1e6
    rows = s.select(
        "rec_id", F.col("id").alias("seq"), at.alias("start"), to.alias("end"), at.alias("time"), at.alias("source_start"), to.alias("source_end"), at.alias("output_start"),
        to.alias("output_end"), (to - at).alias("duration"), F.col("category").alias("reason"),
    )
    reports.publish_reports({name: rows for name in reports.REPORTS}, root)
    broken = rows.withColumn("reason", F.raise_error(F.lit("report lost")).cast("string"))
    try:
        reports.publish_reports({name: broken if name == "whisper_list" else rows.limit(0) for name in reports.REPORTS}, root)
    except Exception as error:  # the reader below must find the first set
        if "report lost" not in str(error):
            raise
    parts = []
    for name, (clocks, _) in reports.REPORTS.items():
        got = reports.published_report(spark, root, name)
        parts.append(got.groupBy("rec_id").agg(F.count(F.lit(1)).alias("rows"), F.min(clocks[0]).alias("first")).select(F.lit(name).alias("report"), "rec_id", "rows", "first"))
    return reduce(DataFrame.unionByName, parts)


@query(
    "score_durable",
    with_views("SELECT vec_id, (CAST(s * 10 AS BIGINT) * 7 + CAST(e * 10 AS BIGINT)) % 100 AS score FROM vectors", "vectors"),
)
def score_durable(spark, sf):
    """Scored in committed batches, then asked for again with a scorer that fails: nothing is left to score."""
    root = shared_path(spark, "store")
    w = vectors(spark, sf).select("rec_id", "start", "end", "vec_id")
    sc.score_durably(w, root, spot, "m1", batch_rows=max(1, w.count() // 4))

    def lost(batches):
        for batch in batches:
            raise RuntimeError(f"{len(batch)} windows scored twice")
            yield batch

    rows = sc.score_durably(w, root, lost, "m1")
    return rows.select("vec_id", F.round(F.col("scores")["spot"] * 100).cast("long").alias("score"))


@query("identity_key", "SELECT doc_id, sha256('{\"p0\":' || doc_id || ',\"p1\":\"' || lang || '\"}') AS key FROM documents")
def identity_key_query(spark, sf):
    return table(spark, sf, "documents").select("doc_id", identity_key("doc_id", "lang").alias("key"))


@query("read_resumable_jsonl", "SELECT conv_id, turn, length(text) AS n FROM conversations")
def read_resumable_jsonl(spark, sf):
    """Conversations as JSON lines in many files, each with a torn last line."""
    path = shared_path(spark, "jsonl")
    c = table(spark, sf, "conversations").withColumn("part", F.pmod("conv_id", F.lit(4)))
    whole = c.select("part", F.lit(0).alias("torn"), "conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "text")).alias("value"))
    torn = whole.groupBy("part").agg(F.min("value").alias("value")).select(
        "part", F.lit(1).alias("torn"), F.lit(0).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.expr("substring(value, 1, 20)").alias("value")
    )
    rows = whole.unionByName(torn).repartition(4, "part").sortWithinPartitions("part", "torn", "conv_id", "turn")
    rows.select("part", "value").write.mode("overwrite").partitionBy("part").text(path)
    got = readers.read_resumable_jsonl(spark, path, "conv_id long, turn long, text string")
    return got.select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query(
    "read_scores",
    "SELECT vec_id // 50 AS rec, CAST((vec_id % 50) * 2 AS BIGINT) AS start, CAST(round(greatest(CAST(embedding[1] AS DOUBLE), 0) * 1000000) AS BIGINT) AS mouth FROM embeddings",
)
def read_scores(spark, sf):
    """Score documents, one per recording, written as JSON and read back."""
    path = shared_path(spark, "scores")
    v = vectors(spark, sf)
    row = F.struct("start", "end", F.create_map(F.lit("mouth"), F.greatest(F.get("embedding", F.lit(0)), F.lit(0.0))).alias("semantic"))
    docs = v.groupBy("rec_id").agg(F.collect_list(row).alias("rows"))
    text = F.to_json(F.struct(F.col("rec_id").cast("string").alias("description"), "rows"))
    docs.select("rec_id", text.alias("value")).repartition("rec_id").write.mode("overwrite").partitionBy("rec_id").text(path)
    got = readers.read_scores(spark, path, keep=["rec_id"])
    return got.select(
        F.col("rec_id").cast("long").alias("rec"), F.col("start").cast("long").alias("start"), F.round(F.col("semantic")["mouth"] * 1000000).cast("long").alias("mouth")
    )


@query(
    "report_overwrite_partitions",
    with_views("SELECT rec_id, id, CASE WHEN CAST(split_part(rec_id, '-', 3) AS INTEGER) % 2 = 0 THEN 'second' ELSE 'first' END AS run FROM spans", "spans"),
)
def report_overwrite_partitions(spark, sf):
    """A second run replaces the days it holds and leaves the others."""
    path = shared_path(spark, "parts")
    s = spans(spark, sf).select("rec_id", "id")
    reports.overwrite_partitions(s.withColumn("run", F.lit("first")), path)
    reports.overwrite_partitions(s.where(F.dayofmonth(F.to_date("rec_id")) % 2 == 0).withColumn("run", F.lit("second")), path)
    return spark.read.schema("id long, run string, rec_id string").parquet(path).select("rec_id", "id", "run")


@query("report_chapters", with_views("SELECT rec_id, count(*) AS lines FROM spans GROUP BY rec_id", "spans"))
def report_chapters(spark, sf):
    """Chapter lines of every day, written as text and counted again."""
    path = shared_path(spark, "chapters")
    rows = spans(spark, sf).select(
        "rec_id", F.col("id").alias("index"), (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"), F.lit("tapping").alias("category"),
        F.array().cast("array<string>").alias("alternatives"), F.lit(0).cast("long").alias("review_findings"),
    )
    reports.write_chapters(rows, path)
    return spark.read.schema("value string, rec_id string").text(f"{path}/text").groupBy("rec_id").agg(F.count(F.lit(1)).alias("lines"))


@query("read_unfinished_chunks", with_views("SELECT rec_id, id FROM spans WHERE id % 3 != 0", "spans"))
def read_unfinished_chunks(spark, sf):
    s = spans(spark, sf).select("rec_id", "id")
    return readers.unfinished(s, s.where(F.pmod("id", F.lit(3)) == 0), ("rec_id", "id"))


# Streams: the parquet file is the source, every trigger reads what is new.

def _stream(spark, sf, name):
    static = table(spark, sf, name)
    return spark.readStream.schema(static.schema).parquet(f"{sf}/{name}*.parquet")


def _mixed(spark, frames, rec, files: int = 6, jitter: int = 240):
    """Rows in ``files`` micro-batches, each row up to ``jitter`` seconds late, then one row of ``rec`` that lets the watermark pass all of them."""
    folder = shared_path(spark, "late")
    lateness = F.pmod(F.xxhash64(*[c for c, kind in frames.dtypes if not kind.startswith("array")]), F.lit(jitter))
    seen = F.unix_seconds("ts") + lateness
    rows = materialize(frames.withColumn("_seen", seen))
    low, high = rows.agg(F.min("_seen"), F.max("_seen")).first()
    width = (high - low) // files + 1
    for k in range(files):
        rows.where(F.floor((F.col("_seen") - low) / width) == k).drop("_seen").write.parquet(f"{folder}/{k:03d}")
    last = rows.agg(F.max("ts").alias("t"))
    blank = {"string": F.lit(""), "boolean": F.lit(False)}
    value = lambda kind: blank.get(kind, F.array() if kind.startswith("array") else F.lit(1)).cast(kind)
    known = {"rec_id": F.lit(rec).cast(frames.schema["rec_id"].dataType), "ts": F.col("t") + F.make_dt_interval(days=F.lit(1))}
    last.select(*[known.get(c, value(kind)).alias(c) for c, kind in frames.dtypes]).write.parquet(f"{folder}/{files:03d}")
    schema = rows.drop("_seen").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", spark.sparkContext.defaultParallelism).parquet(f"{folder}/*")


def _drain(stream, mode="append"):
    """Run a stream over all available files and return its output table."""
    spark = stream.sparkSession
    folder = shared_path(spark, "stream")
    if mode == "append":
        sink = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    else:
        sink = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"))
    run = sink.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(
    "stream_window_scores",
    "SELECT event_type AS rec_id, CAST(epoch_us(ts) // 600000000 AS BIGINT) AS slot, count(*) AS n, CAST(round(max(value) * 100) AS BIGINT) AS top FROM events GROUP BY event_type, epoch_us(ts) // 600000000",
)
def stream_window_scores(spark, sf):
    """Late events in micro-batches; a window is emitted once, when the watermark has passed it."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = _drain(st.stream_scores(_mixed(spark, e, "end"), "10 minutes", watermark="10 minutes"))
    slot = F.floor(F.unix_micros("start") / 600000000).cast("long")
    return out.select("rec_id", slot.alias("slot"), "n", F.round(F.col("top") * 100).cast("long").alias("top"))


@query(
    "stream_merge_spans",
    with_views(
        'SELECT rec_id, s AS start, e AS "end" FROM m',
        t="SELECT event_type AS rec_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS e FROM events",
        m=sql_merge("t", "2000000"),
    ),
)
def stream_merge_spans(spark, sf):
    """Late events in micro-batches; a session is emitted once, when the watermark has passed it."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("seconds"))
    out = _drain(st.stream_merge(_mixed(spark, e, "end"), 2.0))
    return out.select("rec_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"))


@query(
    "stream_order_check",
    "SELECT rec_id, event_id AS ordinal FROM (SELECT user_id AS rec_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE value <= p",
)
def stream_order_check(spark, sf):
    """Late packets in micro-batches, checked in the order of their numbers."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ordinal"), F.col("value").alias("pts"))
    return _drain(od.order_violations(_mixed(spark, e, -1), "10 minutes")).where("rec_id >= 0").select("rec_id", "ordinal")


_OPEN = "SELECT rec_id, g, min(i) AS s, max(i) + 1 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY rec_id, q ORDER BY i) AS g FROM f) WHERE q GROUP BY rec_id, g"


@query(
    "stream_quiet_runs",
    with_views(
        'SELECT rec_id, s AS start, e AS "end" FROM r',
        f="SELECT CAST(event_id // 500 AS VARCHAR) AS rec_id, event_id % 500 AS i, value < 10 AS q FROM events",
        r=_OPEN,
    ),
)
def stream_quiet_runs(spark, sf):
    """All runs of late frames in micro-batches; the last frame of a recording closes the open one."""
    e = table(spark, sf, "events")
    frames = e.select(
        F.expr("event_id div 500").cast("string").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.pmod("event_id", F.lit(500)).alias("frame_idx"), (F.col("value") < 10).alias("quiet"), (F.pmod("event_id", F.lit(500)) == 499).alias("last"),
    )
    return _drain(od.quiet_runs(_mixed(spark, frames, "end"), watermark="10 minutes")).where("rec_id <> 'end'")


@query(
    "stream_block_gaps",
    "SELECT rec_id, block_idx, CAST(least(n, greatest(0, c - f)) AS BIGINT) AS skip, CAST(greatest(0, f - c) AS BIGINT) AS zeros, f - c > 50 AS violation FROM ("
    "SELECT *, greatest(0, coalesce(max(f + n) OVER (PARTITION BY rec_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS c FROM ("
    "SELECT user_id AS rec_id, event_id AS block_idx, event_id * 2 + event_id % 7 * 10 AS f, event_id % 9 * 100 AS n FROM events))",
)
def stream_block_gaps(spark, sf):
    e = _stream(spark, sf, "events").select(
        F.col("user_id").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("block_idx"),
        (F.col("event_id") * 2 + F.pmod("event_id", F.lit(7)) * 10).alias("first_sample"), (F.pmod("event_id", F.lit(9)) * 100).alias("length"),
    )
    return _drain(st.stream_block_gaps(e, 50))


# Blocks of a recording: 500 events each, up to eight samples a block, some trimmed, some after a hole.
_BLOCKS = dict(
    f="SELECT event_id // 500 AS rec_id, event_id % 500 AS i, ts, event_id % 500 * 5 + event_id % 13 * 4 AS b, event_id % 9 AS n, event_id % 7 + 1 AS v FROM events",
    c="SELECT *, greatest(0, coalesce(max(b + n) OVER (PARTITION BY rec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cur FROM f",
    lim="SELECT rec_id, CAST(2600 AS BIGINT) AS lim, max(b + n) AS stop FROM f GROUP BY rec_id",
    keep="SELECT c.rec_id, greatest(b, cur) AS a, least(b + n, lim) AS z, v FROM c JOIN lim USING (rec_id) WHERE least(b + n, lim) > greatest(b, cur)",
    gap="SELECT c.rec_id, cur AS a, b AS z, lim FROM c JOIN lim USING (rec_id) WHERE b > cur UNION ALL SELECT rec_id, stop, lim, lim FROM lim WHERE lim > stop",
)


def _late_blocks(spark, sf):
    e = table(spark, sf, "events")
    n = lambda k: F.pmod("event_id", F.lit(k))
    return e.select(
        F.expr("event_id div 500").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"), n(500).alias("block_idx"), (n(500) * 5 + n(13) * 4).alias("first_sample"),
        F.array_repeat((n(7) + 1).cast("double"), n(9).cast("int")).alias("samples"), F.lit(2600).cast("long").alias("limit"), (n(500) == 499).alias("last"),
    )


@query(
    "stream_block_repair",
    with_views(
        "SELECT rec_id, 'sound' AS kind, CAST(sum(z - a) AS BIGINT) AS samples, CAST(sum((z - a) * v + a) AS BIGINT) AS mark FROM keep GROUP BY rec_id "
        "UNION ALL SELECT rec_id, 'filler', CAST(sum(least(z, lim) - a) AS BIGINT), CAST(0 AS BIGINT) FROM gap WHERE least(z, lim) > a GROUP BY rec_id "
        "UNION ALL SELECT rec_id, 'hole', count(*), CAST(sum(a * 7 + z) AS BIGINT) FROM gap WHERE z - a > 25 GROUP BY rec_id",
        **_BLOCKS,
    ),
)
def stream_block_repair(spark, sf):
    """Late blocks repaired in the stream; sums of the sound, of the filler and of the side table of holes."""
    out = materialize(_drain(od.repaired_blocks(_mixed(spark, _late_blocks(spark, sf), -1), 25, watermark="10 minutes")).where("rec_id >= 0"))
    samples, holes = od.split_outputs(out)
    size = F.size("samples").cast("long")
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    kind = F.when(F.col("filler"), "filler").otherwise("sound")
    mark = F.sum(F.when(F.col("filler"), F.lit(0.0)).otherwise(total + F.col("first_sample"))).cast("long")
    sums = samples.groupBy("rec_id", kind.alias("kind")).agg(F.sum(size).alias("samples"), mark.alias("mark"))
    return sums.unionByName(holes.groupBy("rec_id").agg(F.lit("hole").alias("kind"), F.count(F.lit(1)).alias("samples"), F.sum(F.col("start") * 7 + F.col("end")).alias("mark")))


@query(
    "stream_quiet_meter",
    with_views(
        "SELECT rec_id, CAST(round(coalesce(max(e - s), 0) * 100) AS BIGINT) AS longest, coalesce(max(e - s), 0) <= 0.5 + 1e-6 AS within, count(*) FILTER (e - s > 0.5 + 1e-6) AS runs FROM ("
        "SELECT rec_id, min(i) / 100.0::DOUBLE AS s, (max(i) + 1) / 100.0::DOUBLE AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY rec_id, q ORDER BY i) AS g FROM f) WHERE q GROUP BY rec_id, g "
        "UNION ALL SELECT DISTINCT rec_id, 0, 0 FROM f) GROUP BY rec_id",
        f="SELECT event_id // 500 AS rec_id, event_id % 500 AS i, value < 14 AS q FROM events",
    ),
)
def stream_quiet_meter(spark, sf):
    """An event is ten samples of two channels, cut into blocks of seven and three samples; windows are ten samples."""
    e = table(spark, sf, "events")
    level = F.when(F.col("value") < 14, 0.0001).otherwise(0.5)
    sides = lambda size: F.array(F.array_repeat(level, size), F.array_repeat(-level, size))
    blocks = e.select("*", F.posexplode(F.array(sides(7), sides(3))).alias("k", "samples"))
    n = F.pmod("event_id", F.lit(500))
    blocks = blocks.select(
        F.expr("event_id div 500").alias("rec_id"), F.col("ts").cast("timestamp").alias("ts"), (n * 2 + F.col("k")).alias("block_idx"), "samples", ((n == 499) & (F.col("k") == 1)).alias("last")
    )
    out = _drain(od.live_quiet_meter(_mixed(spark, blocks, -1), 1000, -40.0, 0.5, 0.01, watermark="10 minutes")).where("rec_id >= 0")
    return out.groupBy("rec_id").agg(
        F.round(F.max("longest") * 100).cast("long").alias("longest"), F.bool_and(F.coalesce("within", F.lit(True))).alias("within"), F.count(F.when(F.col("kind") == "run", 1)).alias("runs")
    )
