"""The supplied tables read as recordings, in Spark and as SQL.

Every view covers the whole table.  Times are integer microseconds where the
table has a real clock and seconds where a grid is derived from row numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import SCORE_COLUMNS, SEMANTIC_PROMPTS
from ..session import materialize

DAY = 86_400_000_000
US_CHUNK = 600_000_000
HOP_CHUNK = 20.0

# Embedding position -> label, so that one vector is one open score map.
LABELS = list(dict.fromkeys(label for labels in SCORE_COLUMNS.values() for label in labels))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def us(seconds: Column) -> Column:
    return F.round(seconds * 1_000_000).cast("long")


def sql_us(expr: str) -> str:
    return f"CAST(round(({expr}) * 1000000) AS BIGINT)"


# events -> intervals on days


def spans(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    at = F.expr("timestampdiff(MICROSECOND, date_trunc('DAY', ts), ts)")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("rec_id"),
        F.col("event_id").alias("id"),
        F.col("event_type").alias("category"),
        F.col("user_id"),
        at.alias("start"),
        (at + F.round(F.col("value") * 1_000_000).cast("long")).alias("end"),
    )


def only(df: DataFrame, *categories: str) -> DataFrame:
    return df.where(F.col("category").isin(*categories))


def days(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("rec_id")).distinct().withColumn("duration", F.lit(DAY).cast("long"))


# embeddings -> scored windows, similarity vectors and sample blocks


def vectors(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    number = F.pmod("vec_id", F.lit(50))
    return e.select(
        F.expr("vec_id div 50").alias("rec_id"),
        number.alias("block_idx"),
        (number * 2.0).alias("start"),
        (number * 2.0 + 6.0).alias("end"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
        "label",
        "vec_id",
    )


def scored(spark, sf, scale: float = 2.0) -> DataFrame:
    """Windows with an open label map; negative values count as absent labels."""
    v = vectors(spark, sf)
    names = F.array(*[F.lit(x) for x in LABELS])
    pairs = F.transform(names, lambda n, i: F.struct(n.alias("k"), F.get("embedding", F.pmod(i, F.lit(64))).alias("v")))
    kept = F.filter(pairs, lambda x: x["v"] > 0)
    scores = F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"] * scale)))
    return v.select("rec_id", "start", "end", (F.pmod("vec_id", F.lit(17)) == 0).alias("quiet"), scores.alias("scores"), "vec_id")


def similar(spark, sf, scale: float = 2.0) -> DataFrame:
    """Windows with an ordered similarity vector, one value per prompt."""
    n = sum(c for _, c in SEMANTIC_PROMPTS)
    v = vectors(spark, sf)
    return v.select(
        "rec_id", "start", "end", (F.pmod("vec_id", F.lit(17)) == 0).alias("quiet"),
        F.transform(F.slice("embedding", 1, n), lambda x: x * scale).alias("values"), "vec_id",
    )


def described(spark, sf, scale: float = 2.0, shrink: dict[str, float] | None = None, lift: float = 2.0) -> DataFrame:
    """Windows with promoted score columns and the semantic map of the same vector."""
    from ..operators import labels

    a = labels.promote(scored(spark, sf, scale))
    b = labels.semantic(similar(spark, sf, lift)).select("vec_id", "semantic")
    rows = a.join(b, "vec_id")
    for name, factor in (shrink or {}).items():
        rows = rows.withColumn(name, F.col(name) * factor)
    # Detection reads its window table several times: promote once, write once.
    return materialize(rows)


def hop_recordings(spark, sf) -> DataFrame:
    v = table(spark, sf, "embeddings")
    rec = F.expr("vec_id div 50")
    return v.groupBy(rec.alias("rec_id")).agg((F.max(F.pmod("vec_id", F.lit(50))) * 2.0 + 6.0).alias("duration"))


# lineitem -> packets, frame levels


def packet_order(df: DataFrame) -> Window:
    first = ["l_shipdate", "l_orderkey", "l_linenumber"]
    rest = [c for c in df.columns if c not in (*first, "l_suppkey")]
    return [*first, *rest]


_STORED: dict[tuple[str, str], DataFrame] = {}


def shipped(spark, sf) -> DataFrame:
    """Line items numbered per supplier in a total order, stored once per session.

    The order has no clock to cut into chunks, so the number of a row is the
    number of rows of earlier quarters plus its place in its own.  A day holds
    hardly more than one row, so sums of days would be as many as the rows.
    """
    key = spark.sparkContext.applicationId, sf
    if key in _STORED:
        return _STORED[key]
    df = table(spark, sf, "lineitem")
    order = packet_order(df)
    df = df.withColumn("_ck", F.date_trunc("quarter", "l_shipdate"))
    inside = Window.partitionBy("l_suppkey", "_ck").orderBy(*order)
    earlier = Window.partitionBy("l_suppkey").orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("l_suppkey", "_ck").agg(F.count(F.lit(1)).alias("_n"), F.sum("l_quantity").alias("_q"))
    totals = totals.select(
        "l_suppkey",
        "_ck",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_q").over(earlier), F.lit(0.0)).alias("_clock"),
    )
    rows = df.withColumn("_i", F.row_number().over(inside)).withColumn(
        "_t", F.coalesce(F.sum("l_quantity").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    )
    rows = rows.join(totals, ["l_suppkey", "_ck"])
    _STORED[key] = materialize(rows.select(
        F.col("l_suppkey").alias("rec_id"),
        (F.col("_before") + F.col("_i") - 1).alias("ordinal"),
        (F.col("_clock") + F.col("_t")).alias("pts"),
        F.col("l_quantity").alias("duration"),
        (F.col("l_linenumber") == 1).alias("is_key"),
        F.round(F.col("l_extendedprice")).cast("long").alias("size"),
        "l_discount",
        "l_tax",
        "l_orderkey",
    ))
    return _STORED[key]


def packets(spark, sf) -> DataFrame:
    return shipped(spark, sf).select("rec_id", "ordinal", "pts", "duration", "is_key", "size", "l_orderkey")


def levels(spark, sf) -> DataFrame:
    """Frame levels: RMS from the discount, peak a little higher."""
    return shipped(spark, sf).select(
        "rec_id", F.col("ordinal").alias("frame_idx"), F.col("l_discount").alias("rms"), (F.col("l_discount") + F.col("l_tax") / 2).alias("peak")
    )


# conversations -> transcript segments


def words_of(text: Column, start: Column) -> Column:
    parts = F.filter(F.split(text, r"[ \n]+"), lambda w: F.length(w) > 0)
    return F.transform(
        parts,
        lambda w, i: F.struct(
            (start + i * 0.3).alias("start"),
            (start + i * 0.3 + 0.25).alias("end"),
            w.alias("word"),
            (F.pmod(F.length(w) * 7 + i, F.lit(10)) / 10.0).alias("probability"),
        ),
    )


def segments(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    start = F.col("turn") * 10.0
    rows = c.select(
        F.col("conv_id").alias("rec_id"),
        F.col("turn"),
        F.col("role"),
        F.col("text"),
        start.alias("start"),
        words_of(F.col("text"), start).alias("words"),
    )
    return rows.select(
        "*",
        F.coalesce(F.element_at(F.when(F.size("words") > 0, F.col("words")), -1)["end"], F.col("start")).alias("end"),
        (-F.pmod(F.length("text"), F.lit(20)) / 10.0).alias("avg_logprob"),
        (F.pmod(F.length("text"), F.lit(30)) / 10.0).alias("compression_ratio"),
        (F.pmod(F.length("text"), F.lit(11)) / 10.0).alias("no_speech_prob"),
        F.when(F.col("role") == "assistant", F.lit("qwen3-asr")).alias("backend"),
        (F.size("words") + F.pmod(F.length("text"), F.lit(7)) * F.size("words") / 6).cast("int").alias("alignment_total_words"),
    )


def voiced(spark, sf) -> DataFrame:
    """Voice activity of a conversation: the first 3 s of every even turn."""
    c = table(spark, sf, "conversations")
    return c.where(F.pmod("turn", F.lit(2)) == 0).select(
        F.col("conv_id").alias("rec_id"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 3.0).alias("end")
    )


# The same views as SQL.

_LABEL_INDEX = {label: i % 64 + 1 for i, label in enumerate(LABELS)}
_N = sum(c for _, c in SEMANTIC_PROMPTS)


def sql_scores(scale: float) -> str:
    out = []
    for name, labels in SCORE_COLUMNS.items():
        values = [f"coalesce(em[{_LABEL_INDEX[x]}], 0) * {scale}" for x in labels]
        out.append(f"greatest(0.0, {', '.join(values)}) AS {name}")
    return ", ".join(out)


def sql_semantic(lift: float) -> str:
    out, at = [], 1
    for name, count in SEMANTIC_PROMPTS:
        out.append(f"greatest({', '.join(f'em[{i}] * {lift}' for i in range(at, at + count))}) AS m_{name}")
        if name == "other":
            out.append(f"greatest({', '.join(f'em[{i}] * {lift}' for i in range(at + 2, at + count))}) AS m_background")
        at += count
    return ", ".join(out)


_LINE_ORDER = (
    "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
)

VIEWS = {
    "spans": (
        [],
        "SELECT strftime(ts, '%Y-%m-%d') AS rec_id, event_id AS id, event_type AS category, user_id, "
        "CAST(epoch_us(ts) % 86400000000 AS BIGINT) AS s, "
        "CAST(epoch_us(ts) % 86400000000 AS BIGINT) + CAST(round(value * 1000000) AS BIGINT) AS e FROM events",
    ),
    "days": ([], "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS rec_id, CAST(86400000000 AS BIGINT) AS d FROM events"),
    "vectors": (
        [],
        "SELECT vec_id // 50 AS rec_id, vec_id % 50 AS block_idx, CAST((vec_id % 50) * 2 AS DOUBLE) AS s, "
        "CAST((vec_id % 50) * 2 + 6 AS DOUBLE) AS e, CAST(embedding AS DOUBLE[]) AS em, vec_id, label, "
        "(vec_id % 17 = 0) AS quiet FROM embeddings",
    ),
    "hop_recordings": (["vectors"], "SELECT rec_id, max(e) AS d FROM vectors GROUP BY rec_id"),
    "shipped": (
        [],
        "SELECT l_suppkey AS rec_id, row_number() OVER w - 1 AS ordinal, "
        "coalesce(sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pts, "
        "l_quantity AS duration, l_linenumber = 1 AS is_key, CAST(round(l_extendedprice) AS BIGINT) AS size, "
        "l_discount AS rms, l_discount + l_tax / 2 AS peak, l_orderkey FROM lineitem "
        f"WINDOW w AS (PARTITION BY l_suppkey ORDER BY {_LINE_ORDER})",
    ),
    "words": (
        [],
        "SELECT conv_id AS rec_id, turn, role, text, turn * 10.0::DOUBLE AS s, "
        "unnest(ws) AS word, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT) AS i FROM ("
        "SELECT *, list_filter(string_split_regex(text, '[ \\n]+'), lambda w: length(w) > 0) AS ws FROM conversations)",
    ),
    "timed_words": (
        ["words"],
        "SELECT rec_id, turn, role, text, s, word, i, s + i * 0.3::DOUBLE AS ws, s + i * 0.3::DOUBLE + 0.25::DOUBLE AS we, "
        "((length(word) * 7 + i) % 10) / 10.0::DOUBLE AS p FROM words",
    ),
    "segments": (
        ["timed_words"],
        "SELECT c.conv_id AS rec_id, c.turn, c.role, c.text, c.turn * 10.0::DOUBLE AS s, "
        "coalesce(w.e, c.turn * 10.0::DOUBLE) AS e, coalesce(w.n, 0) AS n_words, coalesce(w.p, 0) AS p_sum, w.p_first, "
        "-(length(c.text) % 20) / 10.0::DOUBLE AS lp, (length(c.text) % 30) / 10.0::DOUBLE AS cr, "
        "(length(c.text) % 11) / 10.0::DOUBLE AS ns, c.role = 'assistant' AS aligned, "
        "CAST(floor(coalesce(w.n, 0) + (length(c.text) % 7) * coalesce(w.n, 0) / 6.0::DOUBLE) AS INTEGER) AS total "
        "FROM conversations c LEFT JOIN (SELECT rec_id, turn, count(*) AS n, max_by(we, i) AS e, sum(p) AS p, "
        "min_by(p, i) AS p_first FROM timed_words GROUP BY ALL) w ON c.conv_id = w.rec_id AND c.turn = w.turn",
    ),
    "voiced": (
        [],
        "SELECT conv_id AS rec_id, turn * 10.0::DOUBLE AS s, turn * 10.0::DOUBLE + 3.0::DOUBLE AS e FROM conversations WHERE turn % 2 = 0",
    ),
}


def scored_view(scale: float = 2.0, lift: float = 2.0, shrink: dict[str, float] | None = None) -> str:
    inner = f"SELECT rec_id, s, e, vec_id, quiet, {sql_scores(scale)}, {sql_semantic(lift)} FROM vectors"
    if not shrink:
        return inner
    swap = ", ".join(f"{n} * {f} AS {n}" for n, f in shrink.items())
    return f"SELECT * REPLACE ({swap}) FROM ({inner})"


def with_views(body: str, /, *names: str, **extra: str) -> str:
    """Prefix a query with the views it needs (and with own views, in order)."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in wanted] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def sql_merge(source: str, gap="0", key: str = "rec_id") -> str:
    """Merged runs of a relation (key, s, e), the classic two window passes."""
    seen = f"max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (
        f"SELECT {key}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY {key} ORDER BY s, e "
        f"ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT {key}, s, e, CASE WHEN s - {seen} <= {gap} THEN 0 ELSE 1 END AS f "
        f"FROM (SELECT DISTINCT {key}, s, e FROM {source} WHERE e > s))) GROUP BY {key}, run"
    )


def sql_gaps(merged: str, universe: str, key: str = "rec_id") -> str:
    """Gaps of merged runs inside [lo, hi] of the universe relation (key, lo, hi)."""
    return (
        f"SELECT {key}, lo AS s, hi AS e FROM (SELECT {key}, greatest(lo, coalesce(max(e) OVER (PARTITION BY {key} ORDER BY s, e "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS lo, least(s, hi) AS hi FROM ("
        f"SELECT u.{key}, m.s, m.e, u.lo, u.hi FROM {universe} u JOIN {merged} m ON m.{key} = u.{key} "
        f"UNION ALL SELECT {key}, hi, hi, lo, hi FROM {universe})) WHERE hi > lo"
    )
