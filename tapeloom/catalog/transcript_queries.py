"""Transcript operators over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.clock import format_clock, format_short_clock
from ..functions.predicates import Scores
from ..functions.vocabulary import DRINK_PATTERN, OUTRO_PATTERN, SYLLABLE_PATTERN
from ..operators import transcript as tr
from .evidence_queries import micros
from .fixtures import days, scored_view, segments, spans, sql_merge, sql_us, table, us, voiced, with_views
from .label_queries import KIND, W, windows
from .registry import query

# The closing phrases and syllables of real transcripts do not occur in this prose, so the
# catalog looks for license lines and short vowel groups as well as for the fixed patterns.
OUTRO = OUTRO_PATTERN + "|copyright|license|whou|queux"
SYLLABLES = SYLLABLE_PATTERN + "|(?:an|on|the|que|la|ou){1,3}"
DRINK = DRINK_PATTERN + r"|th(?:er|an)\s+wh"
SQL_CLEAN = r"regexp_replace({}, '[^\p{{L}}\p{{N}}]+', '', 'g')"


def clean(column: str) -> str:
    return SQL_CLEAN.format(column)


def sq(pattern: str) -> str:
    return "'(?i)(?:" + pattern.replace("'", "''") + ")'"


def whole(pattern: str) -> str:
    return "'(?i)\\A(?:" + pattern.replace("'", "''") + ")\\z'"


@query("text_normalize", f"SELECT doc_id, length({clean('text')}) AS n, md5({clean('text')}) AS digest FROM documents")
def text_normalize(spark, sf):
    c = tx.normalize_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c).alias("digest"))


@query(
    "text_patterns",
    f"SELECT conv_id, turn, regexp_matches(text, {sq(OUTRO)}) AS outro, regexp_matches({clean('text')}, {whole(SYLLABLES)}) AS syllables, "
    f"regexp_matches(text, {sq(DRINK)}) AS drink FROM conversations",
)
def text_patterns(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(
        "conv_id",
        "turn",
        tx.is_generic_outro(F.col("text"), OUTRO).alias("outro"),
        tx.is_nonlexical(tx.normalize_text(F.col("text")), SYLLABLES).alias("syllables"),
        tx.announces_drink(F.col("text"), DRINK).alias("drink"),
    )


@query("text_outro_documents", f"SELECT doc_id FROM documents WHERE regexp_matches(text, {sq(OUTRO)})")
def text_outro_documents(spark, sf):
    return table(spark, sf, "documents").where(tx.is_generic_outro(F.col("text"), OUTRO)).select("doc_id")


@query(
    "text_nonlexical_words",
    with_views(f"SELECT rec_id, turn, i, word FROM words WHERE regexp_matches({clean('word')}, {whole(SYLLABLES)})", "words"),
)
def text_nonlexical_words(spark, sf):
    s = segments(spark, sf).select("rec_id", "turn", F.posexplode("words").alias("i", "w"))
    hit = tx.is_nonlexical(tx.normalize_text(F.col("w.word")), SYLLABLES)
    return s.where(hit).select("rec_id", "turn", F.col("i").cast("long").alias("i"), F.col("w.word").alias("word"))


@query(
    "text_clock",
    with_views(
        "SELECT id, format('{:02d}:{:02d}:{:02d}.{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock, "
        "format('{:02d}:{:02d}:{:02d}', c // 3600, c // 60 % 60, c % 60) AS short FROM (SELECT id, CAST(round_even(s / 1000000.0::DOUBLE * 1000, 0) AS BIGINT) AS ms, "
        "CAST(floor(s / 1000000.0::DOUBLE) AS BIGINT) AS c FROM spans)",
        "spans",
    ),
)
def text_clock(spark, sf):
    s = spans(spark, sf).select("id", (F.col("start") / 1e6).alias("t"))
    return s.select("id", format_clock(F.col("t")).alias("clock"), format_short_clock(F.col("t")).alias("short"))


# Alignment: a fifth of the assistant turns get a stretched word, some words collapse.
def aligned(spark, sf):
    s = segments(spark, sf)
    odd = F.pmod(F.length("text"), F.lit(5)) == 0
    words = F.transform(
        "words",
        lambda w, i: w.withField(
            "end",
            F.when(odd & (i == 1), w["start"] + 12.0).when(F.pmod(F.length(w["word"]) + F.length("text"), F.lit(3)) == 0, w["start"]).otherwise(w["end"]),
        ),
    )
    return s.withColumn("words", words)


_ALIGNED_WORDS = (
    "SELECT rec_id, turn, text, i, word, ws AS a, CASE WHEN length(text) % 5 = 0 AND i = 1 THEN ws + 12.0::DOUBLE WHEN (length(word) + length(text)) % 3 = 0 THEN ws ELSE we END AS z FROM timed_words"
)
_ISSUE = dict(
    aw=_ALIGNED_WORDS,
    valid="SELECT * FROM aw WHERE z > a",
    stats=f"SELECT rec_id, turn, count(*) AS n, bool_or(z - a > greatest(6.0::DOUBLE, length({clean('word')}) * 1.5::DOUBLE)) AS stretched FROM valid GROUP BY rec_id, turn",
    k="SELECT rec_id * 1000 + turn AS rec_id, a AS s, z AS e FROM valid",
    mk=sql_merge("k"),
    cover="SELECT rec_id, sum(e - s) AS c FROM mk GROUP BY rec_id",
    issue="SELECT s.rec_id, s.turn, CASE WHEN s.n_words = 0 OR s.e <= s.s THEN 'invalid span' WHEN coalesce(st.n, 0) < s.total * 0.6::DOUBLE THEN 'few valid words' "
    f"WHEN coalesce(st.stretched, FALSE) THEN 'stretched word' WHEN s.e - s.s < 0.18::DOUBLE OR length({clean('s.text')}) / greatest(coalesce(c.c, 0), 1e-6) > 30 THEN 'text does not fit span' END AS issue "
    "FROM segments s LEFT JOIN stats st ON st.rec_id = s.rec_id AND st.turn = s.turn LEFT JOIN cover c ON c.rec_id = s.rec_id * 1000 + s.turn",
)


@query(
    "transcript_alignment_issue",
    with_views("SELECT rec_id, turn, coalesce(issue, 'ok') AS issue FROM issue", "segments", **_ISSUE),
)
def transcript_alignment_issue(spark, sf):
    df = aligned(spark, sf)
    return df.select("rec_id", "turn", F.coalesce(tr.Segment(df).alignment_issue, F.lit("ok")).alias("issue"))


_GENERIC = f"regexp_matches(text, {sq(OUTRO)})"
_LEXICAL = f"length({clean('text')}) > 0 AND NOT regexp_matches({clean('text')}, {whole(SYLLABLES)}) AND NOT {_GENERIC}"
_OUTCOME = dict(
    **_ISSUE,
    mv=sql_merge("voiced"),
    ov="SELECT s.rec_id, s.turn, coalesce(sum(CASE WHEN v.s IS NOT NULL THEN least(s.e, v.e) - greatest(s.s, v.s) END), 0) AS o FROM segments s LEFT JOIN mv v ON v.rec_id = s.rec_id AND v.s < s.e AND s.s < v.e GROUP BY s.rec_id, s.turn",
    f="SELECT s.*, o.o, i.issue, s.p_sum / greatest(1, s.n_words) AS wp, s.turn % 4 >= 2 AS cont FROM segments s JOIN ov o ON o.rec_id = s.rec_id AND o.turn = s.turn JOIN issue i ON i.rec_id = s.rec_id AND i.turn = s.turn",
    p=f"SELECT *, {_LEXICAL} AS lexical, {_GENERIC} AS generic, CASE WHEN aligned THEN ({_LEXICAL}) AND issue IS NULL ELSE "
    f"length({clean('text')}) > 0 AND NOT regexp_matches({clean('text')}, {whole(SYLLABLES)}) AND e > s AND cr <= 2.5 "
    f"AND NOT ({_GENERIC} AND (o < 0.5 OR n_words = 0 OR coalesce(p_first, 0) < 0.4)) AND "
    f"CASE WHEN cont THEN (lp > -1.2 AND wp > 0.35 AND length({clean('text')}) >= 4) OR (lp > -0.8 AND wp > 0.5) OR (o > 0.5 AND lp > -1.65 AND wp > 0.25) "
    "ELSE (lp > -1.65 AND wp > 0.18) OR (wp > 0.35 AND lp > -1.85) END END AS accepted FROM f",
)


@query(
    "transcript_classify_segments",
    with_views(
        "SELECT rec_id, turn, CASE WHEN accepted THEN 'accepted' WHEN (aligned AND lexical) OR (e > s AND lp > -1.85 AND NOT generic) THEN 'uncertain' ELSE 'rejected' END AS outcome, "
        "(NOT accepted AND aligned AND lexical) AS review_only, CASE WHEN NOT accepted AND aligned AND lexical THEN issue ELSE 'none' END AS reason FROM p",
        "segments",
        "voiced",
        **_OUTCOME,
    ),
)
def transcript_classify_segments(spark, sf):
    df = aligned(spark, sf).withColumn("pass", F.when(F.pmod("turn", F.lit(4)) >= 2, "continuous").otherwise("vad"))
    out = tr.classify_segments(df, voiced(spark, sf), ["turn"], chunk=30.0, outro=OUTRO, syllables=SYLLABLES)
    return out.select("rec_id", "turn", "outcome", "review_only", F.coalesce("reason", F.lit("none")).alias("reason"))


@query(
    "transcript_review_speech",
    with_views(
        f"SELECT rec_id, turn, CASE WHEN aligned THEN ({_LEXICAL}) AND issue IS NULL ELSE length({clean('text')}) > 0 AND NOT regexp_matches({clean('text')}, {whole(SYLLABLES)}) "
        f"AND cr <= 2.5 AND NOT ({_GENERIC} AND wp < 0.75) AND e > s AND ns < 0.85 AND lp > -1.4 AND wp >= 0.30 END AS speech FROM f",
        "segments",
        "voiced",
        **_OUTCOME,
    ),
)
def transcript_review_speech(spark, sf):
    df = aligned(spark, sf)
    return df.select("rec_id", "turn", tr.is_review_speech(tr.Segment(df, OUTRO, SYLLABLES)).alias("speech"))


@query(
    "transcript_word_intervals",
    with_views(
        f'SELECT rec_id, {sql_us("s")} AS start, {sql_us("e")} AS "end" FROM m',
        "segments",
        aw=_ALIGNED_WORDS,
        k="SELECT rec_id * 1000 + turn AS rec_id, a AS s, z AS e FROM aw WHERE z > a",
        # Gap 0.9 inside a segment, in word order; the words are in time order here.
        g=sql_merge("k", "0.9"),
        u="SELECT rec_id // 1000 AS rec_id, s, e FROM g UNION ALL SELECT s.rec_id, s.s, s.e FROM segments s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.rec_id = s.rec_id * 1000 + s.turn)",
        m=sql_merge("u", "0.65"),
    ),
)
def transcript_word_intervals(spark, sf):
    return micros(tr.word_intervals(aligned(spark, sf), chunk=30.0))


@query(
    "transcript_supported_utterance",
    with_views(
        f"SELECT f.rec_id, f.turn, (NOT {_GENERIC} AND cr <= 2.5 AND NOT (({KIND}) IS NOT NULL AND regexp_matches(lower({clean('text')}), '\\A(?:ha|he|hi|ho|ah|哈|呵|嘻|嘿|하|허|히|호|흐|ㅎ|ㅋ)+\\z')) "
        "AND f.e > f.s AND lp > -1.85 AND wp >= 0.25 AND (speech >= 0.24 OR expressive >= 0.20)) AS supported FROM f JOIN w ON w.vec_id = (f.rec_id * 8 + f.turn) % (SELECT count(*) FROM embeddings)",
        "vectors",
        "segments",
        "voiced",
        **_OUTCOME,
        w=W,
    ),
)
def transcript_supported_utterance(spark, sf):
    df = aligned(spark, sf)
    scores = windows(spark, sf).drop("rec_id", "start", "end", "quiet")
    rows = df.withColumn("vec_id", F.pmod(F.col("rec_id") * 8 + F.col("turn"), F.lit(scores.count()))).join(scores, "vec_id")
    return rows.select("rec_id", "turn", tr.is_supported_utterance(tr.Segment(rows, OUTRO, SYLLABLES), Scores.of(rows)).alias("supported"))


@query(
    "transcript_utterance_windows",
    with_views(
        f"SELECT rec_id, turn, {sql_us('greatest(0, s - 0.4::DOUBLE)')} AS a, {sql_us('least(75.0::DOUBLE, greatest(e, s + 1.0::DOUBLE) + 0.4::DOUBLE)')} AS z FROM segments",
        "segments",
    ),
)
def transcript_utterance_windows(spark, sf):
    rows = tr.utterance_windows(segments(spark, sf), F.lit(75.0))
    return rows.select("rec_id", "turn", us(F.col("window_start")).alias("a"), us(F.col("window_end")).alias("z"))


@query(
    "transcript_dedupe_last",
    "SELECT lang, source, max(doc_id) AS doc_id, max_by(n_chars, doc_id) AS n_chars FROM documents GROUP BY lang, source",
)
def transcript_dedupe_last(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return tr.dedupe_last(d, ["lang", "source"], "doc_id").select("lang", "source", "doc_id", "n_chars")


@query(
    "transcript_announced_intent",
    with_views(f"SELECT rec_id, {sql_us('e')} AS said FROM segments WHERE regexp_matches(text, {sq(DRINK)})", "segments"),
)
def transcript_announced_intent(spark, sf):
    rows = tr.announced_intent(segments(spark, sf), pattern=DRINK)
    return rows.select("rec_id", us(F.col("said")).alias("said"))


@query(
    "transcript_shift_clock",
    with_views(
        f"SELECT s.rec_id, s.turn, {sql_us('s.s + s.rec_id * 300')} AS start, {sql_us('s.e + s.rec_id * 300')} AS \"end\", coalesce(w.t, 0) AS words FROM segments s "
        "LEFT JOIN (SELECT rec_id, turn, CAST(sum(u) AS BIGINT) AS t FROM (SELECT *, CAST(round((ws + rec_id * 300.0::DOUBLE) * 1000000) AS BIGINT) + CAST(round((we + rec_id * 300.0::DOUBLE) * 1000000) AS BIGINT) AS u FROM timed_words) GROUP BY rec_id, turn) w ON w.rec_id = s.rec_id AND w.turn = s.turn",
        "segments",
    ),
)
def transcript_shift_clock(spark, sf):
    rows = tr.shift_clock(segments(spark, sf), F.col("rec_id") * 300.0)
    # Times are summed as whole microseconds: a sum of doubles would depend on the order.
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + us(w["start"]) + us(w["end"]))
    return rows.select("rec_id", "turn", us(F.col("start")).alias("start"), us(F.col("end")).alias("end"), total.alias("words"))


_LANG = "CASE conv_id % 5 WHEN 0 THEN 'Korean' WHEN 1 THEN 'Japanese' WHEN 2 THEN 'French' WHEN 3 THEN 'English' ELSE '' END"


@query(
    "transcript_pick_language",
    f"SELECT conv_id AS rec_id, CASE min_by(l, turn) FILTER (l != '' AND turn % 3 = 1) WHEN 'Korean' THEN 'ko' WHEN 'Japanese' THEN 'ja' WHEN 'English' THEN 'en' ELSE 'auto' END AS language "
    f"FROM (SELECT conv_id, turn, {_LANG} AS l FROM conversations) GROUP BY conv_id",
)
def transcript_pick_language(spark, sf):
    c = table(spark, sf, "conversations")
    n = F.pmod("conv_id", F.lit(5))
    lang = F.when(n == 0, "Korean").when(n == 1, "Japanese").when(n == 2, "French").when(n == 3, "English").otherwise("")
    said = F.when(F.pmod("turn", F.lit(3)) == 1, F.col("text")).otherwise("  ")
    rows = c.select(F.col("conv_id").alias("rec_id"), "turn", said.alias("text"), lang.alias("language"))
    return tr.pick_language(rows, "turn")
