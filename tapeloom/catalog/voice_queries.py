"""Voice: refined windows, very strong contexts, supported utterances and expressive breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as p
from ..operators import evidence as ev
from ..operators import grids
from ..operators import transcript as tr
from .evidence_queries import _REST, C, SECONDS, _SAID_PATTERN, announcements, impacts, micros, sql_extend
from .fixtures import described, scored_view, sql_merge, voiced, with_views
from .label_queries import KIND, STRONG, W, windows
from .registry import query
from .transcript_queries import _GENERIC, _OUTCOME, OUTRO, SYLLABLES, aligned, clean

_FINE = (
    "SELECT DISTINCT f.rec_id, f.a AS s, f.b AS e, "
    + STRONG.replace("lexical", "t.lexical").replace("expressive", "t.expressive").replace("(speech", "(t.speech").replace("soft_laugh", "t.soft_laugh")
    .replace("'t.soft_laugh'", "'soft_laugh'").replace("loud_laugh", "t.loud_laugh").replace("'t.loud_laugh'", "'loud_laugh'").replace("laughter", "t.laughter")
    + " AS strong FROM (SELECT rec_id, s + i AS a, least(s + i + 2.0, e) AS b FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS i FROM w WHERE "
    + STRONG
    + ")) f JOIN w t ON t.rec_id = f.rec_id AND t.s = f.a"
)
# Expressive voice is scaled so that breaks do not fill whole recordings.
_EASED = _REST | {"expressive": 0.75}
# Utterances that the transcript leaves uncertain, at the window whose scores decide on them; a
# turn is minutes long and a recording of vectors is short, so the clock runs at a sixteenth.
_TOLD = dict(
    doubt="SELECT rec_id * 8 + turn AS k, text, s AS a, e AS z, cr, lp, wp FROM p WHERE NOT accepted AND ((aligned AND lexical) OR (e > s AND lp > -1.85 AND NOT generic))",
    told=f"SELECT w.rec_id, w.s, w.s + (z - a) / 16 AS e FROM doubt JOIN w ON w.vec_id = k % (SELECT count(*) FROM embeddings) WHERE NOT {_GENERIC} AND cr <= 2.5 AND z > a AND lp > -1.85 AND wp >= 0.25 "
    f"AND (speech >= 0.24 OR expressive >= 0.20) AND NOT (({KIND}) IS NOT NULL AND regexp_matches(lower({clean('text')}), '\\A(?:ha|he|hi|ho|ah|哈|呵|嘻|嘿|하|허|히|호|흐|ㅎ|ㅋ)+\\z'))",
)


@query(
    "evidence_voice_intervals",
    with_views(
        SECONDS + "m",
        "vectors",
        "segments",
        "voiced",
        w=W,
        fine=_FINE,
        fs="SELECT rec_id, s, e FROM fine WHERE strong",
        fm=sql_merge("fs", "0.35"),
        alone=f"SELECT rec_id, s, e FROM w WHERE {STRONG} AND greatest(speech, expressive) >= 0.85 AND NOT EXISTS (SELECT 1 FROM fm WHERE fm.rec_id = w.rec_id AND fm.s < w.e AND fm.e > w.s)",
        **_OUTCOME,
        **_TOLD,
        lw=scored_view(1.5, 2.0, _EASED),
        hits="SELECT rec_id, s, e FROM lw WHERE expressive >= 0.42",
        hm=sql_merge("hits"),
        **sql_extend("hm", "lw"),
        parts="SELECT * FROM fm UNION ALL SELECT * FROM alone UNION ALL SELECT * FROM told UNION ALL SELECT rec_id, s, e FROM ext",
        m=sql_merge("parts", "0.65"),
    ),
)
def evidence_voice_intervals(spark, sf):
    return micros(voices(spark, sf))


def voices(spark, sf):
    w = windows(spark, sf)
    suspects = w.where(p.is_strong_voice(p.Scores.of(w))).select("rec_id", "start", "end")
    wanted = grids.hop_windows(suspects, 2.0, 1.0, 0.4).distinct()
    # The supplied vectors stand in for the fine scores: the vector that starts with the window.
    fine = wanted.join(w.drop("end"), ["rec_id", "start"])
    breaks = ev.expressive_breaks(described(spark, sf, 1.5, _EASED), chunk=C)
    return ev.voice_intervals(w, fine, told(spark, sf, w), breaks, chunk=C)


def told(spark, sf, w):
    """Uncertain utterances that the sound of their window supports."""
    rows = aligned(spark, sf).withColumn("pass", F.when(F.pmod("turn", F.lit(4)) >= 2, "continuous").otherwise("vad"))
    doubt = tr.classify_segments(rows, voiced(spark, sf), ["turn"], chunk=30.0, outro=OUTRO, syllables=SYLLABLES).where("outcome = 'uncertain'")
    doubt = doubt.withColumn("vec_id", F.pmod(F.col("rec_id") * 8 + F.col("turn"), F.lit(w.count()))).drop("rec_id")
    scores = w.withColumnRenamed("start", "_at").drop("end", "quiet")
    rows = doubt.join(scores, "vec_id")
    heard = tr.is_supported_utterance(tr.Segment(rows, OUTRO, SYLLABLES), p.Scores.of(rows))
    return rows.where(heard).select("rec_id", F.col("_at").alias("start"), (F.col("_at") + (F.col("end") - F.col("start")) / 16).alias("end"))


@query("evidence_category_report")
def evidence_category_report(spark, sf):
    """All categories of one window table; most have a SQL check of their own above."""
    w = windows(spark, sf)
    voice = voices(spark, sf)
    report = ev.category_report(w, announcements(spark, sf), impacts(spark, sf, w), chunk=C, drink_pattern=_SAID_PATTERN, voice=voice)
    return micros(report, "category")
