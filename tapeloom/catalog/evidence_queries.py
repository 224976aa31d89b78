"""Evidence runs over scored windows."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from ..functions import predicates as p
from ..operators import evidence as ev
from ..operators import grids
from ..operators import intervals as iv
from ..operators import signal
from .fixtures import HOP_CHUNK, described, hop_recordings, scored_view, sql_merge, sql_us, us, vectors, with_views
from .label_queries import (
    CALM_W, KIND, SOUND, STRONG, TEXTURE, W, WHISPER, WHISPERED, _QUIETER, _textured, calm, dull, RESIDUE, semantic_positive_sql, windows,
)
from .registry import query

C = HOP_CHUNK
SECONDS = f'SELECT rec_id, {sql_us("s")} AS start, {sql_us("e")} AS "end" FROM '


def micros(df, *more):
    return df.select("rec_id", us(F.col("start")).alias("start"), us(F.col("end")).alias("end"), *more)


def sql_runs(source: str, ok: str, apart: str, key: str = "rec_id") -> str:
    """Rows of supported windows with a run number; an unsupported row always separates."""
    w = f"OVER (PARTITION BY {key} ORDER BY s, e)"
    return (
        f"SELECT * FROM (SELECT *, sum(CASE WHEN ps IS NULL OR NOT pok OR NOT ok OR ({apart}) THEN 1 ELSE 0 END) "
        f"OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(s) {w} AS ps, lag(e) {w} AS pe, "
        f"lag(ok) {w} AS pok FROM (SELECT *, ({ok}) AS ok FROM {source}))) WHERE ok"
    )


def _rhythm(ok):
    return dict(
        r=sql_runs("w", ok, "s > pe"),
        x="SELECT rec_id, min(s) AS s, max_by(e, s) AS e FROM r GROUP BY rec_id, run HAVING count(*) >= 2",
        m=sql_merge("x"),
    )


@query("evidence_heartbeat_runs", with_views(SECONDS + "m", "vectors", w=W, **_rhythm("NOT quiet AND heartbeat >= 0.20")))
def evidence_heartbeat_runs(spark, sf):
    return micros(ev.rhythmic_runs(windows(spark, sf), "heartbeat", chunk=C))


@query(
    "evidence_tapping_runs",
    with_views(SECONDS + "m", "vectors", w=W, **_rhythm("NOT quiet AND tapping >= 0.25 AND impact < 0.35 AND tapping >= mouth * 0.8")),
)
def evidence_tapping_runs(spark, sf):
    return micros(ev.rhythmic_runs(windows(spark, sf), "tapping", chunk=C))


@query(
    "evidence_texture_regions",
    with_views(
        f'SELECT rec_id, {sql_us("s2")} AS start, {sql_us("e2")} AS "end", n AS windows, {sql_us("t")} AS min_texture FROM ('
        "SELECT rec_id, run, count(*) AS n, list(s ORDER BY s)[2] AS s2, list(e ORDER BY s DESC)[2] AS e2, min(texture) AS t "
        "FROM r GROUP BY rec_id, run HAVING count(*) >= 2) WHERE e2 - s2 >= 3",
        "vectors",
        w=scored_view(2.0, 2.0, _QUIETER),
        r=sql_runs("w", TEXTURE, "s - ps > 2.1"),
    ),
)
def evidence_texture_regions(spark, sf):
    found = ev.texture_regions(_textured(spark, sf), chunk=C)
    return micros(found, "windows", F.round(F.col("min_texture_score") * 1e6).cast("long").alias("min_texture"))


_SEMANTIC = dict(
    w=CALM_W,
    r=sql_runs("w", semantic_positive_sql(0.17, 0.005), "s > pe + 0.000001"),
    x="SELECT rec_id, min(s) + 1.5 AS s, max(e) - 1.5 AS e, count(*) AS n, "
    f"count(*) FILTER ({semantic_positive_sql(0.20, 0.025)}) AS seeds FROM r GROUP BY rec_id, run",
    good="SELECT * FROM x WHERE n >= 2 AND seeds >= 2",
)


@query(
    "evidence_semantic_regions",
    with_views(
        f'SELECT rec_id, {sql_us("s")} AS start, {sql_us("e")} AS "end", n AS windows, seeds AS strong_windows FROM good', "vectors", **_SEMANTIC
    ),
)
def evidence_semantic_regions(spark, sf):
    return micros(ev.semantic_regions(calm(spark, sf), chunk=C), "windows", "strong_windows")


_REGIONS = "SELECT rec_id, floor(s / 30) * 30 + 1.0 AS s, least(max(e), floor(s / 30) * 30 + 29.0) AS e FROM w GROUP BY rec_id, floor(s / 30)"


@query(
    "evidence_confirmed_regions",
    with_views(
        f'SELECT rec_id, {sql_us("s")} AS start, {sql_us("e")} AS "end", n AS windows FROM ('
        "SELECT rec_id, min(s) + CASE WHEN abs(min(s) - l) < 0.000001 THEN 0 ELSE 1 END AS s, "
        "max_by(e, s) - CASE WHEN abs(max_by(e, s) - r) < 0.000001 THEN 0 ELSE 1 END AS e, count(*) AS n FROM runs "
        "GROUP BY rec_id, l, r, run HAVING count(*) >= 2) WHERE e - s >= 1",
        "vectors",
        w=CALM_W,
        fine="SELECT * REPLACE (s + 3 AS e) FROM w UNION ALL SELECT * REPLACE (s + 1 AS s, s + 4 AS e) FROM w",
        regions="SELECT rec_id, floor(s / 30) * 30 + 1.0 AS l, floor(s / 30) * 30 + 29.0 AS r FROM w GROUP BY rec_id, floor(s / 30)",
        held="SELECT fine.*, l, r FROM fine JOIN regions g ON g.rec_id = fine.rec_id AND fine.s >= l AND fine.e <= r",
        runs=sql_runs("held", WHISPER.format(context="TRUE"), "s > ps + 1.01", "rec_id, l"),
    ),
)
def evidence_confirmed_regions(spark, sf):
    w = calm(spark, sf)
    slot = F.floor(F.col("start") / 30) * 30.0
    regions = w.select("rec_id", (slot + 1.0).alias("start"), (slot + 29.0).alias("end")).distinct()
    early = w.withColumn("end", F.col("start") + 3.0)
    late = w.withColumn("end", F.col("start") + 4.0).withColumn("start", F.col("start") + 1.0)
    fine = early.unionByName(late).withColumn("whisper_context", F.lit(True))
    return micros(ev.confirmed_regions(fine, regions, chunk=C), "windows")


# Airflow needs breath and a release label; texture is scaled down so that breath can dominate.
_AIRY = {"texture": 0.4, "mouth": 0.4}
_AIR_W = scored_view(2.0, 2.0, _AIRY)
_NEAR = "list_filter(ctx, lambda x: x.lo <= e + 6 AND x.hi >= s - 6)"


def _fold(rows: str, lo: str, hi: str) -> str:
    """Grow [lo, hi] over ordered rows (lo, hi, st) until the first one that stops."""
    return (
        f"list_reduce(list_concat([{{'lo': CAST({lo} AS DOUBLE), 'hi': CAST({hi} AS DOUBLE), 'st': FALSE}}], {rows}), lambda a, x: "
        "CASE WHEN a.st OR x.st OR x.lo > a.hi + 2 OR x.hi < a.lo - 2 THEN {'lo': a.lo, 'hi': a.hi, 'st': TRUE} "
        "ELSE {'lo': least(a.lo, x.lo), 'hi': greatest(a.hi, x.hi), 'st': FALSE} END)"
    )


_AIR_STOP = "(texture >= 0.10 AND texture > greatest(breath, airflow) * 1.5) OR breath < 0.055 OR breath < texture * 1.5"
_ITEM = "{'lo': s, 'hi': e, 'st': " + f"({_AIR_STOP})" + "}"
_AIR = dict(
    w=_AIR_W,
    c="SELECT *, list({'lo': s, 'hi': e, 'breath': breath, 'air': airflow}) OVER (PARTITION BY rec_id ORDER BY s, e ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS ctx, "
    f"list({_ITEM}) OVER (PARTITION BY rec_id ORDER BY s, e ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS prev, "
    f"list({_ITEM}) OVER (PARTITION BY rec_id ORDER BY s, e ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS nxt FROM w",
    seeds=f"SELECT *, {_NEAR} AS near FROM c",
    hits="SELECT * FROM seeds WHERE airflow >= 0.16 AND list_max(list_transform(near, lambda x: x.breath)) >= 0.09 AND airflow >= mouth * 1.7 "
    "AND (spray >= 0.12 OR steam >= 0.10 OR (hiss >= 0.18 AND sizzle >= 0.035)) AND len(list_filter(near, lambda x: x.air >= 0.10)) >= 2",
    g1=f"SELECT rec_id, nxt, {_fold('coalesce(list_reverse(prev), [])', 's', 'e')} AS g FROM hits",
    x=f"SELECT rec_id, g2.lo AS s, g2.hi AS e FROM (SELECT rec_id, {_fold('coalesce(nxt, [])', 'g.lo', 'g.hi')} AS g2 FROM g1)",
    m=sql_merge("x", "2.0"),
)


def airy(spark, sf):
    return described(spark, sf, 2.0, _AIRY)


@query("evidence_airflow_events", with_views(SECONDS + "m", "vectors", **_AIR))
def evidence_airflow_events(spark, sf):
    return micros(ev.airflow_events(airy(spark, sf), chunk=C))


# Announcements: turns of conversations, placed on the recordings of the vectors.
SAY = "ou|the"
_SAID = "SELECT conv_id % 10 AS rec_id, turn * 12.0::DOUBLE AS t FROM conversations WHERE regexp_matches(text, '(?i)zz|qu[^a-z]|wh[aeiou]n')"
_SAID_PATTERN = r"zz|qu[^a-z]|wh[aeiou]n"


def announcements(spark, sf):
    from .fixtures import table

    c = table(spark, sf, "conversations")
    t = F.col("turn") * 12.0
    return c.select(F.pmod("conv_id", F.lit(10)).alias("rec_id"), (t - 1).alias("start"), t.alias("end"), "text")


_DRY = {"container": 0.5, "gargle": 0.3, "liquid": 0.5, "mouth": 0.3}
_DRINK = dict(
    w=scored_view(1.0, 2.0, _DRY),
    said=_SAID,
    c="SELECT *, list_filter(list({'lo': s, 'hi': e, 'c': container, 'o': greatest(gargle, mouth)}) OVER (PARTITION BY rec_id ORDER BY s, e ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), "
    "lambda x: x.lo <= e + 6 AND x.hi >= s - 6) AS near FROM w",
    x="SELECT rec_id, s, e FROM c WHERE (list_max(list_transform(near, lambda x: x.c)) >= 0.13 AND ((liquid >= 0.15 AND list_max(list_transform(near, lambda x: x.o)) >= 0.10) OR gargle >= 0.16)) "
    "OR (greatest(liquid, gargle) >= 0.075 AND EXISTS (SELECT 1 FROM said WHERE said.rec_id = c.rec_id AND c.s - said.t BETWEEN -2 AND 25))",
    m=sql_merge("x", "2.0"),
)


def dry(spark, sf):
    return described(spark, sf, 1.0, _DRY)


@query("evidence_drinking_events", with_views(SECONDS + "m", "vectors", **_DRINK))
def evidence_drinking_events(spark, sf):
    return micros(ev.drinking_events(dry(spark, sf), announcements(spark, sf), chunk=C, pattern=_SAID_PATTERN))


_COMPETING = "greatest(breath, airflow, liquid, gargle, expressive, laughter, soft_laugh, loud_laugh)"
_REST_STOP = (
    f"(texture >= 0.12 AND texture > {_COMPETING} * 1.5) OR (NOT quiet AND {_COMPETING} < 0.055 AND container < 0.10)"
)
# Break growth: windows every 6 s (no overlap) and weaker scores, so that every stop rule fires.
_REST = {n: 0.25 for n in ("breath", "airflow", "liquid", "gargle", "laughter", "expressive", "soft_laugh", "loud_laugh")} | {"container": 0.5, "texture": 0.3}


def sql_extend(events: str, rows: str = "w") -> dict[str, str]:
    item = "{'lo': w.s, 'hi': w.e, 'st': w.st}"
    return dict(
        stops=f"SELECT rec_id, s, e, ({_REST_STOP}) AS st FROM {rows}",
        lefts=f"SELECT v.rec_id, v.s, v.e, list({item} ORDER BY w.s DESC, w.e DESC) FILTER (w.s IS NOT NULL) AS l FROM {events} v LEFT JOIN stops w "
        "ON w.rec_id = v.rec_id AND w.e BETWEEN v.s - 24 AND v.s + 2 GROUP BY ALL",
        around=f"SELECT v.rec_id, v.s, v.e, any_value(l) AS l, list({item} ORDER BY w.s, w.e) FILTER (w.s IS NOT NULL) AS r FROM lefts v LEFT JOIN stops w "
        "ON w.rec_id = v.rec_id AND w.s BETWEEN v.e - 2 AND v.e + 24 GROUP BY v.rec_id, v.s, v.e",
        grown1=f"SELECT rec_id, r, {_fold('coalesce(l, [])', 's', 'e')} AS g FROM around",
        grown2=f"SELECT rec_id, {_fold('coalesce(r, [])', 'g.lo', 'g.hi')} AS g FROM grown1",
        grown="SELECT rec_id, g.lo AS s, g.hi AS e FROM grown2",
        ext=sql_merge("grown"),
    )


_REST_W = scored_view(2.0, 2.0, _REST)


def resting(spark, sf):
    return described(spark, sf, 2.0, _REST)


@query(
    "evidence_extend_breaks",
    with_views(
        SECONDS + "ext",
        "vectors",
        w=_REST_W,
        events="SELECT rec_id, s + 2.5 AS s, e - 1.5 AS e FROM w WHERE soft_laugh >= 0.07",
        **sql_extend("events"),
    ),
)
def evidence_extend_breaks(spark, sf):
    w = resting(spark, sf)
    events = w.where("soft_laugh >= 0.07").select("rec_id", (F.col("start") + 2.5).alias("start"), (F.col("end") - 1.5).alias("end"))
    return micros(ev.extend_breaks(events, w, chunk=C))


# Laughter and expressive voice stay strong; what grows them is scaled as above.
_LAUGH = {n: f for n, f in _REST.items() if n not in ("soft_laugh", "loud_laugh", "laughter", "expressive")}
_LAUGH_W = scored_view(2.0, 2.0, _LAUGH)


def laughing(spark, sf):
    return described(spark, sf, 2.0, _LAUGH)


def _grown(condition: str) -> dict[str, str]:
    return dict(w=_LAUGH_W, hits=f"SELECT rec_id, s, e FROM w WHERE {condition}", hm=sql_merge("hits"), **sql_extend("hm"))


@query("evidence_soft_laughter", with_views(SECONDS + "ext", "vectors", **_grown(f"({KIND}) = 'soft_laugh'")))
def evidence_soft_laughter(spark, sf):
    return micros(ev.laughter_events(laughing(spark, sf), "soft_laugh", chunk=C))


@query("evidence_loud_laughter", with_views(SECONDS + "ext", "vectors", **_grown(f"({KIND}) = 'loud_laugh'")))
def evidence_loud_laughter(spark, sf):
    return micros(ev.laughter_events(laughing(spark, sf), "loud_laugh", chunk=C))


@query("evidence_expressive_breaks", with_views(SECONDS + "ext", "vectors", **_grown("expressive >= 0.42")))
def evidence_expressive_breaks(spark, sf):
    return micros(ev.expressive_breaks(laughing(spark, sf), chunk=C))


# Impacts: vector blocks as sound at 32 samples per second, with a sharper contrast.
RATE, BLOCK, STEP = 32, 64, 0.25
_BURST = (
    "SELECT w.rec_id, w.s, w.e, w.a, w.d, r.k, r.rms, r.pk FROM w JOIN LATERAL (SELECT (x.i - lo) // 8 AS k, sqrt(avg(x.v * x.v)) AS rms, max(abs(x.v)) AS pk "
    "FROM x WHERE x.rec_id = w.rec_id AND x.i >= lo AND x.i < lo + ((hi - lo) // 8) * 8 GROUP BY 1) r ON TRUE"
)
_SHARP = "em[k]"
_IMPACT = dict(
    x="SELECT rec_id, block_idx * 64 + generate_subscripts(em, 1) - 1 AS i, unnest(em) * unnest(em) * unnest(em) * unnest(em) * 40 AS v FROM vectors",
    w="SELECT rec_id, s, e, greatest(0, s - 3) AS a, d, CAST(round_even(greatest(0, s - 3) * 32, 0) AS BIGINT) AS lo, CAST(round_even(least(d, e + 3) * 32, 0) AS BIGINT) AS hi "
    f"FROM (SELECT v.*, r.d FROM ({W}) v JOIN hop_recordings r ON r.rec_id = v.rec_id) WHERE impact >= 0.25",
    steps="SELECT w.rec_id, w.s, w.e, w.a, w.d, (x.i - w.lo) // 8 AS k, sqrt(avg(x.v * x.v)) AS rms, max(abs(x.v)) AS pk FROM w JOIN x ON x.rec_id = w.rec_id "
    "AND x.i >= w.lo AND x.i < w.hi GROUP BY ALL HAVING count(*) = 8",
    loud="SELECT * FROM (SELECT *, greatest(quantile_cont(rms, 0.65) OVER (PARTITION BY rec_id, s), 0.0004) * 4 AS lim, count(*) OVER (PARTITION BY rec_id, s) AS n FROM steps) WHERE rms > lim AND n >= 10",
    runs="SELECT rec_id, s, e, a, d, min(k) AS lo, max(k) + 1 AS hi, max(pk) AS pk, count(*) OVER (PARTITION BY rec_id, s) AS bursts FROM ("
    "SELECT *, k - row_number() OVER (PARTITION BY rec_id, s ORDER BY k) AS g FROM loud) GROUP BY rec_id, s, e, a, d, g",
    hits="SELECT rec_id, greatest(0, a + lo * 0.25 - 0.4) AS s, least(d, a + hi * 0.25 + 0.8) AS e FROM runs WHERE bursts <= 3 AND a + hi * 0.25 > s AND a + lo * 0.25 < e "
    "AND (hi - lo) * 0.25 <= 0.65 AND pk >= 0.035",
    m=sql_merge("hits", "0.4"),
)


def sharp_blocks(spark, sf):
    v = vectors(spark, sf)
    return v.select("rec_id", "block_idx", F.transform("embedding", lambda x: x * x * x * x * 40).alias("samples"))


def impacts(spark, sf, rows):
    return signal.impact_events(rows, sharp_blocks(spark, sf), hop_recordings(spark, sf), RATE, BLOCK, STEP, 1.0, chunk=C)


@query("evidence_impact_events", with_views(SECONDS + "m", "vectors", "hop_recordings", **_IMPACT))
def evidence_impact_events(spark, sf):
    return micros(impacts(spark, sf, windows(spark, sf)))


_ROLE = "CASE vec_id % 5 WHEN 0 THEN 'before' WHEN 1 THEN 'after' ELSE 'body' END"
_ACTIVE = "greatest(mouth, heartbeat, tapping, soft_laugh)"


@cache
def _mixed():
    """Half of the candidates read quiet-bodied windows, so that all decisions occur."""
    return {n: 0.35 for n in ("mouth", "heartbeat", "tapping", "soft_laugh")} | {
        "texture": 0.5, "expressive": 0.5, "impact": 0.5, "lexical": 0.6, "loud_laugh": 0.5,
    }


def _probes(spark, sf, lift=2.4):
    df = described(spark, sf, 1.2, _mixed(), lift)
    number = F.pmod("vec_id", F.lit(5))
    role = F.when(number == 0, "before").when(number == 1, "after").otherwise("body")
    return df.withColumn("candidate", F.expr("vec_id div 5")).withColumn("role", role)


_PROBES = f"SELECT *, vec_id // 5 AS candidate, {_ROLE} AS role FROM ({scored_view(1.2, 2.4, _mixed())})"


@query(
    "evidence_phase_decision",
    with_views(
        "SELECT candidate, CASE WHEN n < 3 THEN 'uncertain' WHEN active THEN 'keep_asmr' WHEN NOT stable THEN 'uncertain' WHEN residue THEN 'remove' ELSE 'uncertain' END AS decision FROM ("
        f"SELECT candidate, count(*) AS n, coalesce(bool_or(({semantic_positive_sql(0.17, 0.005)}) OR {_ACTIVE} >= 0.2) FILTER (role = 'body'), FALSE) AS active, "
        f"coalesce(bool_and({semantic_positive_sql(0.17, 0.005)}) FILTER (role != 'body'), FALSE) AS stable, coalesce(bool_and({RESIDUE}) FILTER (role = 'body'), TRUE) AS residue "
        "FROM w GROUP BY candidate)",
        "vectors",
        w=_PROBES,
    ),
)
def evidence_phase_decision(spark, sf):
    return ev.phase_decision(_probes(spark, sf), ["candidate"]).select("candidate", "decision")


@query(
    "evidence_acoustic_veto",
    with_views(
        "SELECT candidate, CASE WHEN active THEN 'keep_asmr' WHEN sound OR unstable THEN 'uncertain' ELSE 'score' END AS decision FROM ("
        f"SELECT candidate, coalesce(bool_or({_ACTIVE} >= 0.2) FILTER (role = 'body'), FALSE) AS active, "
        "coalesce(bool_or(greatest(texture, mouth, heartbeat, tapping, soft_laugh) >= 0.12) FILTER (role = 'body'), FALSE) AS sound, "
        f"coalesce(bool_or(quiet OR {STRONG} OR texture < 0.035 OR greatest(expressive, impact, loud_laugh) >= 0.3) FILTER (role != 'body'), FALSE) AS unstable FROM w GROUP BY candidate)",
        "vectors",
        w=f"SELECT * REPLACE (texture * CASE WHEN role = 'body' THEN 0.1 ELSE 1 END AS texture, mouth * 0.3 AS mouth, tapping * 0.3 AS tapping, heartbeat * 0.3 AS heartbeat, soft_laugh * 0.3 AS soft_laugh, expressive * 0.5 AS expressive) FROM ({_PROBES})",
    ),
)
def evidence_acoustic_veto(spark, sf):
    probes = _probes(spark, sf)
    for name in ("mouth", "tapping", "heartbeat", "soft_laugh"):
        probes = probes.withColumn(name, F.col(name) * 0.3)
    probes = probes.withColumn("expressive", F.col("expressive") * 0.5)
    probes = probes.withColumn("texture", F.col("texture") * F.when(F.col("role") == "body", 0.1).otherwise(1.0))
    out = ev.acoustic_veto(probes, ["candidate"])
    return out.withColumn("decision", F.coalesce("decision", F.lit("score")))


_STILL = {"voiced": 0.3, "expressive": 0.3, "whisper": 0.9}
_ARB = f"SELECT *, vec_id // 2 AS finding, CASE WHEN vec_id % 2 = 0 THEN 'context' ELSE 'probe' END AS role FROM ({scored_view(1.0, 3.0, _STILL)})"
_WC = (
    "(whisper >= 0.12 AND whisper >= voiced * 1.2 OR voiced < 0.15 AND m_whisper_asmr >= 0.45 AND m_whisper_asmr - m_normal_speech >= 0.15) "
    "AND greatest(voiced, expressive, loud_laugh, impact) < 0.35 AND m_whisper_asmr >= 0.3 AND m_whisper_asmr - m_normal_speech >= 0.04"
)


@query(
    "evidence_arbitrate",
    with_views(
        "SELECT finding, CASE WHEN heard AND wc AND ww THEN 'whisper' WHEN heard AND sc AND ss THEN 'conflict' ELSE 'speech' END AS decision FROM ("
        "SELECT finding, coalesce(bool_or(NOT quiet) FILTER (role = 'context'), FALSE) AS heard, "
        f"coalesce(bool_or({_WC}) FILTER (role = 'context'), FALSE) AS wc, coalesce(bool_or(greatest(voiced, expressive, whisper) < 0.2 AND {SOUND}) FILTER (role = 'context'), FALSE) AS sc, "
        f"coalesce(bool_and({WHISPERED}) FILTER (role != 'context'), FALSE) AS ww, coalesce(bool_and({SOUND}) FILTER (role != 'context'), FALSE) AS ss FROM w GROUP BY finding)",
        "vectors",
        w=_ARB,
    ),
)
def evidence_arbitrate(spark, sf):
    df = described(spark, sf, 1.0, _STILL, 3.0)
    role = F.when(F.pmod("vec_id", F.lit(2)) == 0, "context").otherwise("probe")
    return ev.arbitrate(df.withColumn("finding", F.expr("vec_id div 2")).withColumn("role", role), ["finding"])


_DETECT = dict(
    w=CALM_W,
    seeds=f"SELECT rec_id, s, e FROM w WHERE whisper >= 0.12 AND whisper >= voiced * 0.8 AND expressive < 0.3 AND {WHISPER.format(context='FALSE')}",
    g=sql_merge("seeds"),
    want="SELECT rec_id, g.s AS l, g.e AS r, g.s + i AS s, g.s + i + 3 AS e FROM (SELECT *, unnest(generate_series(0, CAST(ceil(e - 3 + 0.000001 - s) AS BIGINT) - 1)) AS i FROM g) g",
    held="SELECT want.rec_id, want.s, want.e, want.l, want.r, w.* EXCLUDE (rec_id, s, e) FROM want LEFT JOIN w ON w.rec_id = want.rec_id AND w.s = want.s - (want.s % 2)",
    runs=sql_runs("held", WHISPER.format(context="TRUE"), "s > ps + 1.01", "rec_id, l"),
)


@query(
    "evidence_detect_whispers",
    with_views(
        f'SELECT rec_id, {sql_us("s")} AS start, {sql_us("e")} AS "end", n AS windows FROM ('
        "SELECT rec_id, min(s) + CASE WHEN abs(min(s) - l) < 0.000001 THEN 0 ELSE 1 END AS s, "
        "max_by(e, s) - CASE WHEN abs(max_by(e, s) - r) < 0.000001 THEN 0 ELSE 1 END AS e, count(*) AS n FROM runs "
        "GROUP BY rec_id, l, r, run HAVING count(*) >= 2) WHERE e - s >= 1",
        "vectors",
        **_DETECT,
    ),
)
def evidence_detect_whispers(spark, sf):
    w = calm(spark, sf)
    # Fine scores: each vector scores the two 3 s windows that start inside its own two seconds.
    shift = F.explode(F.array(F.lit(0.0), F.lit(1.0)))
    fine = w.withColumn("_x", shift).withColumn("start", F.col("start") + F.col("_x")).withColumn("end", F.col("start") + 3.0).drop("_x")
    return micros(ev.detect_whispers(w, fine, chunk=C), "windows")
