"""Label aggregation and window predicates over scored windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions.vocabulary import MENU_PROMPTS, MIXABLE, SCORE_COLUMNS
from ..operators import labels
from .fixtures import described, scored, scored_view, similar, sql_us, us, vectors, with_views
from .registry import query

MILLI = 1000


def _int(name: str):
    return F.round(F.col(name) * 1000000).cast("long").alias(name)


_SUM = ", ".join(f"{sql_us(n)} AS {n}" for n in SCORE_COLUMNS)


@query("label_summarize", with_views(f"SELECT vec_id, {_SUM} FROM w", "vectors", w=scored_view()))
def label_summarize(spark, sf):
    return labels.promote(scored(spark, sf)).select("vec_id", *[_int(n) for n in SCORE_COLUMNS])


_GROUPS = [
    "mouth", "surface", "tapping", "heartbeat", "speech", "whisper_asmr", "normal_speech", "break", "other", "background",
    "bottle_cap", "drinking", "swallow", "handling", "water",
]
_SEM = ", ".join(f"{sql_us('m_' + n)} AS {n}" for n in _GROUPS)


@query("label_group_max", with_views(f"SELECT vec_id, {_SEM} FROM w", "vectors", w=scored_view()))
def label_group_max(spark, sf):
    rows = labels.semantic(similar(spark, sf))
    return rows.select("vec_id", *[F.round(F.col("semantic")[n] * 1000000).cast("long").alias(n) for n in _GROUPS])


def broken_vectors(spark, sf):
    """Menu vectors of 26 values; every 7th is short and every 11th holds a NaN."""
    n = sum(c for _, c in MENU_PROMPTS)
    v = vectors(spark, sf)
    cut = F.when(F.pmod("vec_id", F.lit(7)) == 0, n - 1).otherwise(n)
    nan = F.transform(F.slice("embedding", 1, cut), lambda x, i: F.when((F.pmod("vec_id", F.lit(11)) == 0) & (i == 3), F.lit(float("nan"))).otherwise(x))
    return v.select("rec_id", "vec_id", nan.alias("values"))


@query(
    "label_vector_violations",
    "SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0",
)
def label_vector_violations(spark, sf):
    return labels.vector_violations(broken_vectors(spark, sf)).select("vec_id")


# The predicates below share one described table; the scale lets each one fire.
SCALES = dict(scale=1.6, lift=1.9)
W = scored_view(1.6, 1.9)
KIND = (
    "CASE WHEN soft_laugh >= 0.22 AND soft_laugh > loud_laugh * 1.5 THEN 'soft_laugh' "
    "WHEN loud_laugh >= 0.30 OR laughter >= 0.50 THEN 'loud_laugh' END"
)
STRONG = f"(lexical >= 0.62 OR expressive >= 0.42 OR (speech >= 0.62 AND ({KIND}) IS NULL))"


def windows(spark, sf):
    return described(spark, sf, 1.6, lift=1.9)


def _flag(name, sql, build, source=W, table=windows):
    """Register one predicate: the ids of all windows with its value."""

    @query(name, with_views(f"SELECT vec_id, ({sql}) AS hit FROM w", "vectors", w=source))
    def run(spark, sf):
        df = table(spark, sf)
        return df.select("vec_id", build(p.Scores.of(df)).alias("hit"))

    return run


@query("label_laugh_kind", with_views(f"SELECT vec_id, coalesce({KIND}, 'none') AS kind FROM w", "vectors", w=W))
def label_laugh_kind(spark, sf):
    df = windows(spark, sf)
    return df.select("vec_id", F.coalesce(p.laugh_kind(p.Scores.of(df)), F.lit("none")).alias("kind"))


def _permitted(spark, sf):
    return windows(spark, sf).withColumn("retained_whisper", F.pmod("vec_id", F.lit(2)) == 0)


_flag(
    "label_strong_voice",
    f"NOT (vec_id % 2 = 0 AND voiced < 0.35 AND expressive < 0.25) AND {STRONG}",
    p.is_strong_voice,
    table=_permitted,
)

# Texture is rare in these vectors: conflicting scores are scaled down.
_QUIETER = {
    n: 0.3
    for n in ("speech", "expressive", "music", "airflow", "impact", "liquid", "container", "gargle", "loud_laugh", "breath")
}


def _textured(spark, sf):
    return described(spark, sf, 2.0, _QUIETER)


CONFLICT = "greatest(speech, expressive, music, airflow, impact, liquid, container, gargle, loud_laugh)"
TEXTURE = (
    f"NOT quiet AND e - s >= 2 AND texture >= 0.25 AND (mouth >= 0.18 OR texture >= 0.45) AND {CONFLICT} < 0.22 "
    f"AND texture > greatest({CONFLICT}, breath) * 2"
)
_flag("label_texture_positive", TEXTURE, p.is_texture_positive, scored_view(2.0, 2.0, _QUIETER), _textured)


def semantic_positive_sql(least, margin, heart="TRUE", tap="TRUE"):
    target = f"greatest(m_mouth, m_surface, CASE WHEN {heart} THEN m_heartbeat END, CASE WHEN {tap} THEN m_tapping END)"
    rival = f"greatest(m_speech, m_break, m_other, CASE WHEN NOT {heart} THEN m_heartbeat END, CASE WHEN NOT {tap} THEN m_tapping END)"
    ahead = f"({target} - {rival})"
    return (
        f"NOT quiet AND NOT {STRONG} AND {target} >= {least} AND {ahead} >= {margin} AND "
        f"(texture >= 0.035 OR ({target} >= 0.30 AND {ahead} >= 0.08)) AND greatest(expressive, impact, loud_laugh) < 0.30"
    )


_CALM = {"expressive": 0.5, "impact": 0.5, "lexical": 0.7, "loud_laugh": 0.5, "voiced": 0.5}
CALM_W = scored_view(1.6, 1.9, _CALM)


def calm(spark, sf):
    return described(spark, sf, 1.6, _CALM, 1.9)


def _policy(spark, sf):
    df = calm(spark, sf)
    return df.withColumn("keep_heartbeat", F.pmod("vec_id", F.lit(3)) != 0).withColumn("keep_tapping", F.pmod("vec_id", F.lit(2)) != 0)


_flag("label_semantic_positive", semantic_positive_sql(0.17, 0.005, "vec_id % 3 != 0", "vec_id % 2 != 0"),
      lambda r: p.is_semantic_positive(r, False, r), CALM_W, _policy)
_flag("label_semantic_seed", semantic_positive_sql(0.20, 0.025), lambda r: p.is_semantic_positive(r, True), CALM_W, calm)

RIVALS = "greatest(m_normal_speech, m_mouth, m_surface, m_tapping, m_heartbeat, m_break, m_other)"
_flag(
    "label_whisper_candidate",
    "NOT quiet AND whisper >= 0.12 AND whisper >= voiced * 0.8 AND expressive < 0.3",
    p.is_whisper_candidate,
    CALM_W,
    calm,
)
WHISPER = (
    "NOT quiet AND ((whisper >= 0.25 AND whisper >= voiced * 1.2) OR ({context} AND voiced < 0.35)) AND "
    f"greatest(expressive, impact, loud_laugh) < 0.25 AND m_whisper_asmr >= 0.23 AND m_whisper_asmr - {RIVALS} >= 0.025"
)
_flag(
    "label_whisper_positive",
    WHISPER.format(context="vec_id % 2 = 0"),
    p.is_whisper_positive,
    CALM_W,
    lambda spark, sf: calm(spark, sf).withColumn("whisper_context", F.pmod("vec_id", F.lit(2)) == 0),
)

TARGETS = "m_mouth, m_surface, m_tapping, m_heartbeat"
ALL = f"greatest({TARGETS}, m_speech, m_other, m_handling, m_water)"


def drink_sql(strong):
    a, b = ("0.06", "0.035") if strong else ("0.015", "-0.015")
    return (
        f"NOT quiet AND m_drinking >= 0.30 AND m_drinking - {ALL} >= {a} AND m_swallow >= 0.28 "
        f"AND m_swallow - greatest({TARGETS}) >= {b}"
    )


CAP = f"NOT quiet AND m_bottle_cap >= 0.28 AND m_bottle_cap - {ALL} >= 0.025"
CAP_ATTACHED = (
    f"NOT quiet AND m_bottle_cap >= 0.32 AND m_bottle_cap >= greatest(m_handling, m_water) + 0.025 "
    f"AND m_bottle_cap >= greatest({TARGETS}, m_speech) - 0.12"
)
RETURN = f"NOT quiet AND greatest({TARGETS}) >= 0.28 AND greatest({TARGETS}) - greatest(m_drinking, m_bottle_cap, m_swallow) >= 0.06"


@query(
    "label_drink_predicates",
    with_views(
        f"SELECT vec_id, ({drink_sql(True)}) AS strong, ({drink_sql(False)}) AS weak, (NOT quiet AND m_drinking >= 0.30 AND m_swallow >= 0.28 "
        f"AND m_drinking >= {ALL} - 0.08 AND m_swallow >= greatest({TARGETS}) - 0.12) AS candidate, ({CAP}) AS cap, "
        f"({CAP_ATTACHED}) AS cap_attached, ({RETURN}) AS sound_return FROM w",
        "vectors",
        w=scored_view(2.0, 2.6),
    ),
)
def label_drink_predicates(spark, sf):
    df = described(spark, sf, 2.0, lift=2.6)
    r = p.Scores.of(df)
    return df.select(
        "vec_id",
        p.is_drink(r, True).alias("strong"),
        p.is_drink(r).alias("weak"),
        p.is_drink_candidate(r).alias("candidate"),
        p.is_cap(r).alias("cap"),
        p.is_cap(r, True).alias("cap_attached"),
        p.is_sound_return(r).alias("sound_return"),
    )


_DULL = {n: 0.2 for n in ("texture", "mouth", "heartbeat", "tapping", "soft_laugh")}
RESIDUE = (
    "m_background >= 0.23 AND m_background >= m_other - 0.000001 AND m_background - greatest(m_mouth, m_surface, m_heartbeat, m_tapping, "
    "m_speech, m_break) >= 0.055 AND greatest(m_mouth, m_surface, m_heartbeat, m_tapping) < 0.23 AND greatest(texture, mouth, heartbeat, tapping, soft_laugh) < 0.12"
)


def dull(spark, sf):
    return described(spark, sf, 1.6, _DULL, 1.9)


_flag("label_residue", RESIDUE, p.is_residue, scored_view(1.6, 1.9, _DULL), dull)
CONTEXT = (
    "NOT quiet AND ((whisper >= 0.12 AND whisper >= voiced * 1.2) OR (voiced < 0.15 AND m_whisper_asmr >= 0.45 AND m_whisper_asmr - m_normal_speech >= 0.15)) "
    "AND greatest(voiced, expressive, loud_laugh, impact) < 0.35 AND m_whisper_asmr >= 0.3 AND m_whisper_asmr - m_normal_speech >= 0.04"
)
_flag("label_whisper_context", CONTEXT, p.is_whisper_context, CALM_W, calm)
WHISPERED = f"m_whisper_asmr >= 0.3 AND m_whisper_asmr - {RIVALS} >= 0.025"
_flag("label_whispered", WHISPERED, p.is_whispered)
SOUND = f"greatest({TARGETS}) >= 0.35 AND greatest({TARGETS}) - greatest(m_speech, m_normal_speech, m_break, m_other) >= 0.06"
_flag("label_sound_evidence", SOUND, p.is_sound_evidence)

_MENU = [n for n, _ in MENU_PROMPTS]


def menu_scores(spark, sf, lift=1.8):
    n = sum(c for _, c in MENU_PROMPTS)
    v = vectors(spark, sf).select("rec_id", "vec_id", "start", "end", F.transform(F.slice("embedding", 1, n), lambda x: x * lift).alias("values"))
    return labels.semantic(v, "values", MENU_PROMPTS, background=False)


def _menu_sql(lift=1.8):
    out, at = [], 1
    for i, (name, count) in enumerate(MENU_PROMPTS):
        best = f"greatest({', '.join(f'em[{k}] * {lift}' for k in range(at, at + count))})" if count > 1 else f"em[{at}] * {lift}"
        out.append(f"{{'i': {i}, 'name': '{name}', 'v': {best}}}")
        at += count
    return f"SELECT rec_id, vec_id, s, e, unnest([{', '.join(out)}]) AS x FROM vectors"


_SET = ", ".join(f"'{m}'" for m in MIXABLE)
IDENTIFY = (
    "SELECT rec_id, vec_id, s, e, CASE WHEN best < 0.20 THEN 'unknown' WHEN len(close) = 1 THEN close[1] "
    f"WHEN len(list_filter(close, lambda c: NOT list_contains([{_SET}], c))) = 0 THEN 'mixed' ELSE 'unknown' END AS category, close FROM ("
    "SELECT rec_id, vec_id, s, e, max(best) AS best, list(x.name ORDER BY x.v DESC, x.i) FILTER (best - x.v < 0.025) AS close FROM ("
    "SELECT *, max(x.v) OVER (PARTITION BY vec_id) AS best FROM menu) GROUP BY ALL)"
)


@query(
    "label_identify",
    with_views(
        "SELECT vec_id, category, CASE WHEN category = 'mixed' THEN array_to_string(close[1:3], '|') ELSE '' END AS alternatives FROM ranked",
        "vectors",
        menu=_menu_sql(),
        ranked=IDENTIFY,
    ),
)
def label_identify(spark, sf):
    rows = menu_scores(spark, sf).withColumn("_a", labels.identify(F.col("semantic"), _MENU))
    return rows.select("vec_id", F.col("_a.category").alias("category"), F.array_join("_a.alternatives", "|").alias("alternatives"))


_LOUD_MUSIC = {"music": 2.5, "texture": 0.25}


@query(
    "label_music_intervals",
    with_views(
        f'SELECT rec_id, {sql_us("s")} AS start, {sql_us("e")} AS "end" FROM w WHERE music > 0.55 AND texture < 0.12',
        "vectors",
        w=scored_view(2.0, 2.0, _LOUD_MUSIC),
    ),
)
def label_music_intervals(spark, sf):
    df = labels.music_intervals(described(spark, sf, 2.0, _LOUD_MUSIC))
    return df.select("rec_id", us(F.col("start")).alias("start"), us(F.col("end")).alias("end"))


@query(
    "label_coarse_to_fine",
    with_views(
        f'SELECT f.rec_id, {sql_us("f.a")} AS start, {sql_us("f.b")} AS "end", t.vec_id FROM ('
        "SELECT DISTINCT rec_id, s + i * 2.0::DOUBLE AS a, least(s + i * 2.0::DOUBLE + 6.0::DOUBLE, e + 0.0::DOUBLE) AS b FROM ("
        "SELECT *, unnest([0, 1, 2]) AS i FROM (SELECT rec_id, s, e FROM w WHERE expressive >= 0.42)) "
        "WHERE e - (s + i * 2.0::DOUBLE) >= 0.4) f LEFT JOIN w t ON t.rec_id = f.rec_id AND t.s = f.a AND t.e = f.b",
        "vectors",
        w=W,
    ),
)
def label_coarse_to_fine(spark, sf):
    df = windows(spark, sf)
    table = df.select("rec_id", "start", "end", "vec_id")
    fine = labels.coarse_to_fine(df, table, lambda r: r.v("expressive") >= 0.42, 6.0, 2.0, 0.4)
    return fine.select("rec_id", us(F.col("start")).alias("start"), us(F.col("end")).alias("end"), "vec_id")
