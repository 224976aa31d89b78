"""Evidence runs: scored windows in, labelled intervals out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions.predicates import Scores
from ..functions.text import announces_drink
from . import intervals as iv
from .joins import covering, stab
from .scan import CHUNK, islands, neighbours

BY = ("rec_id",)
SPAN = ("start", "end")


def _runs(windows: DataFrame, ok: Column, breaks: Callable, aggs: dict, by, chunk, uses=SPAN) -> DataFrame:
    """Runs of supported windows; an unsupported window always separates."""
    rows = windows.withColumn("_ok", ok)
    found = islands(
        rows,
        {**aggs, "_ok": ("first", F.col("_ok"))},
        lambda a, b: ~a["_ok"] | ~b["_ok"] | breaks(a, b),
        order=SPAN,
        uses=[*uses, "_ok"],
        by=by,
        chunk=chunk,
    )
    return found.where("_ok").drop("_ok")


def rhythmic_runs(windows: DataFrame, category: str, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """Repeated heartbeat or tapping evidence: at least two linked windows."""
    r = Scores.of(windows)
    level = r.v(category)
    ok = ~r.quiet & (level >= {"heartbeat": 0.20, "tapping": 0.25}[category])
    if category == "tapping":
        ok = ok & (r.v("impact") < 0.35) & (level >= r.v("mouth") * 0.8)
    aggs = {"start": ("first", F.col("start")), "end": ("last", F.col("end")), "windows": ("count", F.lit(1))}
    runs = _runs(windows, ok, lambda a, b: b["start"] > a["end"], aggs, by, chunk)
    return iv.merge(runs.where(F.col("windows") >= 2), 0, by, chunk)


def texture_regions(windows: DataFrame, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """Runs of texture windows without their ambiguous first and last window."""
    r = Scores.of(windows)
    rows = neighbours(
        windows.withColumn("_ok", p.is_texture_positive(r)), SPAN, before=1, after=1, fields=["start", "end"], by=by, chunk=chunk
    )
    aggs = {
        # The start of the second row and the end of the row before the last one.
        "start": ("first", F.get("next", F.lit(0))["start"]),
        "end": ("last", F.get("prev", F.lit(0))["end"]),
        "windows": ("count", F.lit(1)),
        "min_texture_score": ("min", F.col("texture")),
    }
    runs = _runs(rows, F.col("_ok"), lambda a, b: b["start"] - a["start"] > 2.1, aggs, by, chunk)
    return runs.where((F.col("windows") >= 2) & (F.col("end") - F.col("start") >= 3))


def semantic_regions(windows: DataFrame, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """Runs of semantic evidence with two or more strong windows, trimmed at both ends.

    Retention flags of the recording are read from columns of the windows.
    """
    r = Scores.of(windows)
    length = F.col("end") - F.col("start")
    trim = F.least(F.lit(2.5), length / 4)
    aggs = {
        "start": ("first", F.col("start") + trim),
        "end": ("last", F.col("end") - trim),
        "windows": ("count", F.lit(1)),
        "strong_windows": ("count", F.when(p.is_semantic_positive(r, True, r), 1)),
    }
    ok = p.is_semantic_positive(r, False, r)
    runs = _runs(windows, ok, lambda a, b: b["start"] > a["end"] + 1e-6, aggs, by, chunk)
    return runs.where((F.col("windows") >= 2) & (F.col("strong_windows") >= 2))


def confirmed_regions(windows: DataFrame, regions: DataFrame, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """Whisper runs inside each region; inner run edges shrink to window centres."""
    by = list(by)
    held = covering(windows, iv.merge(regions, 0, by, chunk), at="start", by=by, chunk=chunk)
    held = held.where((F.col("span.start") <= F.col("start")) & (F.col("span.end") >= F.col("end")))
    held = held.withColumn("_l", F.col("span.start")).withColumn("_r", F.col("span.end")).drop("span")
    aggs = {
        "start": ("first", F.col("start")),
        "end": ("last", F.col("end")),
        "windows": ("count", F.lit(1)),
        "_l": ("first", F.col("_l")),
        "_r": ("first", F.col("_r")),
    }
    apart = lambda a, b: (b["start"] > a["start"] + 1.01) | (a["_l"] != b["_l"])
    runs = _runs(held, p.is_whisper_positive(Scores.of(held)), apart, aggs, by, chunk, uses=("start", "end", "_l"))
    inner = lambda c, edge: F.when(F.abs(c - edge) < 1e-6, 0.0).otherwise(1.0)
    runs = runs.where(F.col("windows") >= 2).select(
        *by,
        (F.col("start") + inner(F.col("start"), F.col("_l"))).alias("start"),
        (F.col("end") - inner(F.col("end"), F.col("_r"))).alias("end"),
        "windows",
    )
    return runs.where(F.col("end") - F.col("start") >= 1)


def _context(windows: DataFrame, fields, by, chunk) -> DataFrame:
    """Six rows on either side, as ``prev`` and ``next``."""
    return neighbours(windows, SPAN, before=6, after=6, fields=fields, by=by, chunk=chunk)


def _near(rows: Column) -> Column:
    """Neighbours that lie within six seconds of the window."""
    return F.filter(rows, lambda x: (x["start"] <= F.col("end") + 6) & (x["end"] >= F.col("start") - 6))


def _zero(df: DataFrame, names: Sequence[str]) -> DataFrame:
    r = Scores.of(df)
    return df.select(*[c for c in df.columns if c not in names], *[r.v(n).alias(n) for n in names])


def airflow_events(windows: DataFrame, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """Repeated air release in a breathing context, followed outwards while breath dominates."""
    names = ["breath", "airflow", "texture", "mouth", "spray", "steam", "hiss", "sizzle"]
    rows = _zero(windows, names).select(*by, *SPAN, *names)
    rows = _context(rows, ["start", "end", "breath", "airflow", "texture"], by, chunk)
    near = F.concat(_near(F.col("prev")), _near(F.col("next")))
    breath = F.greatest(F.array_max(F.transform(near, lambda x: x["breath"])), F.col("breath"))
    repeats = F.size(F.filter(near, lambda x: x["airflow"] >= 0.10)) + F.when(F.col("airflow") >= 0.10, 1).otherwise(0)
    release = (F.col("spray") >= 0.12) | (F.col("steam") >= 0.10) | ((F.col("hiss") >= 0.18) & (F.col("sizzle") >= 0.035))
    seeds = rows.where(
        (F.col("airflow") >= 0.16)
        & (breath >= 0.09)
        & (F.col("airflow") >= F.col("mouth") * 1.7)
        & release
        & (repeats >= 2)
    )

    def grow(span: Column, ordered: Column) -> Column:
        def step(acc, x):
            apart = (x["start"] > acc["hi"] + 2) | (x["end"] < acc["lo"] - 2)
            surface = (x["texture"] >= 0.10) & (x["texture"] > F.greatest(x["breath"], x["airflow"]) * 1.5)
            weak = (x["breath"] < 0.055) | (x["breath"] < x["texture"] * 1.5)
            return _extend(acc, x, apart | surface | weak)

        return F.aggregate(ordered, span, step)

    first = grow(_span(F.col("start"), F.col("end")), F.reverse("prev"))
    seeds = seeds.withColumn("_s", first)
    second = grow(_span(F.col("_s.lo"), F.col("_s.hi")), F.col("next"))
    seeds = seeds.withColumn("_s", second).select(*by, F.col("_s.lo").alias("start"), F.col("_s.hi").alias("end"))
    return iv.merge(seeds, 2.0, by, chunk)


def _span(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), F.lit(False).alias("stopped"))


def _extend(acc: Column, x: Column, stop: Column) -> Column:
    """Fold step: once stopped, always stopped; otherwise the span takes in the row."""
    halted = acc["stopped"] | stop
    return F.struct(
        F.when(halted, acc["lo"]).otherwise(F.least(acc["lo"], x["start"].cast("double"))).alias("lo"),
        F.when(halted, acc["hi"]).otherwise(F.greatest(acc["hi"], x["end"].cast("double"))).alias("hi"),
        halted.alias("stopped"),
    )


def drinking_events(
    windows: DataFrame, segments: DataFrame, by: Sequence[str] = BY, chunk=CHUNK, pattern: str | None = None
) -> DataFrame:
    """Cup and ingestion sounds near each other, or liquid soon after an announcement."""
    by = list(by)
    names = ["container", "gargle", "mouth", "liquid"]
    rows = _zero(windows, names).select(*by, *SPAN, *names)
    rows = _context(rows, ["start", "end", "container", "gargle", "mouth"], by, chunk)
    near = F.concat(_near(F.col("prev")), _near(F.col("next")))
    container = F.greatest(F.array_max(F.transform(near, lambda x: x["container"])), F.col("container"))
    oral = F.greatest(
        F.array_max(F.transform(near, lambda x: F.greatest(x["gargle"], x["mouth"]))), F.col("gargle"), F.col("mouth")
    )
    rows = rows.select(*by, *SPAN, "liquid", "gargle", container.alias("_c"), oral.alias("_o"))
    text = announces_drink(F.col("text")) if pattern is None else announces_drink(F.col("text"), pattern)
    # An announcement at t supports windows that start in [t - 2, t + 25].
    said = segments.where(text).select(*by, (F.col("end") - 2).alias("start"), (F.col("end") + 25).alias("end"))
    rows = covering(rows, said.where(F.col("start").isNotNull()), at="start", by=by, chunk=chunk, reach=True)
    announced = F.coalesce(F.col("reach") >= F.col("start"), F.lit(False))
    confirmed = (F.col("_c") >= 0.13) & (
        ((F.col("liquid") >= 0.15) & (F.col("_o") >= 0.10)) | (F.col("gargle") >= 0.16)
    )
    hits = rows.where(confirmed | (announced & (F.greatest("liquid", "gargle") >= 0.075)))
    return iv.merge(hits.select(*by, *SPAN), 2.0, by, chunk)


def extend_breaks(
    events: DataFrame, windows: DataFrame, by: Sequence[str] = BY, chunk=CHUNK, tags: Sequence[str] = ()
) -> DataFrame:
    """Grow each event over the rest activity around it (at most 24 s each way).

    Events of several kinds grow in one pass when ``tags`` names their kind.
    """
    by, tags = list(by), list(tags)
    r = Scores.of(windows)
    competing = r.top("breath", "airflow", "liquid", "gargle", "expressive", "laughter", "soft_laugh", "loud_laugh")
    stop = ((r.v("texture") >= 0.12) & (r.v("texture") > competing * 1.5)) | (
        ~r.quiet & (competing < 0.055) & (r.v("container") < 0.10)
    )
    rows = windows.select(*by, *SPAN, stop.alias("stop"))
    event = [*by, *tags, *SPAN]
    spans = events.select(*event).distinct()
    probes = spans.select(
        "*",
        (F.col("start") - 24).alias("_l0"),
        (F.col("start") + 2).alias("_l1"),
        (F.col("end") - 2).alias("_r0"),
        (F.col("end") + 24).alias("_r1"),
    )

    def side(at: str, lo: str, hi: str, left: bool) -> DataFrame:
        near = stab(probes, rows, at, lo, hi, by, chunk)
        return near.select(
            *[F.col(f"range.{c}").alias(c) for c in event],
            F.lit(left).alias("left"),
            F.struct("point.start", "point.end", "point.stop").alias("row"),
        )

    near = side("end", "_l0", "_l1", True).unionByName(side("start", "_r0", "_r1", False))
    gather = lambda own: F.array_sort(F.collect_list(F.when(own, F.col("row"))))
    near = near.groupBy(*event).agg(gather(F.col("left")).alias("_left"), gather(~F.col("left")).alias("_right"))

    def grow(span: Column, ordered: Column) -> Column:
        return F.aggregate(
            ordered,
            span,
            lambda acc, x: _extend(acc, x, x["stop"] | (x["start"] > acc["hi"] + 2) | (x["end"] < acc["lo"] - 2)),
        )

    grown = near.withColumn("_s", grow(_span(F.col("start"), F.col("end")), F.reverse("_left")))
    grown = grown.withColumn("_s", grow(_span(F.col("_s.lo"), F.col("_s.hi")), F.col("_right")))
    grown = grown.select(*by, *tags, F.col("_s.lo").alias("start"), F.col("_s.hi").alias("end"))
    # An event without any window near it stays as it is.
    alone = spans.select(*by, *tags, *[F.col(c).cast("double").alias(c) for c in SPAN])
    return iv.merge(grown.unionByName(alone), 0, [*by, *tags], chunk)


def laughter_events(windows: DataFrame, kind: str, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """Soft or loud laughter, grown over the break around it."""
    hits = windows.where(p.laugh_kind(Scores.of(windows)) == kind).select(*by, *SPAN)
    return extend_breaks(iv.merge(hits, 0, by, chunk), windows, by, chunk)


def expressive_breaks(windows: DataFrame, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    hits = windows.where(Scores.of(windows).v("expressive") >= 0.42).select(*by, *SPAN)
    return extend_breaks(iv.merge(hits, 0, by, chunk), windows, by, chunk)


def voice_intervals(
    coarse: DataFrame, fine: DataFrame, uncertain: DataFrame, breaks: DataFrame, by: Sequence[str] = BY, chunk=CHUNK
) -> DataFrame:
    """Voice from refined windows, very strong contexts, supported utterances and breaks.

    ``fine`` are the scored 2 s / 1 s windows inside suspect coarse windows;
    ``uncertain`` are supported uncertain utterances (already filtered).
    """
    by = list(by)
    refined = iv.merge(fine.where(p.is_strong_voice(Scores.of(fine))).select(*by, *SPAN), 0.35, by, chunk)
    r = Scores.of(coarse)
    strong = coarse.where(p.is_strong_voice(r) & (r.top("speech", "expressive") >= 0.85)).select(*by, *SPAN).distinct()
    alone = iv.overlapping(strong, refined, [*by, *SPAN], negate=True, by=by, chunk=chunk)
    parts = [refined, alone, uncertain.select(*by, *SPAN), breaks.select(*by, *SPAN)]
    return iv.merge(reduce(DataFrame.unionByName, parts), 0.65, by, chunk)


def detect_whispers(contexts: DataFrame, fine: DataFrame, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """Whisper intervals: gated contexts become regions, fine windows decide inside them.

    ``contexts`` are scored 10 s / 5 s windows; ``fine`` is the table of scored
    3 s / 1 s windows, looked up only inside the regions.
    """
    from .grids import hop_windows
    from .labels import with_scores

    r = Scores.of(contexts)
    seeds = contexts.where(p.is_whisper_candidate(r) & p.is_whisper_positive(r)).select(*by, *SPAN)
    regions = iv.merge(seeds, 0, by, chunk)
    wanted = hop_windows(regions, 3.0, 1.0, full_only=True)
    rows = with_scores(wanted, fine, by).withColumn("whisper_context", F.lit(True))
    return confirmed_regions(rows, regions, by, chunk)


def category_report(
    windows: DataFrame, segments: DataFrame, impacts: DataFrame, by: Sequence[str] = BY, chunk=CHUNK,
    drink_pattern: str | None = None, voice: DataFrame | None = None,
) -> DataFrame:
    """Every category of one stored window table as rows ``(category, start, end)``.

    ``impacts`` come from :func:`tapeloom.operators.signal.impact_events`, which
    also needs the samples, and ``voice`` from :func:`voice_intervals`, which also
    needs fine scores and the supported utterances.  All break-like categories grow in one pass; policy
    is applied later.
    """
    by = list(by)
    r = Scores.of(windows)
    kinds = F.array_compact(
        F.array(p.laugh_kind(r), F.when(r.v("expressive") >= 0.42, F.lit("expressive_breaks")))
    )
    hits = windows.select(*by, *SPAN, F.explode(kinds).alias("category"))
    named = lambda df, name: df.select(
        *by, F.lit(name).alias("category"), *[F.col(c).cast("double").alias(c) for c in SPAN]
    )
    tagged = [*by, "category"]
    seeds = iv.merge(hits, 0, tagged, chunk).select(*tagged, *[F.col(c).cast("double").alias(c) for c in SPAN])
    seeds = seeds.unionByName(named(airflow_events(windows, by, chunk), "airflow")).unionByName(
        named(drinking_events(windows, segments, by, chunk, drink_pattern), "drinking")
    )
    runs = named(rhythmic_runs(windows, "heartbeat", by, chunk), "heartbeat").unionByName(
        named(rhythmic_runs(windows, "tapping", by, chunk), "tapping")
    )
    texture = iv.merge(texture_regions(windows, by, chunk), 0, by, chunk)
    parts = [
        extend_breaks(seeds, windows, by, chunk, ["category"]), runs, named(impacts, "impacts"), named(texture, "extraction"),
    ]
    if voice is not None:
        parts.append(named(voice, "voice"))
    return reduce(DataFrame.unionByName, [df.select(*tagged, *SPAN) for df in parts])


# Decisions over probes of one candidate.

_ACTIVE = ("mouth", "heartbeat", "tapping", "soft_laugh")


def phase_decision(probes: DataFrame, key: Sequence[str]) -> DataFrame:
    """keep_asmr / remove / uncertain from the probes before, after and inside a phase."""
    r = Scores.of(probes)
    body = F.col("role") == "body"
    edge = ~body
    positive = p.is_semantic_positive(r, False, r)
    active = positive | (r.top(*_ACTIVE) >= 0.2)
    rows = probes.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.bool_or(F.when(body, active)), F.lit(False)).alias("_active"),
        F.coalesce(F.bool_and(F.when(edge, positive)), F.lit(False)).alias("_stable"),
        F.coalesce(F.bool_and(F.when(body, p.is_residue(r))), F.lit(True)).alias("_residue"),
    )
    decision = (
        F.when(F.col("_n") < 3, "uncertain")
        .when(F.col("_active"), "keep_asmr")
        .when(~F.col("_stable"), "uncertain")
        .when(F.col("_residue"), "remove")
        .otherwise("uncertain")
    )
    reason = (
        F.when(F.col("_n") < 3, "context missing")
        .when(F.col("_active"), "action inside the phase")
        .when(~F.col("_stable"), "surroundings not stable")
        .when(F.col("_residue"), "residue between stable surroundings")
        .otherwise("mixed evidence")
    )
    return rows.select(*key, decision.alias("decision"), reason.alias("reason"))


def acoustic_veto(probes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cheap decision before semantic scoring; NULL when scoring is needed."""
    r = Scores.of(probes)
    body = F.col("role") == "body"
    unstable = r.quiet | p.is_strong_voice(r) | (r.v("texture") < 0.035) | (r.top("expressive", "impact", "loud_laugh") >= 0.3)
    rows = probes.groupBy(*key).agg(
        F.coalesce(F.bool_or(F.when(body, r.top(*_ACTIVE) >= 0.2)), F.lit(False)).alias("_active"),
        F.coalesce(F.bool_or(F.when(body, r.top("texture", *_ACTIVE) >= 0.12)), F.lit(False)).alias("_sound"),
        F.coalesce(F.bool_or(F.when(~body, unstable)), F.lit(False)).alias("_unstable"),
    )
    decision = F.when(F.col("_active"), "keep_asmr").when(F.col("_sound") | F.col("_unstable"), "uncertain")
    return rows.select(*key, decision.alias("decision"))


def arbitrate(probes: DataFrame, key: Sequence[str], keep_whisper: Column | bool = True) -> DataFrame:
    """whisper / conflict / speech per finding; all its probes must agree.

    Rows of role ``context`` describe the surroundings, the others the finding.
    """
    r = Scores.of(probes)
    context = F.col("role") == "context"
    keep = keep_whisper if isinstance(keep_whisper, Column) else F.lit(keep_whisper)
    calm = r.top("voiced", "expressive", "whisper") < 0.2
    no = lambda c: F.coalesce(c, F.lit(False))
    rows = probes.groupBy(*key).agg(
        no(F.bool_or(F.when(context, ~r.quiet))).alias("_heard"),
        no(F.bool_or(F.when(context, p.is_whisper_context(r) & keep))).alias("_whisper"),
        no(F.bool_or(F.when(context, calm & p.is_sound_evidence(r)))).alias("_sound"),
        no(F.bool_and(F.when(~context, p.is_whispered(r)))).alias("_all_whispered"),
        no(F.bool_and(F.when(~context, p.is_sound_evidence(r)))).alias("_all_sound"),
    )
    decision = (
        F.when(F.col("_heard") & F.col("_whisper") & F.col("_all_whispered"), "whisper")
        .when(F.col("_heard") & F.col("_sound") & F.col("_all_sound"), "conflict")
        .otherwise("speech")
    )
    return rows.select(*key, decision.alias("decision"))


def apply_arbitration(findings: DataFrame, decisions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add ``outcome``: whispers are allowed, conflicts are only reviewed, the rest remains."""
    rows = findings.join(decisions, list(key), "left").withColumn("decision", F.coalesce("decision", F.lit("speech")))
    review = F.coalesce(F.col("review_only"), F.lit(False)) | (F.col("decision") == "conflict")
    outcome = F.when(F.col("decision") == "whisper", "allowed").otherwise("remaining")
    return rows.withColumn("review_only", review).withColumn("outcome", outcome)
