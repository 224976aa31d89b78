"""Score predicates as boolean Columns (no UDF, part of whole-stage code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocabulary import KEEP_DEFAULTS, SCORE_COLUMNS, SEMANTIC_PROMPTS

TARGETS = ("mouth", "surface", "tapping", "heartbeat")
ACTIONS = ("speech", "other", "handling", "water")


class Scores:
    """Reads scores of a row; a missing column, key or value counts as zero (false)."""

    def __init__(self, columns, base: Column | None = None):
        self.columns = set(columns)
        self.base = base

    @classmethod
    def of(cls, df: DataFrame) -> "Scores":
        return cls(df.columns)

    def raw(self, name: str) -> Column:
        return F.col(name) if self.base is None else self.base[name]

    def v(self, name: str) -> Column:
        if name not in self.columns:
            return F.lit(0.0)
        return F.coalesce(self.raw(name).cast("double"), F.lit(0.0))

    def flag(self, name: str, default: bool = False) -> Column:
        if name not in self.columns:
            return F.lit(default)
        return F.coalesce(self.raw(name), F.lit(default))

    def top(self, *names: str) -> Column:
        values = [self.v(n) for n in names]
        return values[0] if len(values) == 1 else F.greatest(*values)

    def s(self, label: str) -> Column:
        if "semantic" not in self.columns:
            return F.lit(0.0)
        return F.coalesce(F.element_at(self.raw("semantic"), F.lit(label)), F.lit(0.0))

    def stop(self, *labels: str) -> Column:
        values = [self.s(n) for n in labels]
        return values[0] if len(values) == 1 else F.greatest(*values)

    @property
    def quiet(self) -> Column:
        return self.flag("quiet")


def summarize(scores: Column) -> list[Column]:
    """The 24 named score columns; a label that is absent counts as zero."""
    out = []
    for name, labels in SCORE_COLUMNS.items():
        values = [F.coalesce(F.element_at(scores, F.lit(label)), F.lit(0.0)) for label in labels]
        out.append((values[0] if len(values) == 1 else F.greatest(*values)).alias(name))
    return out


def group_max(values: Column, groups=SEMANTIC_PROMPTS, background: bool = True) -> Column:
    """Ordered prompt similarities to a map group -> largest similarity."""
    entries, at = [], 1
    for name, count in groups:
        entries += [F.lit(name), F.array_max(F.slice(values, at, count))]
        if background and name == "other":
            entries += [F.lit("background"), F.array_max(F.slice(values, at + 2, count - 2))]
        at += count
    return F.create_map(*entries)


def bad_vector(values: Column, groups) -> Column:
    """True for a similarity vector of wrong length or with a value that is not finite."""
    wanted = sum(count for _, count in groups)
    broken = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(values) != wanted) | broken, F.lit(True))


def laugh_kind(r: Scores) -> Column:
    soft = (r.v("soft_laugh") >= 0.22) & (r.v("soft_laugh") > r.v("loud_laugh") * 1.5)
    loud = (r.v("loud_laugh") >= 0.30) | (r.v("laughter") >= 0.50)
    return F.when(soft, "soft_laugh").when(loud, "loud_laugh")


def is_strong_voice(r: Scores) -> Column:
    permitted = r.flag("retained_whisper") & (r.v("voiced") < 0.35) & (r.v("expressive") < 0.25)
    voice = (
        (r.v("lexical") >= 0.62)
        | (r.v("expressive") >= 0.42)
        | ((r.v("speech") >= 0.62) & laugh_kind(r).isNull())
    )
    return ~permitted & voice


def is_texture_positive(r: Scores) -> Column:
    conflict = r.top(
        "speech", "expressive", "music", "airflow", "impact", "liquid", "container", "gargle", "loud_laugh"
    )
    texture = r.v("texture")
    return (
        ~r.quiet
        & (r.raw("end") - r.raw("start") >= 2)
        & (texture >= 0.25)
        & ((r.v("mouth") >= 0.18) | (texture >= 0.45))
        & (conflict < 0.22)
        & (texture > F.greatest(conflict, r.v("breath")) * 2)
    )


def is_semantic_positive(r: Scores, seed: bool = False, policy: Scores | None = None) -> Column:
    """Positive evidence; the sets of targets and rivals follow the retention flags."""
    keep = lambda name: policy.flag(name, KEEP_DEFAULTS[name]) if policy else F.lit(KEEP_DEFAULTS[name])
    missing = F.lit(None).cast("double")
    target = F.greatest(
        r.s("mouth"),
        r.s("surface"),
        F.when(keep("keep_heartbeat"), r.s("heartbeat")).otherwise(missing),
        F.when(keep("keep_tapping"), r.s("tapping")).otherwise(missing),
    )
    rival = F.greatest(
        r.s("speech"),
        r.s("break"),
        r.s("other"),
        F.when(~keep("keep_heartbeat"), r.s("heartbeat")).otherwise(missing),
        F.when(~keep("keep_tapping"), r.s("tapping")).otherwise(missing),
    )
    least, margin = (0.20, 0.025) if seed else (0.17, 0.005)
    ahead = target - rival
    evidence = (
        (target >= least)
        & (ahead >= margin)
        & ((r.v("texture") >= 0.035) | ((target >= 0.30) & (ahead >= 0.08)))
        & (r.top("expressive", "impact", "loud_laugh") < 0.30)
    )
    permitted = r.flag("retained_whisper") & keep("keep_whisper")
    return ~r.quiet & ~is_strong_voice(r) & (permitted | evidence)


def is_whisper_candidate(r: Scores) -> Column:
    return (
        ~r.quiet
        & (r.v("whisper") >= 0.12)
        & (r.v("whisper") >= r.v("voiced") * 0.8)
        & (r.v("expressive") < 0.3)
    )


WHISPER_RIVALS = ("normal_speech", "mouth", "surface", "tapping", "heartbeat", "break", "other")


def is_whisper_positive(r: Scores) -> Column:
    style = ((r.v("whisper") >= 0.25) & (r.v("whisper") >= r.v("voiced") * 1.2)) | (
        r.flag("whisper_context") & (r.v("voiced") < 0.35)
    )
    own = r.s("whisper_asmr")
    return (
        ~r.quiet
        & style
        & (r.top("expressive", "impact", "loud_laugh") < 0.25)
        & (own >= 0.23)
        & (own - r.stop(*WHISPER_RIVALS) >= 0.025)
    )


def is_drink(r: Scores, strong: bool = False) -> Column:
    drinking, swallow = r.s("drinking"), r.s("swallow")
    return (
        ~r.quiet
        & (drinking >= 0.30)
        & (drinking - r.stop(*TARGETS, *ACTIONS) >= (0.06 if strong else 0.015))
        & (swallow >= 0.28)
        & (swallow - r.stop(*TARGETS) >= (0.035 if strong else -0.015))
    )


def is_drink_candidate(r: Scores) -> Column:
    drinking, swallow = r.s("drinking"), r.s("swallow")
    return (
        ~r.quiet
        & (drinking >= 0.30)
        & (swallow >= 0.28)
        & (drinking >= r.stop(*TARGETS, *ACTIONS) - 0.08)
        & (swallow >= r.stop(*TARGETS) - 0.12)
    )


def is_cap(r: Scores, attached: bool = False) -> Column:
    cap = r.s("bottle_cap")
    if attached:
        fits = (
            (cap >= 0.32)
            & (cap >= r.stop("handling", "water") + 0.025)
            & (cap >= r.stop(*TARGETS, "speech") - 0.12)
        )
    else:
        fits = (cap >= 0.28) & (cap - r.stop(*TARGETS, *ACTIONS) >= 0.025)
    return ~r.quiet & fits


def is_sound_return(r: Scores) -> Column:
    target = r.stop(*TARGETS)
    return ~r.quiet & (target >= 0.28) & (target - r.stop("drinking", "bottle_cap", "swallow") >= 0.06)


def is_residue(r: Scores) -> Column:
    target = r.stop("mouth", "surface", "heartbeat", "tapping")
    background = r.s("background")
    return (
        (background >= 0.23)
        & (background >= r.s("other") - 1e-6)
        & (background - F.greatest(target, r.s("speech"), r.s("break")) >= 0.055)
        & (target < 0.23)
        & (r.top("texture", "mouth", "heartbeat", "tapping", "soft_laugh") < 0.12)
    )


def is_whisper_context(r: Scores) -> Column:
    own, normal = r.s("whisper_asmr"), r.s("normal_speech")
    style = ((r.v("whisper") >= 0.12) & (r.v("whisper") >= r.v("voiced") * 1.2)) | (
        (r.v("voiced") < 0.15) & (own >= 0.45) & (own - normal >= 0.15)
    )
    return (
        ~r.quiet
        & style
        & (r.top("voiced", "expressive", "loud_laugh", "impact") < 0.35)
        & (own >= 0.3)
        & (own - normal >= 0.04)
    )


def is_whispered(r: Scores) -> Column:
    return (r.s("whisper_asmr") >= 0.3) & (r.s("whisper_asmr") - r.stop(*WHISPER_RIVALS) >= 0.025)


def is_sound_evidence(r: Scores) -> Column:
    target = r.stop(*TARGETS)
    return (target >= 0.35) & (target - r.stop("speech", "normal_speech", "break", "other") >= 0.06)


def is_music(r: Scores) -> Column:
    return (r.v("music") > 0.55) & (r.v("texture") < 0.12)
