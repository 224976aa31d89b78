"""Transcript filtering and reconciliation.

A segment has ``start, end, text, words`` and the optional quality columns
``avg_logprob, no_speech_prob, compression_ratio, backend,
alignment_total_words``.  Words are small arrays inside their segment, so word
rules are higher-order functions and need no exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Scores, laugh_kind
from ..functions.text import announces_drink, is_generic_outro, is_nonlexical, is_written_laugh, normalize_text
from ..functions.vocabulary import ALIGNED_BACKEND, LANGUAGE_CODES
from . import intervals as iv
from .scan import CHUNK

BY = ("rec_id",)


class Segment:
    """Columns of a segment row with the defaults for missing values."""

    def __init__(self, df: DataFrame, outro: str | None = None, syllables: str | None = None):
        self.names = set(df.columns)
        self.text = F.trim(F.coalesce(F.col("text"), F.lit("")))
        self.clean = normalize_text(self.text)
        self.generic = is_generic_outro(self.text) if outro is None else is_generic_outro(self.text, outro)
        self.nonlexical = is_nonlexical(self.clean) if syllables is None else is_nonlexical(self.clean, syllables)
        self.logprob = self._value("avg_logprob", -9.0)
        self.compression = self._value("compression_ratio", 0.0)
        self.no_speech = self._value("no_speech_prob", 0.0)
        self.aligned = F.coalesce(F.col("backend") == ALIGNED_BACKEND, F.lit(False)) if "backend" in self.names else F.lit(False)
        self.words = F.coalesce(F.col("words"), F.array().cast(df.schema["words"].dataType))
        total = F.aggregate(
            self.words, F.lit(0.0), lambda acc, w: acc + F.coalesce(w["probability"].cast("double"), F.lit(0.0))
        )
        self.probability = total / F.greatest(F.size(self.words), F.lit(1))
        self.solid = F.col("end") > F.col("start")

    def _value(self, name: str, default: float) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in self.names else F.lit(default)

    @property
    def lexical(self) -> Column:
        return (F.length(self.clean) > 0) & ~self.nonlexical & ~self.generic

    @property
    def alignment_issue(self) -> Column:
        """NULL when the forced alignment is usable, else why it is not."""
        finite = lambda c: ~(F.isnan(c) | (F.abs(c) == float("inf")))
        ok = lambda w: finite(w["start"]) & finite(w["end"]) & (w["end"] > w["start"])
        valid = F.filter(self.words, ok)
        total = F.size(self.words)
        if "alignment_total_words" in self.names:
            total = F.coalesce(F.col("alignment_total_words"), total)
        stretched = F.exists(
            valid,
            lambda w: w["end"] - w["start"] > F.greatest(F.lit(6.0), F.length(normalize_text(w["word"])) * 1.5),
        )
        times = F.array_sort(F.transform(valid, lambda w: F.struct(w["start"].cast("double").alias("a"), w["end"].cast("double").alias("b"))))
        cover = F.aggregate(
            times,
            F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("reach")),
            lambda acc, w: F.struct(
                (acc["sum"] + F.greatest(F.lit(0.0), w["b"] - F.greatest(w["a"], acc["reach"]))).alias("sum"),
                F.greatest(acc["reach"], w["b"]).alias("reach"),
            ),
            lambda acc: acc["sum"],
        )
        span = F.col("end") - F.col("start")
        bad_span = (F.size(self.words) == 0) | ~finite(F.col("start")) | ~finite(F.col("end")) | (span <= 0)
        dense = (span < 0.18) | (F.length(self.clean) / F.greatest(cover, F.lit(1e-6)) > 30)
        return (
            F.when(bad_span, "invalid span")
            .when(F.size(valid) < total * 0.6, "few valid words")
            .when(stretched, "stretched word")
            .when(dense, "text does not fit span")
        )

    @property
    def aligned_speech(self) -> Column:
        return self.lexical & self.alignment_issue.isNull()


def plausible(s: Segment, overlap: Column, continuous: Column) -> Column:
    """Accept a segment given its voice-activity overlap and the pass it comes from."""
    first = F.get(s.words, F.lit(0))["probability"]
    weak_generic = s.generic & ((overlap < 0.5) | (F.size(s.words) == 0) | (F.coalesce(first, F.lit(0.0)) < 0.4))
    empty = (F.length(s.clean) == 0) | s.nonlexical | ~s.solid | (s.compression > 2.5)
    lp, wp = s.logprob, s.probability
    over_all = (
        ((lp > -1.2) & (wp > 0.35) & (F.length(s.clean) >= 4))
        | ((lp > -0.8) & (wp > 0.5))
        | ((overlap > 0.5) & (lp > -1.65) & (wp > 0.25))
    )
    over_voice = ((lp > -1.65) & (wp > 0.18)) | ((wp > 0.35) & (lp > -1.85))
    heard = ~empty & ~weak_generic & F.when(continuous, over_all).otherwise(over_voice)
    return F.when(s.aligned, s.aligned_speech).otherwise(heard)


def is_review_speech(s: Segment) -> Column:
    """Stricter acceptance for speech found in an edited output."""
    heard = (
        (F.length(s.clean) > 0)
        & ~s.nonlexical
        & (s.compression <= 2.5)
        & ~(s.generic & (s.probability < 0.75))
        & s.solid
        & (s.no_speech < 0.85)
        & (s.logprob > -1.4)
        & (s.probability >= 0.30)
    )
    return F.when(s.aligned, s.aligned_speech).otherwise(heard)


def is_supported_utterance(s: Segment, window: Scores) -> Column:
    """Recover an uncertain segment when the sound of its window supports speech."""
    laugh = laugh_kind(window).isNotNull() & is_written_laugh(s.clean)
    return (
        ~s.generic
        & (s.compression <= 2.5)
        & ~laugh
        & s.solid
        & (s.logprob > -1.85)
        & (s.probability >= 0.25)
        & ((window.v("speech") >= 0.24) | (window.v("expressive") >= 0.20))
    )


def utterance_windows(uncertain: DataFrame, duration: Column) -> DataFrame:
    """The window in which an uncertain segment is checked."""
    start = F.greatest(F.lit(0.0), F.col("start") - 0.4)
    end = F.least(duration, F.greatest(F.col("end"), F.col("start") + 1.0) + 0.4)
    return uncertain.withColumn("window_start", start).withColumn("window_end", end)


def classify_segments(
    segments: DataFrame, vad: DataFrame, key: Sequence[str], by: Sequence[str] = BY, chunk=CHUNK,
    outro: str | None = None, syllables: str | None = None,
) -> DataFrame:
    """Add ``outcome`` (accepted, uncertain, rejected), ``review_only`` and ``reason``.

    ``pass`` tells the voice-activity pass (``vad``) from the full pass
    (``continuous``).
    """
    times = segments.select(*by, *[k for k in key if k not in by], "start", "end")
    overlap = iv.overlap_length(times, vad, key, by, chunk).drop("start", "end")
    rows = segments.join(overlap, [*by, *[k for k in key if k not in by]])
    # The patterns run once per row; the rules below read their results many times.
    text = Segment(rows, outro, syllables)
    rows = rows.withColumn("_clean", text.clean).withColumn("_generic", text.generic)
    rows = rows.withColumn("_nonlexical", is_nonlexical(F.col("_clean")) if syllables is None else is_nonlexical(F.col("_clean"), syllables))
    s = Segment(rows, outro, syllables)
    s.clean, s.generic, s.nonlexical = F.col("_clean"), F.col("_generic"), F.col("_nonlexical")
    accepted = plausible(s, F.col("overlap"), F.col("pass") == "continuous")
    review = s.aligned & s.lexical
    uncertain = s.solid & (s.logprob > -1.85) & ~s.generic
    outcome = F.when(accepted, "accepted").when(review | uncertain, "uncertain").otherwise("rejected")
    rows = rows.withColumn("outcome", outcome)
    only = (F.col("outcome") == "uncertain") & review
    return rows.withColumn("review_only", only).withColumn("reason", F.when(only, s.alignment_issue)).drop("overlap", "_clean", "_generic", "_nonlexical")


def word_groups(segments: DataFrame, gap: float = 0.9) -> Column:
    """Spoken spans of one segment: words at most ``gap`` apart, else the segment."""
    words = F.filter(F.coalesce(F.col("words"), F.array().cast(segments.schema["words"].dataType)), lambda w: w["end"] > w["start"])
    pairs = F.transform(words, lambda w: F.struct(w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end")))
    empty = F.array().cast("array<struct<start:double,end:double>>")

    def add(acc, w):
        last = F.try_element_at(acc, F.lit(-1))
        linked = F.struct(last["start"].alias("start"), F.greatest(last["end"], w["end"]).alias("end"))
        near = (F.size(acc) > 0) & (w["start"] - last["end"] <= gap)
        return F.when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(linked))).otherwise(F.concat(acc, F.array(w)))

    groups = F.aggregate(pairs, empty, add)
    whole = F.array(F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")))
    return F.when(F.size(groups) > 0, groups).otherwise(whole)


def word_intervals(segments: DataFrame, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """Spoken time of accepted segments."""
    spans = segments.select(*by, F.explode(word_groups(segments)).alias("_g")).select(*by, "_g.start", "_g.end")
    return iv.merge(spans, 0.65, by, chunk)


def dedupe_last(rows: DataFrame, keys: Sequence, order: str) -> DataFrame:
    """Of rows with equal keys keep the one that came last (map-side combined)."""
    named = [(k if isinstance(k, Column) else F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    kept = rows.groupBy(*named).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    return kept.select("_row.*")


def announced_intent(segments: DataFrame, by: Sequence[str] = BY, pattern: str | None = None) -> DataFrame:
    """End times of segments that announce a drink."""
    said = announces_drink(F.col("text")) if pattern is None else announces_drink(F.col("text"), pattern)
    return segments.where(said).select(*by, F.col("end").alias("said"))


def shift_clock(segments: DataFrame, offset: Column) -> DataFrame:
    """Move segment and word times from chunk time to recording time."""
    words = F.transform("words", lambda w: w.withField("start", w["start"] + offset).withField("end", w["end"] + offset))
    return (
        segments.withColumn("words", words)
        .withColumn("start", F.col("start") + offset)
        .withColumn("end", F.col("end") + offset)
    )


def pick_language(rows: DataFrame, order: str, by: Sequence[str] = BY) -> DataFrame:
    """Language code of the first row with text and a language, else ``auto``."""
    usable = (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) & (F.length(F.coalesce("language", F.lit(""))) > 0)
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    first = F.min_by(F.when(usable, F.col("language")), F.when(usable, F.col(order)))
    return rows.groupBy(*by).agg(first.alias("_l")).select(
        *by, F.coalesce(F.element_at(names, F.col("_l")), F.lit("auto")).alias("language")
    )
