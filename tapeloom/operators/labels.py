"""Label scores: promotion to columns, ranking, coarse-to-fine scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions.clock import span_key
from ..functions.vocabulary import MENU_PROMPTS, MIXABLE, SEMANTIC_PROMPTS

BY = ("rec_id",)


def promote(windows: DataFrame, scores: str = "scores") -> DataFrame:
    """Replace the open score map by the fixed score columns."""
    return windows.select(*[c for c in windows.columns if c != scores], *p.summarize(F.col(scores)))


def semantic(windows: DataFrame, values: str = "values", groups=SEMANTIC_PROMPTS, background: bool = True) -> DataFrame:
    """Replace an ordered similarity vector by the map of group maxima."""
    return windows.withColumn("semantic", p.group_max(F.col(values), groups, background)).drop(values)


def vector_violations(windows: DataFrame, values: str = "values", groups=MENU_PROMPTS) -> DataFrame:
    """Rows whose similarity vector has a wrong length or a value that is not finite."""
    return windows.where(p.bad_vector(F.col(values), groups))


def identify(scores: Column, labels: Sequence[str], mixable: Sequence[str] = MIXABLE) -> Column:
    """Struct ``(category, alternatives)`` of the best label with its close rivals.

    Labels are ranked by score, equal scores by their position in ``labels``.
    """
    ranks = F.array(*[F.struct((-F.element_at(scores, F.lit(n))).alias("neg"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(labels)])
    ranked = F.array_sort(F.filter(ranks, lambda x: x["neg"].isNotNull()))
    best = F.get(ranked, F.lit(0))
    close = F.transform(F.filter(ranked, lambda x: (x["neg"] - best["neg"]) < 0.025), lambda x: x["name"])
    none = F.array().cast("array<string>")
    allowed = F.array(*[F.lit(m) for m in mixable])
    answer = lambda category, others: F.struct(category.alias("category"), others.alias("alternatives"))
    unknown = answer(F.lit("unknown"), none)
    return (
        F.when(best.isNull() | (-best["neg"] < 0.20), unknown)
        .when(
            F.size(close) > 1,
            F.when(F.size(F.array_except(close, allowed)) == 0, answer(F.lit("mixed"), F.slice(close, 1, 3))).otherwise(unknown),
        )
        .otherwise(answer(best["name"], none))
    )


def music_intervals(windows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Ten-second windows that are music without texture (not merged)."""
    return windows.where(p.is_music(p.Scores.of(windows))).select(*by, "start", "end")


def with_scores(requests: DataFrame, table: DataFrame, by: Sequence[str] = BY, how: str = "left") -> DataFrame:
    """Look scores up by recording and window times (five decimals); unscored rows stay."""
    keyed = requests.withColumn("_key", span_key(F.col("start"), F.col("end")))
    scored = table.withColumn("_key", span_key(F.col("start"), F.col("end"))).drop("start", "end")
    fresh = [c for c in scored.columns if c not in keyed.columns or c in (*by, "_key")]
    return keyed.join(scored.select(*fresh), [*by, "_key"], how).drop("_key")


def coarse_to_fine(
    coarse: DataFrame, table: DataFrame, gate: Callable[[p.Scores], Column], width, step, min_len,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Expand coarse windows that pass the gate to fine windows and score those.

    The gate runs before the expansion and the score lookup, so the costly side
    only sees what passed.
    """
    from .grids import hop_windows

    passed = coarse.where(gate(p.Scores.of(coarse))).select(*by, "start", "end")
    fine = hop_windows(passed, width, step, min_len).distinct()
    return with_scores(fine, table, by)
