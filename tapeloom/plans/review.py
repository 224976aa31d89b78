"""Plan, review, replan until a recording passes or cannot improve."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import CHUNK
from ..operators.timeline import output_to_source
from ..session import materialize

BY = ("rec_id",)


def review_loop(
    recordings: DataFrame,
    spoken: DataFrame,
    plan_fn: Callable[[DataFrame, DataFrame], DataFrame],
    review_fn: Callable[[DataFrame, int], DataFrame],
    max_passes: int | None = None,
    by: Sequence[str] = BY,
    chunk=CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """Review every plan of the catalogue; only open recordings are planned again.

    ``plan_fn(recordings, spoken)`` gives frame keeps, ``review_fn(keeps, pass)``
    gives findings on the output clock.  ``recordings`` carries ``dt`` and may
    carry its own ``review_max_passes``; ``max_passes`` bounds these, or stands for
    them where there are none (three if not given).  Findings move to the source clock and
    join the spoken time of the next pass.  A recording ends as ``passed`` without
    findings, as ``needs_review`` on its last pass, when nothing maps to the
    source or when another plan would keep nothing, and as ``empty`` when its
    first plan keeps nothing.
    Returns ``(status, passes)`` per recording and the final keeps.
    """
    by = list(by)
    own = "review_max_passes" in recordings.columns
    limit = F.least(F.col("review_max_passes"), F.lit(max_passes)) if own else F.lit(max_passes or 3)
    open_ = materialize(recordings.withColumn("_limit", limit.cast("int")))
    last = open_.agg(F.max("_limit")).first()[0] or 0
    spoken = spoken.select(*by, "start", "end")
    keeps = materialize(plan_fn(open_, spoken).select(*by, "start", "end"))
    statuses, plans = [], []

    def close(who: DataFrame, status: str, number: int) -> None:
        statuses.append(who.select(*by, F.lit(status).alias("status"), F.lit(number).alias("passes")))
        plans.append(keeps.join(who.select(*by), by, "left_semi"))

    planned = keeps.select(*by).distinct()
    close(open_.join(planned, by, "left_anti"), "empty", 0)
    open_ = materialize(open_.join(planned, by, "left_semi"))
    for number in range(1, last + 1):
        if open_.isEmpty():
            break
        findings = materialize(review_fn(keeps, number))
        found = findings.select(*by).distinct()
        close(open_.join(found, by, "left_anti"), "passed", number)
        failed = open_.join(found, by, "left_semi")
        timed = keeps.join(open_.select(*by, "dt"), by)
        mapped = materialize(output_to_source(findings, timed, F.col("dt"), by=by, chunk=chunk))
        hit = mapped.select(*by).distinct()
        # Nothing to cut, or no pass left: keep the candidate and flag it.
        close(failed.join(hit, by, "left_anti"), "needs_review", number)
        more = failed.join(hit, by, "left_semi")
        close(more.where(F.col("_limit") <= number), "needs_review", number)
        again = materialize(more.where(F.col("_limit") > number))
        if number == last or again.isEmpty():
            break
        spoken = materialize(spoken.unionByName(mapped.select(*by, "start", "end")))
        fresh = materialize(plan_fn(again, spoken.join(again.select(*by), by, "left_semi")).select(*by, "start", "end"))
        able = fresh.select(*by).distinct()
        close(again.join(able, by, "left_anti"), "needs_review", number)
        keeps = fresh
        open_ = materialize(again.join(able, by, "left_semi"))
    return reduce(DataFrame.unionByName, statuses), reduce(DataFrame.unionByName, plans)
