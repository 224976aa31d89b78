"""Per-recording settings: overlay, validation and the policy union of exclusions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import RETENTION, SETTING_CHOICES, SETTING_DEFAULTS, SETTING_RANGES
from ..operators import intervals as iv
from ..operators.scan import CHUNK
from ..session import attach

BY = ("rec_id",)


def _typed(name: str, text: Column) -> Column:
    default = SETTING_DEFAULTS[name]
    if isinstance(default, bool):
        # Only the two JSON booleans count.
        return F.when(text == "true", True).when(text == "false", False)
    if isinstance(default, int):
        return F.when(text.rlike(r"\A-?[0-9]+\z"), text.try_cast("int"))
    if isinstance(default, float):
        return text.try_cast("double")
    return text


def _rule(name: str) -> str:
    default = SETTING_DEFAULTS[name]
    if isinstance(default, bool):
        return "boolean"
    if name in SETTING_CHOICES:
        return "one of " + ", ".join(SETTING_CHOICES[name])
    low, high = SETTING_RANGES[name]
    return f"{low}..{high}"


def resolve_policy(overrides: DataFrame, by: Sequence[str] = BY) -> tuple[DataFrame, DataFrame]:
    """Overlay options (a map of JSON texts) on the defaults.

    Unknown keys, such as the retired silence length, are dropped.  Returns the
    typed policy, one row per recording, and the violations ``(field, value,
    rule)``; a field in violation is NULL in the policy.
    """
    by = list(by)
    given = lambda name: F.element_at("options", F.lit(name))
    values, valid = {}, {}
    for name, default in SETTING_DEFAULTS.items():
        value = _typed(name, given(name))
        if name in SETTING_CHOICES:
            good = value.isin(*SETTING_CHOICES[name])
        elif name in SETTING_RANGES:
            good = value.between(*SETTING_RANGES[name])
        else:
            good = value.isNotNull()
        good = F.coalesce(good, F.lit(False))
        valid[name] = good
        values[name] = F.when(given(name).isNull(), F.lit(default)).when(good, value)
    policy = overrides.select(*by, *[v.alias(n) for n, v in values.items()])
    issues = F.array_compact(
        F.array(
            *[
                F.when(
                    given(n).isNotNull() & ~valid[n],
                    F.struct(F.lit(n).alias("field"), given(n).alias("value"), F.lit(_rule(n)).alias("rule")),
                )
                for n in SETTING_DEFAULTS
            ]
        )
    )
    return policy, overrides.select(*by, F.explode(issues).alias("_i")).select(*by, "_i.*")


def policy_union(intervals: DataFrame, policy: DataFrame, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """Confirmed transitions plus every category whose keep flag is off, merged.

    ``intervals`` has a ``category``; other categories are ignored here.
    """
    by = list(by)
    wanted = intervals.where(F.col("category").isin("transitions", *RETENTION))
    flags = policy.select(*by, *[setting for setting, _ in RETENTION.values()])
    rows = attach(wanted, flags, by, F.col("start"), how="left")
    dropped = reduce(
        lambda chain, item: chain.when(F.col("category") == item[0], ~F.coalesce(F.col(item[1][0]), F.lit(item[1][1]))),
        RETENTION.items(),
        F.when(F.col("category") == "transitions", True),
    )
    return iv.merge(rows.where(dropped).select(*by, "start", "end"), 0, by, chunk)


def extract_scope(
    excluded: DataFrame, categories: DataFrame, positive: DataFrame, recordings: DataFrame, by: Sequence[str] = BY, chunk=CHUNK
) -> DataFrame:
    """Extraction also blocks breaks of every kind and all time that is not positive.

    Only ``recordings`` (those in extract mode) are widened.
    """
    by = list(by)
    kinds = categories.where(F.col("category").isin("airflow", "drinking", "impacts", "loud_laugh")).select(*by, "start", "end")
    here = recordings.select(*by)
    outside = iv.complement(positive.join(here, by, "left_semi"), recordings, by, chunk)
    rows = excluded.select(*by, "start", "end").unionByName(kinds.join(here, by, "left_semi")).unionByName(outside)
    return iv.merge(rows, 0, by, chunk)
