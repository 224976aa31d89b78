"""Clock text, rounding and stable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_clock(seconds: Column) -> Column:
    """``HH:MM:SS.mmm`` of the nearest millisecond (half to even)."""
    ms = F.bround(seconds * 1000, 0).cast("long")
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        F.floor(ms / 3600000),
        F.pmod(F.floor(ms / 60000), F.lit(60)),
        F.pmod(F.floor(ms / 1000), F.lit(60)),
        F.pmod(ms, F.lit(1000)),
    )


def format_short_clock(seconds: Column) -> Column:
    """``HH:MM:SS``, truncated and never negative."""
    whole = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    return F.format_string(
        "%02d:%02d:%02d", F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60))
    )


def identity_key(*parts) -> Column:
    """SHA-256 over the JSON text of an identity tuple, stable across runs."""
    fields = [F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit(None)).alias(f"p{i}") for i, p in enumerate(parts)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def span_key(start: Column, end: Column) -> Column:
    """Cache key of a window: both times with five decimals."""
    return F.concat(F.format_string("%.5f", start), F.lit(":"), F.format_string("%.5f", end))


def to_db(rms: Column) -> Column:
    return 20 * F.log10(F.greatest(rms, F.lit(1e-10)))


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def whole_ticks(seconds: Column, num: Column, den: Column) -> Column:
    """Seconds as whole ticks of ``num / den`` seconds, a half to the even tick; without rounding on the way.

    The decimal text of the seconds counts (up to 18 decimals).  ``num`` and ``den`` are
    positive whole numbers below 10**12, seconds times ``den`` must fit a long.
    """
    num, den = num.cast("long"), den.cast("long")
    exact = seconds.cast("decimal(30,18)")
    whole = F.floor(exact).cast("long")
    rest = (exact - whole.cast("decimal(12,0)")).cast("decimal(19,18)") * den.cast("decimal(12,0)")
    up = F.floor(rest).cast("long")
    units = whole * den + up
    over = F.pmod(units, num)
    ticks = F.call_function("div", units - over, num)
    twice = 2 * (over.cast("decimal(12,0)") + (rest - up.cast("decimal(14,0)")).cast("decimal(19,18)"))
    unit = num.cast("decimal(12,0)")
    return F.when((twice > unit) | ((twice == unit) & (F.pmod(ticks, F.lit(2)) == 1)), ticks + 1).otherwise(ticks)
