"""URL filter by the ratio of two character language models.

Rules (host and path) decide the URLs they fit.  These are also the examples: one
variable-order Markov model is counted on the accepted URLs and one on the rejected
ones.  A model keeps the contexts of up to five characters that were seen often enough; a
character is predicted by the longest kept context, interpolated with all shorter ones by
the number of different characters that followed them.  The difference of both log
likelihoods per character is turned into a probability on rule-decided URLs that were not
counted, and decides the other URLs.

The commonest contexts travel to the tasks.  A character that needs any other one leaves
its task as a window of the characters before it; the different windows are joined with
the table of contexts, and the results with their rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.session import attach, materialize

from .common import in_slices

#: Verdict and rule; a rule is a host, which stands for its subdomains too, and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ORDER = 5
#: A context must have been seen this often.
SEEN = 4
#: Contexts of each model that travel to the tasks; those beyond are joined.
CACHED = 20_000
#: Every fifth of the examples, by a hash of the URL, calibrates.
FOLDS = 5
BINS, WIDEST = 400, 4.0
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path of a URL; both empty for null and for a URL without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule and _by_rule (its verdict); the longest fitting rule wins, the earlier one of equals."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, rule in sorted(rules, key=lambda r: len(r[1])):
        site, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((F.col("host") == site) | F.col("host").endswith("." + site)) & F.col("path").startswith(start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, say).otherwise(verdict)
    return rows.withColumn("rule", name).withColumn("_by_rule", verdict)


def followers(examples: DataFrame) -> DataFrame:
    """(verdict, context, next, c): how often a byte follows each context of up to five bytes; summed per batch first."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            for part in in_slices(batch, 20_000):
                found: Counter = Counter()
                for verdict, url in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    line = b"\x02" + url + b"\x03"
                    for n in range(ORDER + 1):
                        found.update((verdict, line[i - n : i], line[i]) for i in range(max(n, 1), len(line)))
                verdicts, contexts, nexts = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(verdicts, pa.string()), pa.array(contexts, pa.binary()), pa.array(nexts, pa.int32()), pa.array(list(found.values()), pa.int64())],
                    names=["verdict", "context", "next", "c"],
                )

    made = examples.select("_by_rule", F.col("url").cast("binary")).mapInArrow(run, "verdict string, context binary, next int, c long")
    return made.groupBy("verdict", "context", "next").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """context -> (seen, different followers, {byte: count}); the empty context is always there."""

    contexts: dict[bytes, tuple[int, int, dict[int, int]]]

    def log_likelihood(self, url: bytes, open_: list | None = None) -> float:
        """Natural log probability of the bytes of a URL and its end.

        Bytes whose context ends at one that is not here are left out and appended to
        ``open_``, if given: (bytes before, byte, length of that context, probability so far).
        """
        line, total = b"\x02" + url + b"\x03", 0.0
        get = self.contexts.get
        for i in range(1, len(line)):
            p, byte = 1 / 256, line[i]
            for n in range(min(ORDER, i) + 1):
                found = get(line[i - n : i])
                if found is None:
                    if open_ is not None:
                        open_.append((line[max(0, i - ORDER) : i], byte, n, p))
                        p = 1.0
                    break
                seen, kinds, after = found
                p = (after.get(byte, 0) + kinds * p) / (seen + kinds)
            total += float(np.log(p))
        return total


def contexts(counts: DataFrame) -> DataFrame:
    """(verdict, context, seen, after) of the kept contexts; ``after`` lists following bytes with counts, 256 at most."""
    totals = counts.groupBy("verdict", "context").agg(F.sum("c").alias("seen"), F.array_sort(F.collect_list(F.struct("next", "c"))).alias("after"))
    return materialize(totals.filter((F.col("seen") >= SEEN) | (F.length("context") == 0)))


def models(kept: DataFrame, cached: int = CACHED) -> tuple[dict[str, Model], DataFrame | None]:
    """Both models of the ``cached`` commonest contexts, shorter ones first among equals, and the table of the others, if any.

    A context is seen no more often than its own end, so the ends of a cached one are cached too.
    """
    out, others = {}, []
    for verdict in ("allow", "block"):
        own = kept.filter(F.col("verdict") == verdict)
        rows = own.orderBy(F.desc("seen"), F.length("context"), "context").limit(cached).collect()
        if rows:
            out[verdict] = Model({bytes(r["context"]): (r["seen"], len(r["after"]), {a["next"]: a["c"] for a in r["after"]}) for r in rows})
        if len(rows) == cached:
            last = F.struct(F.lit(-rows[-1]["seen"]).cast("long"), F.lit(len(rows[-1]["context"])), F.lit(rows[-1]["context"]))
            others.append(own.filter(F.struct(-F.col("seen"), F.length("context"), "context") > last))
    rest = reduce(DataFrame.unionByName, others) if others else None
    return out, None if rest is None or rest.isEmpty() else rest


def resolved(opened: DataFrame, others: DataFrame) -> DataFrame:
    """(verdict, window, byte, log) of the different windows of ``opened`` for which ``others`` knows more contexts."""
    once = opened.groupBy("verdict", "window", "byte").agg(F.min("n").alias("n"), F.min("p").alias("p"))
    tried = once.withColumn("n", F.explode(F.sequence("n", F.length("window"))))
    tried = tried.withColumn("context", F.expr("substring(window, length(window) - n + 1, n)"))
    here = F.aggregate("after", F.lit(0).cast("long"), lambda t, x: t + F.when(x["next"] == F.col("byte"), x["c"]).otherwise(0))
    steps = tried.join(others, ["verdict", "context"]).select("verdict", "window", "byte", "p", F.struct("n", here.alias("c"), F.size("after").alias("kinds"), "seen").alias("step"))
    each = steps.groupBy("verdict", "window", "byte").agg(F.min("p").alias("p"), F.sort_array(F.collect_list("step")).alias("steps"))
    p = F.aggregate("steps", F.col("p"), lambda p, s: (s["c"] + s["kinds"] * p) / (s["seen"] + s["kinds"]))
    return each.select("verdict", "window", "byte", F.log(p).alias("log"))


def ratios(rows: DataFrame, pair: dict[str, Model], others: DataFrame | None, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns and ``ratio``, the difference of both log likelihoods per byte (end included); null urls are empty."""
    whole = others is None

    def run(batches):
        import pyarrow as pa

        window = pa.list_(pa.struct([("verdict", pa.string()), ("window", pa.binary()), ("byte", pa.int32()), ("n", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            for part in in_slices(batch, 2000):
                sums, sizes, opened = [], [], []
                for url in part.column(len(keep)).to_pylist():
                    url, total, found = url or b"", 0.0, []
                    for verdict, sign in (("allow", 1), ("block", -1)):
                        open_: list = []
                        total += sign * pair[verdict].log_likelihood(url, None if whole else open_)
                        found.extend((verdict, *x) for x in open_)
                    sums.append(total)
                    sizes.append(len(url) + 1)
                    opened.append(found)
                made = [pa.array(sums, pa.float64()), pa.array(sizes, pa.int64()), pa.array(opened, window)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *made], names=[*keep, "_sum", "_size", "_open"])

    slim = rows.select(*keep, F.col("url").cast("binary").alias("url"))
    schema = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in keep)
    read = slim.mapInArrow(run, schema + ", _sum double, _size long, _open array<struct<verdict:string,window:binary,byte:int,n:int,p:double>>")
    if whole:
        return materialize(read.select(*keep, (F.col("_sum") / F.col("_size")).alias("ratio")))
    read = materialize(read.withColumn("_row", F.monotonically_increasing_id()))
    opened = read.select("_row", F.explode("_open").alias("_o")).select("_row", "_o.*")
    logs = attach(opened, resolved(opened, others), ["verdict", "window", "byte"], F.col("_row"), how="left")
    sign = F.when(F.col("verdict") == "allow", 1.0).otherwise(-1.0)
    more = logs.groupBy("_row").agg(F.sum(sign * F.coalesce("log", F.log("p"))).alias("_more"))
    both = F.col("_sum") + F.coalesce("_more", F.lit(0.0))
    return materialize(read.drop("_open").join(more, "_row", "left").select(*keep, (both / F.col("_size")).alias("ratio")))


def calibrated(scored: DataFrame) -> tuple[float, float]:
    """Slope and offset of the probability of acceptance, from a histogram of ``ratio`` by ``_by_rule`` over all rows."""
    bins = F.round(F.greatest(F.least(F.col("ratio"), F.lit(WIDEST)), F.lit(-WIDEST)) * (BINS / WIDEST)).cast("int")
    found = scored.groupBy(bins.alias("bin")).agg(F.sum((F.col("_by_rule") == "allow").cast("long")).alias("yes"), F.count("*").alias("all")).collect()
    x = np.array([r["bin"] * WIDEST / BINS for r in found])
    yes, every = np.array([r["yes"] for r in found], dtype=float), np.array([r["all"] for r in found], dtype=float)
    if not len(x) or yes.sum() in (0, every.sum()):
        return 1.0, 0.0
    yes, every = yes / every.sum(), every / every.sum()
    a, b = 1.0, 0.0
    for _ in range(50):  # damped Newton steps with a small penalty on the slope
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g = np.array([((every * p - yes) * x).sum() + 1e-4 * a, (every * p - yes).sum()])
        v = every * p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 1e-4, (v * x).sum()], [(v * x).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def judge(pages: DataFrame, rules=RULES, cached: int = CACHED) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio, p_allow of every row.

    Where no rule fits, ``verdict`` is allow from probability one half on.  Null URLs and
    those without ``://`` have empty host and path and are judged by their characters;
    without examples of both kinds the method allows everything, with a null ratio.
    Repeated rows are judged one by one; an empty table gives no rows.
    """
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    rows = materialize(ruled(pages, rules).withColumn("_counted", fold != 0))
    kept = contexts(followers(rows.filter("_by_rule is not null and _counted")))
    pair, others = models(kept, cached)
    if len(pair) < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("ratio"), F.lit(None).cast("double").alias("p_allow"))
    scored = ratios(rows, pair, others, ("page_id", "host", "path", "rule", "_by_rule", "_counted"))
    slope, offset = calibrated(scored.filter("_by_rule is not null and not _counted"))
    p = 1 / (1 + F.exp(-(F.col("ratio") * slope + offset)))
    scored = scored.withColumn("p_allow", p)
    verdict = F.coalesce("_by_rule", F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio", "p_allow")
