"""Quality rules: how far the characters and common words of a text lie from those of its language.

Every language (null is one of its own) has a reference: the share of six
character classes and of its commonest words over all its documents.  A document
is compared with it by Jensen-Shannon distance (base 2, 0 to 1).  Short texts have
uneven histograms by chance, so the accepted distance is ``far + slack / sqrt(words)``,
and texts below the guard, or languages with too few words, aren't judged by it.
All of it is made of DataFrame functions; a text never leaves its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import materialize

from .common import SPACE

#: Character classes as patterns of what does not belong to them; what is in none is the last class.
CLASSES = ("[^a-z]+", "[^A-Z]+", "[^0-9]+", "[^.,;:!?'\"()-]+", "[^#*$%&|<>]+")


@dataclass(frozen=True)
class Limits:
    """Accepted distances; ``common`` words make up the word histogram."""

    common: int = 24
    class_far: float = 0.16
    class_slack: float = 1.2
    word_far: float = 0.18
    word_slack: float = 1.3
    guard_words: int = 50
    reference_words: int = 1000


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _classes(text: Column, word_chars: Column) -> Column:
    counts = [F.length(F.regexp_replace(text, p, "")) for p in CLASSES]
    return F.array(*[c.cast("double") for c in counts], (word_chars - sum(counts)).cast("double"))


def measured(docs: DataFrame) -> DataFrame:
    """``_row``, lang, the words ``_w``, ``_classes`` and the base counts of whole texts; null texts have no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("_row", "lang", text.alias("_t"), _words(F.col("text")).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))
    step = step.select("*", lines.alias("_lines"), windows.alias("_h"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"))
    again = F.size("_h") > F.size(F.array_distinct("_h"))
    placed = F.when(again, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    step = step.select(
        "_row", "lang", "_w", "word_chars", placed.alias("_s"), _classes(F.col("_t"), F.col("word_chars")).alias("_classes"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    same = F.filter("_s", lambda e, k: (F.get("_s", k - 1)["h"] == e["h"]) | (F.get("_s", k + 1)["h"] == e["h"]))
    step = step.withColumn("_at", F.sort_array(F.transform(same, lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return step.select(
        "_row", "lang", "_w", "_classes", F.size("_w").cast("long").alias("n_words"), "word_chars",
        F.get("_classes", F.lit(4)).cast("long").alias("n_symbols"), "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def references(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per language: ``ref_words`` (word -> bin from 1), shares of words and classes, number of words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("lang", F.explode(_words(F.col("text"))).alias("w"))
    counts = words.filter(F.col("w").rlike(r"^\p{L}+$")).groupBy("lang", "w").agg(F.count("*").alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("c"), "w")
    top = counts.withColumn("bin", F.row_number().over(order)).filter(F.col("bin") <= limits.common)
    lists = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bin", "w", "c"))).alias("top"))
    size = F.length(F.regexp_replace(text, SPACE, "")).cast("long")
    totals = docs.select("lang", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n"), _classes(text, size).alias("k"))
    sums = totals.groupBy("lang").agg(F.sum("n").alias("total"), *[F.sum(F.get("k", F.lit(i))).alias(f"k{i}") for i in range(6)])
    joined = sums.alias("s").join(lists.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")), "left")
    total = F.greatest(F.col("total"), F.lit(1)).cast("double")
    chars = F.greatest(sum(F.col(f"k{i}") for i in range(6)), F.lit(1.0))
    return joined.select(
        F.col("s.lang").alias("ref_lang"), F.col("total").alias("ref_total"),
        F.map_from_arrays(F.transform("top", lambda e: e["w"]), F.transform("top", lambda e: e["bin"])).alias("ref_words"),
        F.transform("top", lambda e: e["c"] / total).alias("ref_shares"),
        F.array(*[F.col(f"k{i}") / chars for i in range(6)]).alias("ref_classes"),
    )


def _half(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    parts = F.zip_with(p, q, lambda a, b: (_half(a, (a + b) / 2) + _half(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _with_rest(shares: Column) -> Column:
    rest = F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda s, x: s + x)
    return F.concat(shares, F.array(F.greatest(rest, F.lit(0.0))))


def judge(docs: DataFrame, limits: Limits = Limits(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Base counts, both distances and the verdict of every document.

    Columns: those of ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance, kept.  Null and blank texts have
    zero counts and fail the base rules.  A null language has its own reference.
    Distances are null where the guards leave a text out.  Repeated rows come back
    as often; an empty table gives no rows.
    """
    ref = materialize(references(docs.select("text", "lang"), limits))
    rows = measured(docs.select(F.struct(*keep).alias("_row"), "text", "lang"))
    rows = rows.join(ref, rows["lang"].eqNullSafe(ref["ref_lang"]), "left")
    bins = F.array_remove(F.transform("_w", lambda x: F.coalesce(F.try_element_at("ref_words", x), F.lit(0))), 0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    guarded = failed | (F.col("n_words") < limits.guard_words) | (F.col("ref_total") < limits.reference_words) | F.col("ref_words").isNull()
    rows = rows.withColumn("base_failed", failed).withColumn("_guarded", guarded).withColumn("_bins", F.when(~guarded, bins))
    n, chars = F.col("n_words").cast("double"), F.aggregate("_classes", F.lit(0.0), lambda s, x: s + x)
    shares = F.transform(F.sequence(F.lit(1), F.size("ref_shares")), lambda b: (F.size("_bins") - F.size(F.array_remove(F.col("_bins"), b))) / n)
    rows = rows.withColumn("word_distance", F.when(~guarded, distance(_with_rest(shares), _with_rest(F.col("ref_shares")))))
    rows = rows.withColumn("class_distance", F.when(~guarded, distance(F.transform("_classes", lambda x: x / chars), F.col("ref_classes"))))
    near = (F.col("class_distance") <= limits.class_far + limits.class_slack / F.sqrt(n)) & (F.col("word_distance") <= limits.word_far + limits.word_slack / F.sqrt(n))
    # The id is never negative.  It keeps a later filter by the verdict above this projection; pushed
    # below, the filter would repeat every expression that the verdict is made of.
    kept = ~F.col("base_failed") & F.coalesce(near, F.lit(True)) & (F.monotonically_increasing_id() >= 0)
    return rows.select(
        "_row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", kept.alias("kept")
    )


def kept(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    whole = docs.select("text", "lang", F.struct(*docs.columns).alias("_whole"))
    return judge(whole, limits, ("_whole",)).filter("kept").select("_whole.*")
