"""Length buckets with the least padding, and token-budget batches inside each bucket.

Lengths are counted over all documents.  Dynamic programming over that histogram
chooses the upper ends of the buckets: of all choices of at most ``buckets`` ends, the
one with the fewest padding words.  Every document goes to the first bucket it fits in
and is padded to its end; a batch takes as many documents of one bucket as fit the
token budget, at least one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.session import materialize

from .common import spread_offsets, word_count

BUCKETS = 12
BUDGET = 16384


def best_ends(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Bucket ends with the least padding; ``lengths`` ascending and different, with rows and words of each.

    The cost of a bucket (i, j] is end_j * rows - words.  The best split point of a longer
    prefix never lies before that of a shorter one, so each layer is solved by halving.
    """
    n = len(lengths)
    rows, words = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(sums)])
    best = lengths * rows[1:] - words[1:]
    chosen = [np.zeros(n, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        now, split = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
        stack = [(0, n - 1, 0, n - 1)]
        while stack:
            a, b, low, high = stack.pop()
            if a > b:
                continue
            mid = (a + b) // 2
            i = np.arange(low, min(mid, high + 1)) if mid else np.arange(0)
            cost = best[i] + lengths[mid] * (rows[mid + 1] - rows[i + 1]) - (words[mid + 1] - words[i + 1])
            k = int(i[np.argmin(cost)]) if len(i) else low
            if len(i):
                now[mid], split[mid] = cost[k - low], k
            stack += [(a, mid - 1, low, k), (mid + 1, b, k, high)]
        better = now < best
        chosen.append(np.where(better, split, -1))
        best = np.where(better, now, best)
    ends, at = [], n - 1
    for layer in range(len(chosen) - 1, -1, -1):
        if layer and chosen[layer][at] < 0:
            continue
        ends.append(int(lengths[at]))
        at = int(chosen[layer][at])
        if not layer:
            break
    return ends[::-1]


def bucket_ends(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Ends for a table with a ``length`` column; texts of length 0 count as 1.

    The histogram reaches the driver: one row per different length, so no more than the
    words of the longest text, nor than the root of twice the words of all texts.
    """
    cells = lengths.groupBy(F.greatest("length", F.lit(1)).cast("long").alias("end")).agg(F.count("*").alias("rows"))
    found = sorted(tuple(r) for r in cells.collect())
    if not found:
        return []
    ends, rows = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
    return best_ends(ends, rows, ends * rows, buckets)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, length, bucket, bucket_end, batch, place and padding of every row.

    ``length`` counts words; null and blank texts have length 0 and are padded to the first
    end.  Batches are numbered inside their bucket and, but for the last, full: as many
    rows as fit ``budget`` words of padded length, one if a single row is longer.  The
    order inside a bucket is hashed.  Repeated rows are packed one by one.  No rows give none.
    """
    rows = materialize(docs.select(*keep, word_count(F.col("text")).alias("length"), F.xxhash64("text").alias("_h")))
    ends = bucket_ends(rows, buckets)
    if not ends:
        ends = [1]
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("length") <= ends[k], F.lit(k)).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("bucket_end", F.get(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("bucket")))
    placed = spread_offsets(rows, ["bucket"], [F.col("doc_id"), F.col("_h")], F.lit(1).cast("long"), max(256, rows.count() // 20_000))
    many = F.greatest(F.expr(f"{budget} div bucket_end"), F.lit(1).cast("long"))
    placed = placed.withColumn("_many", many)
    return placed.select(
        *keep, "length", "bucket", "bucket_end", F.expr("_start div _many").alias("batch"), F.expr("_start % _many").cast("int").alias("place"),
        (F.col("bucket_end") - F.col("length")).alias("padding"),
    )
