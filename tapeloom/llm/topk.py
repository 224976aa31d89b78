"""Exact top-k inner products with an impact-ordered index, a score at a time.

Every block of vectors has an index of its own: a posting list per dimension, cut into
segments of postings whose impact (the size of the component) quantises to the same
power of two.  A block of queries processes the segments of all dimensions by falling
impact times the largest query weight, and adds them to accumulators.  After each level the components not
seen yet bound what a score can still gain or lose.  A vector whose upper bound is below
the query's k-th best lower bound can't be a member; when few possible members are left,
that is the proof to stop, and they are scored anew in full.

Query blocks meet vector blocks in a grid: each cell is one task's bounded work, and a
vector or query is sent once for every block of the other side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import materialize

VECTORS, QUERIES = 8192, 512
#: Inside a cell, rows that are scored together.
PART = 1024
#: Processing stops when fewer than one vector in this many is a possible member.
FEW = 50
#: Below this norm products of two vectors, and the index's bounds of them, fit a long.
WHOLE = 2.0**28


class ImpactIndex:
    """Posting segments of a block of integer vectors, by falling quantised impact."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        rows, dims = vectors.shape
        size = np.abs(vectors)
        level = np.zeros(vectors.shape, dtype=np.int8)
        left = size.copy()
        while left.any():
            level += left > 0
            left >>= 1
        top = int(level.max(initial=0))
        # Level by level: the postings (dimension, row, component) whose size is in [2**(l-1), 2**l).
        self.levels = []
        for at in range(top, 0, -1):
            dim, row = np.nonzero(level.T == at)
            cuts = np.searchsorted(dim, np.arange(dims + 1))
            self.levels.append((row, vectors[row, dim], cuts))
        masked = [np.where(level <= at, vectors, 0) for at in range(top - 1, -1, -1)]
        # What the postings of all lower levels may add in each dimension.
        self.most = [m.max(axis=0, initial=0) for m in masked]
        self.least = [m.min(axis=0, initial=0) for m in masked]

    def search(self, queries: np.ndarray, k: int, floor: np.ndarray) -> list[np.ndarray]:
        """Rows of the possible members for each query; ``floor`` are k-th best scores known so far, and rise."""
        rows = len(self.vectors)
        scores = np.zeros((rows, len(queries)), dtype=np.int64)
        may = np.ones((rows, len(queries)), dtype=bool)
        for step, (row, value, cuts) in enumerate(self.levels):
            weight = np.abs(queries).max(axis=0, initial=0)
            for dim in np.argsort(-weight, kind="stable"):
                own = slice(cuts[dim], cuts[dim + 1])
                if weight[dim] and cuts[dim] < cuts[dim + 1]:
                    scores[row[own]] += value[own, None] * queries[None, :, dim]
            up, down = np.maximum(queries, 0), np.minimum(queries, 0)
            gain = up @ self.most[step] + down @ self.least[step]
            loss = up @ self.least[step] + down @ self.most[step]
            if rows > k:
                reached = np.partition(scores, rows - k, axis=0)[rows - k] + loss
                np.maximum(floor, reached, out=floor)
            may = scores + gain >= floor
            if may.sum() * FEW <= may.size:
                break
        return [np.flatnonzero(may[:, j]) for j in range(len(queries))]


def _matrix(column) -> np.ndarray:
    """Vectors of whole numbers as rows of doubles; shorter ones count as if padded with zeros."""
    out = np.zeros((len(column), max((len(x) for x in column), default=0)))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def best_of_cell(queries: np.ndarray, names: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (places, scores) of its k best vectors of a cell, ties to the earlier place; ``ids`` equal to its name take no part."""
    # One more is searched for: the query itself may be among the best.
    floor = np.full(len(queries), np.iinfo(np.int64).min)
    held: list[list[np.ndarray]] = [[] for _ in queries]
    for at in range(0, len(vectors), PART):
        for j, rows in enumerate(ImpactIndex(vectors[at : at + PART]).search(queries, k + 1, floor)):
            held[j].append(rows + at)
    out = []
    for j, parts in enumerate(held):
        rows = np.concatenate(parts)
        rows = rows[ids[rows] != names[j]]
        exact = vectors[rows] @ queries[j]
        order = np.lexsort((rows, -exact))[:k]
        out.append((rows[order], exact[order]))
    return out


def _beyond(queries: np.ndarray, names: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, list[int]]]:
    """The same with integers of any size, for vectors whose products a long may not hold."""
    out = []
    for query, name in zip(queries, names, strict=True):
        whole = [int(v) for v in query]
        rows = np.flatnonzero(ids != name)
        scores = [sum(int(a) * b for a, b in zip(vectors[i], whole, strict=True)) for i in rows]
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], i))[:k]
        out.append((rows[order], [scores[i] for i in order]))
    return out


def best_of_block(queries: np.ndarray, names: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, list[int]]]:
    """(places, scores) of the k best for each query: by the index where every product fits a long, exactly for the others too."""
    width = max(queries.shape[1], vectors.shape[1])
    queries, vectors = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, vectors))
    with np.errstate(over="ignore"):
        usual, sound = (np.sqrt((x**2).sum(axis=1)) < WHOLE for x in (queries, vectors))
    out: list[list[tuple[int, int]]] = [[] for _ in queries]

    def add(asked, rows, found):
        for j, (places, scores) in zip(asked, found, strict=True):
            out[j].extend(zip((int(s) for s in scores), rows[places].tolist(), strict=True))

    for asked, rows in ((usual, sound), (usual, ~sound), (~usual, np.ones_like(sound))):
        asked, rows = np.flatnonzero(asked), np.flatnonzero(rows)
        if len(asked) and len(rows):
            plain = usual[asked[0]] and sound[rows[0]] and sound[rows].all()
            kind = (lambda x: x.astype(np.int64)) if plain else (lambda x: x)
            add(asked, rows, (best_of_cell if plain else _beyond)(kind(queries[asked]), names[asked], kind(vectors[rows]), ids[rows], k))
    ends = np.iinfo(np.int64)
    final = []
    for found in out:
        found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
        final.append((np.array([p for _, p in found], dtype=np.int64), [max(ends.min, min(ends.max, s)) for s, _ in found]))
    return final


def whole_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """row (unique), vec_id and floor(scale * component) as doubles; vectors with a null or non-finite part, and null ids, are left out."""
    parts = F.transform("embedding", lambda x: x.cast("double"))
    known = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    rows = embeddings.select("vec_id", "embedding").filter(known).select("vec_id", parts.alias("x"))
    rows = rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    # From 2**53 on a double is whole.
    whole = F.transform("x", lambda v: F.when(F.abs(v * scale) < 2.0**53, F.floor(v * scale).cast("double")).otherwise(v * scale))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("x"))


def top_k(embeddings: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best vectors of each row whose vec_id is divisible by ``every``.

    Candidates are all rows but the query's own; ties go to the smaller vec_id; fewer
    rows than ``k`` give them all.  Vectors that are null, or hold a null or non-finite
    component, and rows without vec_id take no part.  Vectors of different length
    count as if padded with zeros.  Rows with one vec_id, equal rows too, are rows of
    their own.  Scores are exact whatever the size of the components; one outside a long
    is given as the nearest long.  An empty table gives no rows.
    """
    rows = materialize(whole_vectors(embeddings, scale))
    queries = rows.filter(F.col("vec_id") % every == 0)
    vector_blocks = max(1, -(-rows.count() // VECTORS))
    query_blocks = max(1, -(-queries.count() // QUERIES))
    side = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = queries.select(block(query_blocks).alias("a"), side(vector_blocks).alias("b"), "row", "vec_id", "x")
    right = rows.select(side(query_blocks).alias("a"), block(vector_blocks).alias("b"), "row", "vec_id", "x")

    def cell(one, two):
        import pandas as pd

        if not len(one) or not len(two):
            return pd.DataFrame({"query": [], "query_id": [], "row": [], "vec_id": [], "score": []}).astype("int64")
        two = two.sort_values(["vec_id", "row"])
        rows, ids = two["row"].to_numpy(), two["vec_id"].to_numpy()
        found = best_of_block(_matrix(one["x"]), one["row"].to_numpy(), _matrix(two["x"]), rows, k)
        sizes = [len(places) for places, _ in found]
        places = np.concatenate([p for p, _ in found])
        return pd.DataFrame({
            "query": np.repeat(one["row"].to_numpy(), sizes), "query_id": np.repeat(one["vec_id"].to_numpy(), sizes), "row": rows[places], "vec_id": ids[places],
            "score": np.array([s for _, scores in found for s in scores], dtype=np.int64),
        })

    cells = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(cell, "query long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
