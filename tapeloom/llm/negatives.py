"""Hard negatives for anchors, with score bounds handed down a spanning tree of the anchors.

Anchors are ordered by label and by the signs of fixed random projections, and cut into
trees of neighbours: a minimum spanning tree of Euclidean distances per cut.  In a tree a
parent's score with a candidate bounds the child's: it lies within edge distance times
candidate norm of it, and within the product of both norms of zero.  A child scores anew
only the candidates whose bounds meet its windows; for the others the wider bounds are
handed on.

Two passes over a grid of anchor groups and candidate blocks: the first finds each
anchor's positives (rows of its label, window: from its k-th best score up), the second
the negatives (rows of other labels, windows: between two shares of a positive's score).
A cell is one task's bounded work; a row is sent once for every group of trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import materialize

from .common import ranked

#: Anchors of a tree, trees that visit a block together, and candidates of a block.
TREE, TREES, BLOCK = 512, 16, 4096
#: Projections whose signs put similar anchors side by side.
SIGNS = 16
#: Norm products up to which scores and window tests are exact in doubles.
EXACT = 2.0**46
_LONG = 2**63 - 1


def sound(embeddings: DataFrame, scale: int, shift: int, classes: int) -> DataFrame:
    """row (unique), vec_id, label, x (whole components as doubles); rows without label or with null or non-finite parts are left out."""
    scaled = F.transform("embedding", lambda v: v.cast("double") * scale)
    whole = F.transform("x", lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % shift == 0, (label + 1) % classes).otherwise(label)
    rows = embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", moved.alias("label"), scaled.alias("x"))
    rows = rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("x"))


def matrix(lists: list) -> np.ndarray:
    """Vectors as rows; shorter ones count as if padded with zeros."""
    out = np.zeros((len(lists), max((len(x) for x in lists), default=0)))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def signs(vectors: np.ndarray) -> np.ndarray:
    """Gray rank of the signs of fixed projections: neighbours in rank differ in few signs."""
    with np.errstate(over="ignore", invalid="ignore"):
        side = vectors @ np.random.default_rng(42).standard_normal((vectors.shape[1], SIGNS)) > 0
    code = side @ (1 << np.arange(SIGNS, dtype=np.int64))
    for step in (1, 2, 4, 8):
        code ^= code >> step
    return code


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order from the root down, and for each place of it the parent's place (-1: root) and the distance to it."""
    n = len(vectors)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    near, by, left = np.full(n, np.inf), np.full(n, -1, np.int64), np.ones(n, dtype=bool)
    with np.errstate(over="ignore"):
        for at in range(n):
            own = int(np.argmin(np.where(left, near, np.inf))) if at else 0
            if not left[own]:  # only distances beyond a double are left
                own = int(np.flatnonzero(left)[0])
            order[at], parent[at], edge[at] = own, by[own], near[own] if at else 0.0
            left[own] = False
            far = np.sqrt(((vectors - vectors[own]) ** 2).sum(axis=1))
            closer = left & ((far < near) | (by < 0))
            near[closer], by[closer] = far[closer], at
    return order, parent, edge


def products(candidates: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; as Python integers where doubles could round."""
    if exact:
        return candidates @ anchor
    whole = [int(v) for v in anchor]
    return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in candidates], dtype=object)


def scored(anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, candidates: np.ndarray, window: Callable, counted: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, candidates, scores) for each anchor of a tree: every candidate whose bounds meet the anchor's window.

    ``window(place, low, high)`` marks the candidates that may be asked for by their bounds.
    ``counted`` gets the number of scores computed.
    """
    with np.errstate(over="ignore"):
        norms, own = np.sqrt((candidates**2).sum(axis=1)), np.sqrt((anchors**2).sum(axis=1))
        exact = bool(norms.max(initial=0) * own.max(initial=0) <= EXACT)
    if not exact:
        everything = np.full(len(candidates), np.inf)
        for place in range(len(anchors)):
            rows = np.flatnonzero(window(place, -everything, everything))
            yield place, rows, products(candidates[rows], anchors[place], False)
        return
    lows, highs = np.empty((len(anchors), len(candidates))), np.empty((len(anchors), len(candidates)))
    norms *= 1 + 1e-12
    for place, anchor in enumerate(anchors):
        up, low, high = parent[place], lows[place], highs[place]
        np.multiply(norms, own[place], out=high)
        np.negative(high, out=low)
        if up < 0:
            asked = np.ones(len(candidates), dtype=bool)
        else:
            step = norms * edge[place] + 1
            np.maximum(low, lows[up] - step, out=low)
            np.minimum(high, highs[up] + step, out=high)
            asked = window(place, low, high)
        rows = np.flatnonzero(asked)
        if 2 * len(rows) > len(candidates):
            low[:] = high[:] = products(candidates, anchor, True)
            rows = np.flatnonzero(window(place, low, high))
        else:
            low[rows] = high[rows] = products(candidates[rows], anchor, True)
        if counted is not None:
            counted.append(len(rows))
        yield place, rows, low[rows]


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def positive_window(same: Callable, k: int) -> Callable:
    """Candidates that ``same(place)`` admits, from the k-th best lower bound up."""

    def window(place, low, high):
        may = same(place)
        return may & (high >= _kth(low[may], k))

    return window


def negative_window(other: Callable, positives: Callable, shares: tuple[int, int], k: int) -> Callable:
    """Candidates that ``other(place)`` admits, in reach of the window of one of the anchor's positive scores."""

    def window(place, low, high):
        may, found = other(place), np.zeros(len(low), dtype=bool)
        for score in positives(place):
            least, most = shares[0] * score, shares[1] * score
            if least > most:
                continue
            sure = may & (100 * low >= least) & (100 * high <= most)
            found |= may & (100 * high >= least) & (100 * low <= most) & (high >= _kth(low[sure], k))
        return found

    return window


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores; the candidates stand in the order that breaks ties."""
    return np.argsort(-scores, kind="stable")[:k]


def _in_long(scores: np.ndarray) -> list[int]:
    return [max(-_LONG - 1, min(_LONG, int(s))) for s in scores]


def _in_order(table):
    """Candidates in the order that breaks ties: vec_id (null last), then row."""
    return table.sort_by([("nameless", "ascending"), ("vec_id", "ascending"), ("row", "ascending")])


def _parts(table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, object]]:
    """(vectors, rows, labels, ids) of the candidates in order; those beyond exact doubles in a part of their own."""
    vectors, rows, labels = matrix(table["x"].to_pylist()), table["row"].to_numpy(), table["label"].to_numpy()
    with np.errstate(over="ignore"):
        large = np.sqrt((vectors**2).sum(axis=1)) > EXACT**0.5
    for part in (np.flatnonzero(~large), np.flatnonzero(large)):
        if len(part):
            yield vectors[part], rows[part], labels[part], table["vec_id"].take(part)


def _trees(table) -> Iterator[dict]:
    """The trees of a group, each from its root down."""
    table = table.sort_by([("tree", "ascending"), ("place", "ascending")])
    names = table["tree"].to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = table.slice(a, b - a)
        own = {c: part[c].to_numpy() for c in ("row", "vec_id", "label", "parent", "edge")}
        yield own | {"x": matrix(part["x"].to_pylist()), "positives": part["positives"].to_pylist() if "positives" in part.column_names else None}


def _even(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (a, b))


def _grid(trees: DataFrame, rows: DataFrame, groups: int, blocks: int):
    """Anchor groups and candidate blocks, each side sent to all of the other."""
    side = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = trees.withColumn("a", (F.col("tree") / TREES).cast("int")).withColumn("b", side(blocks))
    right = rows.select(side(groups).alias("a"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("b"), "row", "vec_id", F.col("vec_id").isNull().alias("nameless"), "label", "x")
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b"))


def trees_of(anchors: DataFrame, size: int = TREE) -> DataFrame:
    """tree, place, parent, edge and the columns row, vec_id, label, x of every anchor; stored."""

    def code(batches):
        import pyarrow as pa

        for batch in batches:
            found = signs(matrix(batch.column(3).to_pylist())) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "code"])

    kinds = "row long, vec_id long, label long, x array<double>"
    placed = ranked(anchors.select("row", "vec_id", "label", "x").mapInArrow(code, kinds + ", code long"), ["label", "code", "row"])

    def grow(table):
        import pyarrow as pa

        table = table.sort_by("row")
        order, parent, edge = spanning_tree(matrix(table["x"].to_pylist()))
        out = table.take(order)
        places = [pa.array(np.arange(len(order))), pa.array(parent), pa.array(edge)]
        return pa.Table.from_arrays([out["tree"], *places, *(out[c] for c in ("row", "vec_id", "label", "x"))], names=["tree", "place", "parent", "edge", "row", "vec_id", "label", "x"])

    cut = placed.select((F.col("_rank") / size).cast("long").alias("tree"), "row", "vec_id", "label", "x")
    return materialize(cut.groupBy("tree").applyInArrow(grow, f"tree long, place long, parent long, edge double, {kinds}"))


def hard_negatives(
    embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, shares: tuple[int, int] = (50, 95),
    scale: int = 256, shift: int = 7, classes: int = 10, tree: int = TREE, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: each anchor's positives and their hard negatives.

    A row with a null label or vector, or a null or non-finite component, takes no part;
    where ``shift`` divides vec_id the label is moved on by one first.  Anchors are rows
    whose vec_id is divisible by ``every``, positives their best other rows of one label,
    negatives the best rows of another label whose score is between both ``shares`` (in
    hundredths) of the positive's.  Ties go to the smaller vec_id, null last.  Rows with
    one vec_id, equal rows too, are rows of their own.  A negative positive score has an
    empty window.  Shorter vectors count as if padded with zeros; an empty one scores
    zero.  Scores are exact; one outside a long is given as the nearest long.  Anchors
    without positives and positives without negatives give no rows, nor does an empty
    table.  Other columns aren't read.
    """
    rows = materialize(sound(embeddings, scale, shift, classes))
    trees = trees_of(rows.filter(F.col("vec_id") % every == 0), tree)
    blocks = max(1, -(-rows.count() // block))
    groups = (trees.agg(F.max("tree")).first()[0] or 0) // TREES + 1

    def near(one, two):
        import pyarrow as pa

        out = [[], [], [], []]
        ids = []
        if one.num_rows and two.num_rows:
            two = _in_order(two)
            for vectors, names, labels, own_ids in _parts(two):
                for t in _trees(one):
                    anchors, candidates = _even(t["x"], vectors)
                    same = lambda p, t=t, labels=labels, names=names: (labels == t["label"][p]) & (names != t["row"][p])
                    for place, found, scores in scored(anchors, t["parent"], t["edge"], candidates, positive_window(same, positives)):
                        keep = same(place)[found]
                        found, scores = found[keep], scores[keep]
                        best = _best(scores, positives)
                        out[0].extend([t["row"][place]] * len(best))
                        out[1].extend(names[found[best]].tolist())
                        out[2].extend(_in_long(scores[best]))
                        ids.append(own_ids.take(found[best]))
        ids = pa.concat_arrays([c for x in ids for c in x.chunks]) if any(len(x) for x in ids) else pa.array([], pa.int64())
        return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), ids], names=["row", "positive", "score", "positive_id"])

    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "positive")
    pairs = _grid(trees, rows, groups, blocks).applyInArrow(near, "row long, positive long, score long, positive_id long")
    best = pairs.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= positives)
    lists = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("positive", "positive_id", "score"))).alias("positives"))
    asked = materialize(trees.join(lists, "row", "left"))

    def hard(one, two):
        import pyarrow as pa

        out = [[] for _ in range(7)]
        if one.num_rows and two.num_rows:
            two = _in_order(two)
            for vectors, names, labels, own_ids in _parts(two):
                for t in _trees(one):
                    anchors, candidates = _even(t["x"], vectors)
                    other = lambda p, t=t, labels=labels: labels != t["label"][p]
                    own = lambda p, t=t: [q["score"] for q in t["positives"][p] or ()]
                    for place, found, scores in scored(anchors, t["parent"], t["edge"], candidates, negative_window(other, own, shares, negatives)):
                        keep = other(place)[found]
                        found, scores = found[keep], scores[keep]
                        for q in t["positives"][place] or ():
                            inside = np.flatnonzero((100 * scores >= shares[0] * q["score"]) & (100 * scores <= shares[1] * q["score"]))
                            best = inside[_best(scores[inside], negatives)]
                            n = len(best)
                            for column, value in zip(out, ([t["row"][place]] * n, [t["vec_id"][place]] * n, [q["positive"]] * n, [q["positive_id"]] * n, [q["score"]] * n,
                                                           _in_long(scores[best]), own_ids.take(found[best]).to_pylist()), strict=True):
                                column.extend(value)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], names=["row", "anchor_id", "positive", "positive_id", "positive_score", "negative_score", "negative_id"])

    found = _grid(asked, rows, groups, blocks).applyInArrow(
        hard, "row long, anchor_id long, positive long, positive_id long, positive_score long, negative_score long, negative_id long")
    place = Window.partitionBy("row", "positive").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    ranks = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= negatives)
    return ranks.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
