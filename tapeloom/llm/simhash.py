"""SimHash near-duplicates, found by hierarchical indexes over Gray-ordered fingerprints.

Fingerprints that differ in at most three bits agree in one of four 16-bit blocks.
So there are four orders of all distinct fingerprints, each with another block in
front, and each order is cut where its front block changes.  Rows of one cut are
sorted by Gray rank, which puts fingerprints with many equal bits side by side.
Over such a run a tree is built: a node holds the bits that all its fingerprints
share and that no node above it holds already, as a mask and a pattern.  A search
adds up the bits by which the query differs from the patterns on its way down and
leaves out a node, with all below it, as soon as the sum is above the limit.

A cut with too many fingerprints is cut again by a quarter of its other bits, four
times more at most; after that it has under 2**20 fingerprints by construction.
Of each run only a forest of its links leaves the task, never its pairs.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.session import materialize

from .common import hook, in_slices, shuffle_partitions, word_lists

FAN = 8
QUERIES = 256
#: Near copies: words of a shingle; keys of a set of shingles, and the least hashes that make one.
WIDTH, BANDS, BAND = 5, 32, 4
#: Parts of a set's shingles whose sizes bound what two sets have in common.
PARTS = 64


def _again(h: np.ndarray, turn: int) -> np.ndarray:
    """Another hash of what ``h`` are the hashes of; ``h`` itself at turn 0."""
    if not turn:
        return h
    z = (h + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


def text_fingerprint(texts: list[bytes | None], width: int = 3, prints: int = 1) -> np.ndarray:
    """Unsigned 64-bit SimHashes of each text, one column for each of ``prints`` hashes; zero for a text without words."""
    from xxhash import xxh64_intdigest

    digest = functools.partial(xxh64_intdigest, seed=42)
    out = np.zeros((len(texts), prints), dtype=np.uint64)
    hashes: list[np.ndarray] = []
    owner: list[int] = []
    held = 0

    def settle() -> None:
        nonlocal held
        if not owner:
            return
        sizes = np.array([len(h) for h in hashes])
        flat, starts = np.concatenate(hashes), np.cumsum(sizes) - sizes
        rows, first = np.unique(np.array(owner), return_index=True)
        sizes = np.add.reduceat(sizes, first)
        for turn in range(prints):
            bits = np.unpackbits(_again(flat, turn).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_ = np.add.reduceat(np.add.reduceat(bits, starts, axis=0, dtype=np.int64), first, axis=0)
            out[rows, turn] = np.packbits(2 * set_ > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        hashes.clear()
        owner.clear()
        held = 0

    for k, text in enumerate(texts):
        for n, words in enumerate(word_lists(text, width - 1)):
            if len(words) >= width:
                runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
                found = np.fromiter(map(digest, runs), dtype=np.uint64, count=len(words) - width + 1)
            elif words and not n:
                found = np.array([digest(b" ".join(words))], dtype=np.uint64)
            else:
                continue
            hashes.append(found)
            owner.append(k)
            held += len(found)
        if held > 100_000:
            settle()
    settle()
    return out


def fingerprints(docs: DataFrame, width: int = 3, prints: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp``, ``fp1``, ...: SimHashes of ``width``-word shingles as signed longs.

    A text that is null or blank has fingerprint zero; one with fewer words is a single shingle.
    """

    names = ["fp", *(f"fp{k}" for k in range(1, prints))]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in in_slices(batch, 2000):
                found = text_fingerprint(part.column(len(keep)).to_pylist(), width, prints).view(np.int64)
                columns = [pa.array(np.ascontiguousarray(found[:, k])) for k in range(prints)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *columns], names=[*keep, *names])

    slim = docs.select(*keep, F.col("text").cast("binary").alias("text"))
    schema = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in keep) + "".join(f", {c} long" for c in names)
    return slim.mapInArrow(run, schema)


def gray_rank(bits: Column) -> Column:
    """Position of a bit string in Gray order, shifted so that signed order is unsigned order."""
    for step in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, step))
    return bits.bitwiseXOR(F.lit(-(2**63)))


def _turns(fixed: int) -> list[tuple[int, int]]:
    """Quarters of the bits behind the first ``fixed`` ones: (offset, length)."""
    rest = 64 - fixed
    edges = [round(rest * i / 4) for i in range(5)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(4)]


def _cuts(rows: DataFrame, fixed: int) -> DataFrame:
    """Four rows for each row: one quarter of its free bits comes to the front, the first ``fixed`` bits stay."""
    rest = 64 - fixed
    low = F.lit((1 << rest) - 1 if rest < 64 else -1)
    u, ways = F.col("u"), []
    for k, (offset, length) in enumerate(_turns(fixed)):
        free = u.bitwiseAND(low)
        turned = F.shiftleft(free, offset).bitwiseOR(F.shiftrightunsigned(free, rest - offset)).bitwiseAND(low) if offset else free
        bits = turned.bitwiseOR(u.bitwiseAND(F.lit(~((1 << rest) - 1)))) if rest < 64 else turned
        ways.append(F.struct((F.col("way") * 4 + k).alias("way"), F.lit(fixed + length).alias("fixed"), bits.alias("u")))
    wide = rows.select("fp", F.explode(F.array(*ways)).alias("w")).select("fp", "w.way", "w.fixed", "w.u")
    return wide.withColumn("front", F.expr("shiftrightunsigned(u, 64 - fixed)"))


class GrayTree:
    """Tree over bit strings in Gray order; ``cut`` numbers the runs that may not be mixed."""

    def __init__(self, u: np.ndarray, cut: np.ndarray):
        self.u, self.cut = u, cut
        ones, zeros, first, last = [u], [u], [cut], [cut]
        while len(ones[-1]) > FAN:
            at = np.arange(0, len(ones[-1]), FAN)
            ones.append(np.bitwise_and.reduceat(ones[-1], at))
            zeros.append(np.bitwise_or.reduceat(zeros[-1], at))
            first.append(first[-1][at])
            last.append(np.maximum.reduceat(last[-1], at))
        self.first, self.last = first, last
        shared = [~(a ^ b) for a, b in zip(ones, zeros, strict=True)]
        above = [np.repeat(shared[k + 1], FAN)[: len(shared[k])] if k + 1 < len(shared) else np.zeros_like(shared[k]) for k in range(len(shared))]
        self.mask = [s & ~a for s, a in zip(shared, above, strict=True)]
        self.pattern = [o & m for o, m in zip(ones, self.mask, strict=True)]

    def links(self, begin: int, end: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) with begin <= i < end, i < j, the same cut and at most ``limit`` different bits."""
        top = len(self.mask) - 1
        query = np.repeat(np.arange(begin, end), len(self.mask[top]))
        node = np.tile(np.arange(len(self.mask[top])), end - begin)
        sum_ = np.zeros(len(query), dtype=np.uint8)
        for level in range(top, -1, -1):
            own = self.cut[query]
            may = (self.first[level][node] <= own) & (own <= self.last[level][node]) & ((node + 1) * FAN**level - 1 > query)
            query, node, sum_ = query[may], node[may], sum_[may]
            sum_ = sum_ + np.bitwise_count((self.u[query] ^ self.pattern[level][node]) & self.mask[level][node])
            near = sum_ <= limit
            query, node, sum_ = query[near], node[near], sum_[near]
            if level:
                wide = np.minimum(FAN, len(self.mask[level - 1]) - node * FAN)
                query, sum_ = np.repeat(query, wide), np.repeat(sum_, wide)
                step = np.arange(len(query)) - np.repeat(np.cumsum(wide) - wide, wide)
                node = np.repeat(node * FAN, wide) + step
        return query, node


def forest(u: np.ndarray, cut: np.ndarray, limit: int) -> np.ndarray:
    """For each position the first position of its linked set."""
    parent = np.arange(len(u))
    tree = GrayTree(u, cut)
    for at in range(0, len(u), QUERIES):
        hook(parent, *tree.links(at, min(at + QUERIES, len(u)), limit))
    return parent


def _search(rows: DataFrame, limit: int, size: int) -> DataFrame:
    """Forest of the links inside each cut of ``rows`` (way, fixed, front, u, fp)."""

    def run(batches):
        import pyarrow as pa

        held: list[tuple[np.ndarray, ...]] = []

        def links(u, cut, fp):
            parent = forest(u.view(np.uint64), cut, limit)
            own = parent != np.arange(len(parent))
            return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[parent[own]])], names=["a", "b"])

        def joined():
            way, front, u, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            return np.concatenate([[0], np.cumsum((way[1:] != way[:-1]) | (front[1:] != front[:-1]))]), u, fp

        rows_held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(i).to_numpy() for i in range(4)))
            rows_held += batch.num_rows
            if rows_held >= size:
                cut, u, fp = joined()
                done = int(np.searchsorted(cut, cut[-1]))  # the last cut may go on in the next batch
                if done:
                    yield links(u[:done], cut[:done], fp[:done])
                    way, front = (np.concatenate([x[i] for x in held])[done:] for i in (0, 1))
                    held, rows_held = [(way, front, u[done:], fp[done:])], len(u) - done
        if held:
            cut, u, fp = joined()
            yield links(u, cut, fp)

    dealt = rows.repartition(shuffle_partitions(rows), "way", "front").sortWithinPartitions("way", gray_rank(F.col("u")))
    return dealt.select("way", "front", "u", "fp").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, limit: int = 3, most: int = 16384) -> DataFrame:
    """Forest edges (a, b) between the nodes ``fp`` of distinct bit strings ``u`` with at most ``limit`` <= 3 different bits.

    Cuts of more than ``most`` rows are cut again; every link is found in some cut.
    """
    if not 0 <= limit <= 3:
        raise ValueError("four blocks find at most three different bits")
    rows, fixed, found = distinct.select("fp", F.lit(0).alias("way"), F.lit(0).alias("fixed"), "u"), 0, []
    for depth in range(5):
        rows = _cuts(rows, fixed) if depth == 0 else functools.reduce(DataFrame.unionByName, [_cuts(rows.filter(F.col("fixed") == f), f) for f in fixed])
        fixed = sorted({f + n for f in ([0] if depth == 0 else fixed) for _, n in _turns(f)})
        large = materialize(rows.groupBy("way", "front").count().filter(F.col("count") > most).select("way", "front"))
        if depth == 4 or large.isEmpty():
            found.append(_search(rows, limit, most))
            break
        found.append(_search(rows.join(large, ["way", "front"], "left_anti"), limit, most))
        rows = materialize(rows.join(large, ["way", "front"], "left_semi"))
    return functools.reduce(DataFrame.unionByName, found)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): large-star and small-star steps until nothing changes."""

    def state(df):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = state(edges)
    while before[0]:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, limit: int = 3, prints: int = 1, most: int = 16384) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id.

    ``component_id`` is the smallest doc_id that links reach, the document itself
    included.  Equal texts share one fingerprint, which is searched once.  With several
    ``prints`` documents link if any of their fingerprints do.  Blank and null texts have
    fingerprint zero and link like any other.  Rows with a null doc_id link others but
    never name a component (null if alone).  Repeated rows come back as often.  An empty
    table gives no rows.
    """
    found = materialize(fingerprints(docs, width, prints))
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = links(distinct.withColumn("u", F.col("fp")), limit, most)
    for k in range(1, prints):
        # The first fingerprint names a text; texts that share another one link to the least of them.
        same = materialize(found.select("fp", F.col(f"fp{k}").alias("u")).distinct())
        least = materialize(same.groupBy("u").agg(F.min("fp").alias("least")))
        joined = same.join(least, "u").filter("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
        edges = edges.unionByName(joined).unionByName(links(least.select(F.col("least").alias("fp"), "u"), limit, most))
    roots = components(edges)
    member = roots.join(distinct, roots["node"] == distinct["fp"]).select("root", "fp", "first")
    named = member.join(member.groupBy("root").agg(F.min("first").alias("component")), "root").select("fp", "component")
    classes = distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted different hashes of the ``width``-word shingles; a text with fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    digest = functools.partial(xxh64_intdigest, seed=42)
    found = [np.zeros(0, dtype=np.uint64)]
    for n, words in enumerate(word_lists(text, width - 1)):
        if len(words) >= width:
            runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            found.append(np.fromiter(map(digest, runs), dtype=np.uint64, count=len(words) - width + 1))
        elif words and not n:
            found.append(np.array([digest(b" ".join(words))], dtype=np.uint64))
    return np.unique(np.concatenate(found))


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set its name (equal for equal sets, zero if empty), its SimHash, and a key for each band of least hashes.

    Sets of similarity s share a band's key with probability s**4; of the pairs at 0.8
    less than one in ten million shares none of the 32.
    """
    from xxhash import xxh64_intdigest

    node = np.array([xxh64_intdigest(x.tobytes()) if len(x) else 0 for x in sets], dtype=np.uint64)
    prints, keys = np.zeros(len(sets), dtype=np.uint64), np.zeros((len(sets), BANDS), dtype=np.uint64)
    turn, factor = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * BAND), dtype=np.uint64)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    full = np.flatnonzero(sizes)
    at = 0
    while at < len(full):
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[full[at:]]), 100_000, side="right")))
        own = full[at:upto]
        flat, starts = np.concatenate([sets[i] for i in own]), np.cumsum(sizes[own]) - sizes[own]
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        prints[own] = np.packbits(2 * set_ > sizes[own][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        for k in range(BANDS):
            key = np.full(len(own), k + 1, dtype=np.uint64)
            for j in range(k * BAND, (k + 1) * BAND):
                key = (key ^ np.minimum.reduceat((flat ^ turn[j]) * (factor[j] | np.uint64(1)), starts)) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(29)
            keys[own, k] = key
        at = upto
    return node, prints, keys


def sketched(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, h (hash of the text), node (name of its set of shingles), n (their number), fp and keys of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in in_slices(batch, 500):
                sets = [shingle_set(t, width) for t in part.column(2).to_pylist()]
                node, prints, keys = sketches(sets)
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(node.view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), pa.array(prints.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))],
                    names=["doc_id", "h", "node", "n", "fp", "keys"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, h long, node long, n long, fp long, keys array<long>")


def shingles_of(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, shingles) for the rows of ``wanted`` (h, node); a task makes the set of equal texts once."""

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            for part in in_slices(batch, 500):
                nodes, sets = [], []
                for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        sets.append(shingle_set(text, width).view(np.int64))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32))
                flat = np.concatenate([np.zeros(0, dtype=np.int64), *sets])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["node", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text")).join(wanted, "h")
    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of different nodes whose sets have a Jaccard similarity of 0.8 at least."""
    once = pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    common = F.size(F.array_intersect("x", "y"))
    return once.join(one, "a").join(two, "b").filter(9 * common >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def profiles(sets: DataFrame, parts: int = PARTS) -> DataFrame:
    """(node, shared, counts) of every set: its shingles that another set holds too, and their number in each of ``parts`` parts.

    Two sets have no more common shingles than the sum over the parts of the lesser
    number: a bound that edits in different places keep close to the truth.
    """
    rows = sets.select("node", F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1").select("s")
    part = F.pmod(F.xxhash64("s"), F.lit(parts)).cast("int")
    sums = rows.join(often, "s").groupBy("node", part.alias("part")).agg(F.count("*").alias("c"))
    by_part = sums.groupBy("node").agg(F.sum("c").alias("shared"), F.map_from_entries(F.collect_list(F.struct("part", "c"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("smallint"))
    return by_part.select("node", "shared", counts.alias("counts"))


def similar(docs: DataFrame, found: DataFrame, width: int = WIDTH, limit: int = 3, most: int = 16384) -> DataFrame:
    """(node, first, root) of every set of shingles in ``found``: its least row (doc_id, null last, and hash of the text) and the name of its component.

    Nodes link if their exact similarity is 0.8 at least.  Candidates are close
    fingerprints and nodes that share a band's key.  Pairs that are linked already need
    no check: first the fingerprints' forest is checked, then each node of a bucket with
    one other, and last the pairs of a bucket that are still in different components, as
    far as the bounds of their ``profiles`` let them be similar enough.
    """
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("first")
    nodes = materialize(found.groupBy("node").agg(least_row, *[F.first(c).alias(c) for c in ("h", "n", "fp", "keys")]))
    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    buckets = materialize(rows.join(shared, "key").select("key", "node", "n"))
    least = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    equal = nodes.join(least, "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    near = materialize(equal.unionByName(links(least.select(F.col("least").alias("fp"), F.col("fp").alias("u")), limit, most)))
    named = buckets.select("node").unionByName(near.select(F.col("a").alias("node"))).unionByName(near.select(F.col("b").alias("node"))).distinct()
    sets = materialize(shingles_of(docs, nodes.join(named, "node", "left_semi").select("h", "node"), width))
    fits = lambda n, m: 5 * F.least(n, m) >= 4 * F.greatest(n, m)

    def mixed(roots):
        """Rows of the buckets that hold more than one component, with theirs."""
        own = buckets.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
        several = own.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("key")
        return materialize(own.join(several, "key", "left_semi"))

    roots = components(alike(near, sets))
    own = mixed(roots)
    centre = own.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node", "n", "root")).alias("c"))
    spokes = own.join(centre, "key").filter((F.col("root") != F.col("c.root")) & fits(F.col("n"), F.col("c.n"))).select(F.col("node").alias("a"), F.col("c.node").alias("b"))
    tree = lambda: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(tree().unionByName(alike(spokes, sets)))
    own = mixed(roots)
    known = materialize(profiles(sets.join(own.select("node").distinct(), "node", "left_semi")))
    # A set with too few shared shingles for any partner has no pair.
    own = materialize(own.join(known, "node").filter(5 * F.col("shared") >= 4 * F.col("n")))
    main = own.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    others = own.join(main, "key").filter("root <> main").select(*[F.col(c).alias(f"_{c}") for c in own.columns])
    enough = lambda common: 9 * common >= 4 * (F.col("n") + F.col("_n"))
    bound = F.aggregate(F.zip_with("counts", "_counts", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda x, y: x + y)
    met = (F.col("key") == F.col("_key")) & (F.col("root") != F.col("_root")) & enough(F.least("shared", "_shared")) & enough(bound)
    pairs = others.join(own, met).select(F.col("_node").alias("a"), F.col("node").alias("b"))
    roots = components(tree().unionByName(alike(pairs, sets)))
    return nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of ``docs`` for each component of ``similar``: that of its smallest doc_id.

    Rows without doc_id come last in their component.  Rows of one component with the
    same doc_id (or none) are told apart by their texts, and those with one text by a
    checksum of the row, so unlike texts with one doc_id both stay and equal rows leave
    one.  Null and blank texts are one component.  An empty table gives no rows.
    """
    found = materialize(sketched(docs, width))
    once = materialize(similar(docs, found, width).groupBy("root").agg(F.min("first").alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.h").alias("_h")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_text"))
    kept = rows.join(once, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_h")), "left_semi")
    if found.select("doc_id", "h").distinct().count() < found.count():
        kept = kept.groupBy("_own", "_text").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return kept.select("_row.*")
