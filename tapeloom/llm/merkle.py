"""Merkle manifest of a dataset: a tree per language, and a tree over the languages' roots.

Nodes of a level are rows (g, i, n, digest): the tree, the place, the number of nodes of
the tree at this level, and the digest.  Every level is one equi join of the nodes with
themselves: a node computes the places of its run from the slots' offsets and meets the
nodes at these places.  So each row knows its siblings, which are its part of the proof,
and the row at slot zero emits the parent.  Proofs are put together from the root down,
where one row of a level serves all nodes below it.

Everything is DataFrame functions; trees of all languages grow in the same joins, and a
language that holds most rows is split over its places.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.session import attach, materialize

from .common import ranked

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """Digest (hexadecimal) of the fields: each its length in bytes, a colon and its value, or a dash for null."""
    shown = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*shown), 256)


def _hex(digests: Column) -> Column:
    """Digests as one hexadecimal text."""
    return F.concat_ws("", F.transform(digests, lambda x: F.lower(F.hex(x))))


def _grow(nodes: DataFrame, most: int, fan: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels (g, i, run: the digests of the node's run in order) and, for each level, the trees that end there (g, digest).

    ``nodes`` is a stored table and ``most`` the largest number of nodes of a tree.
    """
    levels, ends = [], []
    while True:
        ends.append(nodes.filter("n = 1").select("g", "digest"))
        if most <= 1:
            return levels, ends
        inner = nodes.filter("n > 1")
        start = F.col("i") - F.col("i") % fan
        wanted = inner.select("g", "i", "n", F.explode(F.sequence(start, F.least(start + fan, F.col("n")) - 1)).alias("sibling"))
        met = wanted.join(inner.select("g", F.col("i").alias("sibling"), "digest"), ["g", "sibling"])
        runs = met.groupBy("g", "i").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("sibling", "digest"))).alias("run"))
        level = materialize(runs.select("g", "i", "n", F.transform("run", lambda x: x["digest"]).alias("run")))
        levels.append(level)
        above = level.filter(F.col("i") % fan == 0)
        nodes = materialize(above.select(
            "g", (F.col("i") / fan).cast("long").alias("i"), F.ceil(F.col("n") / fan).alias("n"), F.unhex(F.sha2(_hex(F.col("run")), 256)).alias("digest"),
        ))
        most = -(-most // fan)


def _step(fan: int) -> Column:
    """What stands before and after a node in its run."""
    slot = (F.col("i") % fan).cast("int")
    return F.struct(_hex(F.slice("run", F.lit(1), slot)).alias("before"), _hex(F.slice("run", slot + 2, F.lit(fan))).alias("after"))


def _parents(levels: list[DataFrame], ends: list[DataFrame], roots: DataFrame, fan: int) -> DataFrame:
    """(g, i, steps, subroot) of the nodes one level above the leaves: the way from there to the root.

    ``roots`` (g, steps, subroot) has what lies above the root of each tree.
    """
    found = None
    for k in range(len(levels), 0, -1):
        tops = ends[k].join(roots, "g").select("g", F.lit(0).cast("long").alias("i"), "steps", "subroot")
        if found is not None:
            found = _above(levels[k], found, fan).select("g", "i", F.concat(F.array(_step(fan)), "steps").alias("steps"), "subroot")
        found = materialize(tops if found is None else found.unionByName(tops))
    return found


def _above(nodes: DataFrame, parents: DataFrame, fan: int) -> DataFrame:
    """Nodes with the steps and the subroot of their parents."""
    way = parents.select("g", F.col("i").alias("_parent"), "steps", "subroot")
    return nodes.withColumn("_parent", (F.col("i") / fan).cast("long")).join(way, ["g", "_parent"]).drop("_parent")


def _tampered(docs: DataFrame) -> Column:
    """Digest of the row with A-Z of its text in lower case where 3 divides the checksum of its id, else null."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    fields = [lower if f == "text" else F.col(f) for f in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_digest(fields))


def manifest(docs: DataFrame, fan: int = FAN, tampered=_tampered) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A null field is a dash in the leaf.  Rows without lang have a tree of their own, the
    first.  Inside a tree a null doc_id comes first and rows with one doc_id ascend by leaf;
    equal rows are leaves of their own.  Empty and long texts are hashed whole.  A row
    whose doc_id is null isn't tampered with.  ``tampered`` gives the leaf digest that a
    verifier finds instead of the true one, or null.  Other columns aren't read.  An empty
    table has no root and gives no rows.
    """
    if fan < 2:
        raise ValueError("a run has two nodes at least")
    found = docs.select(
        "doc_id", "lang", F.unhex(leaf_digest([F.col(f) for f in FIELDS])).alias("digest"), F.unhex(tampered(docs)).alias("other"),
        F.monotonically_increasing_id().alias("tie"),
    )
    rows = ranked(materialize(found), ["lang", "doc_id", "digest", "tie"])
    named = rows.withColumn("name", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")))
    trees = materialize(named.groupBy("name").agg(F.min("_rank").alias("g"), F.count("*").alias("n")))
    most = trees.agg(F.max("n"), F.count("*")).first()
    if not most[1]:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    placed = attach(named, trees, ["name"], F.col("_rank")).select("g", (F.col("_rank") - F.col("g")).alias("i"), "n", "digest", "doc_id", "other")
    leaves = materialize(placed)
    levels, ends = _grow(leaves.select("g", "i", "n", "digest"), most[0], fan)

    # The trees' roots are the leaves of one more tree; g has the order of the languages.
    subroots = ends[0]
    for other in ends[1:]:
        subroots = subroots.unionByName(other)
    top = materialize(ranked(subroots, ["g"]).select(F.lit(0).cast("long").alias("g"), F.col("_rank").alias("i"), F.lit(most[1]).alias("n"), "digest", F.col("g").alias("tree")))
    top_levels, top_ends = _grow(top.select("g", "i", "n", "digest"), most[1], fan)
    root = top_ends[-1].first()["digest"].hex()
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    if top_levels:
        base = docs.sparkSession.range(1).select(F.col("id").alias("g"), nothing.alias("steps"), F.lit(root).alias("subroot"))
        way = _above(top_levels[0].join(top.select("i", "tree", "digest"), "i"), _parents(top_levels, top_ends, base, fan), fan)
        roots = materialize(way.select(F.col("tree").alias("g"), F.concat(F.array(_step(fan)), "steps").alias("steps"), F.lower(F.hex("digest")).alias("subroot")))
    else:
        roots = materialize(top.select(F.col("tree").alias("g"), nothing.alias("steps"), F.lower(F.hex("digest")).alias("subroot")))

    alone = leaves.filter("n = 1").join(roots, "g").select("doc_id", "digest", "other", "steps", "subroot")
    proved = alone
    if levels:
        own = leaves.filter("n > 1").select("g", "i", "digest", "other", "doc_id").join(levels[0].select("g", "i", "run"), ["g", "i"])
        inner = _above(own, _parents(levels, ends, roots, fan), fan)
        proved = alone.unionByName(inner.select("doc_id", "digest", "other", F.concat(F.array(_step(fan)), "steps").alias("steps"), "subroot"))
    leaf = F.lower(F.hex("digest"))
    proof = F.sha2(F.concat_ws("", F.transform("steps", lambda s: F.concat(s["before"], s["after"]))), 256)
    folded = F.aggregate("steps", F.lower(F.hex(F.coalesce("other", "digest"))), lambda held, s: F.sha2(F.concat(s["before"], held, s["after"]), 256))
    out = proved.select("doc_id", leaf.alias("leaf"), "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
