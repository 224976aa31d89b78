"""Quality by compression: the dictionary that makes a text smaller tells what it resembles.

Two zstandard dictionaries are trained, one on pieces of texts labelled good and one on
pieces of texts labelled bad.  A text is compressed with each, piece by piece, so that
what a piece owes to the dictionary isn't hidden by what it owes to the text before it.
The difference of the two sizes, by the length of the text, and the logarithm of how far
the text shrinks are the inputs of a calibration fitted on other labelled texts.

The fit reads bounded samples of labelled rows (``LABELLED``, ``PIECES``); every text is
scored as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.session import materialize

from .common import in_slices
from .hmm import held_out

#: Labelled rows of each class that the fit may read, chosen by a hash of their id.
LABELLED = 8192
#: Pieces of each class, chosen by a hash of their content, that a dictionary is trained on.
PIECES = 8192
#: Bytes of a piece, of a dictionary, and of the text that the difference is shrunk by.
PIECE, DICTIONARY, SHRINK = 1024, 112640, 100
LEVEL = 3
#: Pull of the calibration's weights to zero.
RIDGE = 1e-3
#: Trained with fixed segment length and match length: no search for the best ones.
_SEGMENT, _MATCH = 200, 8


def in_pieces(text: bytes | None) -> Iterator[bytes]:
    """The whole text in consecutive pieces; an empty or null text is one empty piece."""
    if not text:
        yield b""
        return
    for at in range(0, len(text), PIECE):
        yield text[at : at + PIECE]


def build(pieces: list[bytes]) -> bytes:
    """A dictionary of the pieces: trained, or the pieces themselves where there are too few to train on."""
    import zstandard

    full = [p for p in pieces if p]
    try:
        return zstandard.train_dictionary(DICTIONARY, full, k=_SEGMENT, d=_MATCH).as_bytes()
    except zstandard.ZstdError:
        return b"".join(full)[:DICTIONARY]


def compressor(dictionary: bytes):
    """Function from a piece to its compressed size, without what is the same for every piece."""
    import zstandard

    settings = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if dictionary:
        held = zstandard.ZstdCompressionDict(dictionary)
        held.precompute_compress(level=LEVEL)
        settings["dict_data"] = held
    squeeze = zstandard.ZstdCompressor(**settings).compress
    return lambda piece: len(squeeze(piece))


def inputs(good: np.ndarray, bad: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Calibration inputs from both compressed sizes and the length of each text."""
    good, bad, size = (x.astype(float) for x in (good, bad, size))
    return np.column_stack([np.ones(len(size)), (bad - good) / (size + SHRINK), np.log((good + bad) / (size + 1))])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def calibrate(rows: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression of ``good`` on ``rows`` (first column ones), by Newton steps that never get worse.

    Targets are those of one more row of either class, so that no weight grows without
    end; without rows all weights are zero.
    """
    w = np.zeros(rows.shape[1])
    if not len(rows):
        return w
    n1 = int(good.sum())
    n0 = len(good) - n1
    target = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    centre, scale = rows.mean(axis=0), rows.std(axis=0)
    centre[0], scale[0] = 0.0, 1.0
    scale[scale == 0] = 1.0
    x = (rows - centre) / scale
    pull = np.full(len(w), RIDGE * len(rows))
    pull[0] = 0.0

    def loss(w):
        p = np.clip(_logistic(x @ w), 1e-15, 1 - 1e-15)
        return -np.sum(target * np.log(p) + (1 - target) * np.log(1 - p)) + 0.5 * np.sum(pull * w * w)

    now = loss(w)
    for _ in range(100):
        p = _logistic(x @ w)
        slope = x.T @ (p - target) + pull * w
        bend = x.T @ (x * (p * (1 - p))[:, None]) + np.diag(pull + 1e-9)
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        new = loss(w - size * step)
        if not now - new > 1e-10 * max(1.0, now):
            break
        w, now = w - size * step, new
    w = w / scale
    w[0] -= np.sum(w[1:] * centre[1:])
    return w


def sizes(docs: DataFrame, good: bytes, bad: bytes, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, good_bytes, bad_bytes and n_bytes (compressed with each dictionary, and not) of every whole text."""

    def run(batches):
        import pyarrow as pa

        by = [compressor(good), compressor(bad)]
        for batch in batches:
            for part in in_slices(batch, 2000):
                found = np.zeros((part.num_rows, 3), dtype=np.int64)
                for k, text in enumerate(part.column(len(keep)).to_pylist()):
                    for piece in in_pieces(text):
                        found[k] += (by[0](piece), by[1](piece), len(piece))
                columns = [pa.array(np.ascontiguousarray(found[:, i])) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *columns], names=[*keep, "good_bytes", "bad_bytes", "n_bytes"])

    slim = docs.select(*keep, F.col("text").cast("binary").alias("text"))
    schema = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in keep) + ", good_bytes long, bad_bytes long, n_bytes long"
    return slim.mapInArrow(run, schema)


def _first(rows: DataFrame, order: list, bound: int) -> DataFrame:
    """At most ``bound`` rows of either class: those first in the order."""
    one, two = (rows.filter(F.col("quality") == q).orderBy(*order).limit(bound) for q in (0, 1))
    return one.unionByName(two)


def dictionaries(rows: DataFrame, bound: int = PIECES) -> tuple[bytes, bytes]:
    """The good and the bad dictionary of ``rows`` (text as binary, quality); a class without rows has an empty one."""

    def cut(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            for part in in_slices(batch, 200):
                texts, marks = part.column(0).to_pylist(), part.column(1).to_pylist()
                found = [(q, p) for t, q in zip(texts, marks, strict=True) for p in in_pieces(t)]
                hashes = np.array([xxh64_intdigest(p, seed=42) for _, p in found], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int32()), pa.array(hashes.view(np.int64)), pa.array([p for _, p in found], pa.binary())], names=["quality", "h", "piece"])

    def train(batches):
        import pyarrow as pa

        held = sorted((q, h, p) for batch in batches for q, h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        by_class = [build([p for q, _, p in held if q == k]) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(by_class, pa.binary())], names=["quality", "dictionary"])

    pieces = rows.select("text", "quality").mapInArrow(cut, "quality int, h long, piece binary")
    chosen = materialize(_first(pieces, ["h", "piece"], bound))
    found = {r["quality"]: bytes(r["dictionary"]) for r in chosen.repartition(1).mapInArrow(train, "quality int, dictionary binary").collect()}
    return found.get(1, b""), found.get(0, b"")


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> tuple[bytes, bytes, list[float]]:
    """Dictionaries and calibration weights, from at most ``bound`` labelled rows of each class that aren't held out.

    One half of them, by a hash of the id, makes the dictionaries and the other half the calibration.
    A doc_id with both labels counts as good; labels other than 0 and 1, and null ids, are left out.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), 3, 1))
    usable = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = materialize(_first(usable, [F.xxhash64("doc_id"), "doc_id"], bound))
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(chosen, "doc_id")
    rows = materialize(_first(found, [F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")], bound))
    half = F.pmod(F.shiftrightunsigned(F.xxhash64("doc_id"), 7), F.lit(2))
    good, bad = dictionaries(rows.filter(half == 0))
    measured = sizes(rows.filter(half == 1), good, bad, ("quality",)).collect()  # two bounds of small rows at most
    columns = np.array([(r["good_bytes"], r["bad_bytes"], r["n_bytes"], r["quality"]) for r in measured], dtype=np.int64).reshape(-1, 4)
    columns = columns[np.lexsort(columns.T)]
    return good, bad, calibrate(inputs(*columns[:, :3].T), columns[:, 3]).tolist()


def score(docs: DataFrame, good: bytes, bad: bytes, weights: list[float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the sizes and ``score``, the calibrated probability of a good text, of every row."""
    difference = (F.col("bad_bytes") - F.col("good_bytes")) / (F.col("n_bytes") + SHRINK)
    shrunk = F.log((F.col("good_bytes") + F.col("bad_bytes")) / (F.col("n_bytes") + 1))
    at = F.lit(weights[0]) + F.lit(weights[1]) * difference + F.lit(weights[2]) * shrunk
    return sizes(docs, good, bad, keep).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), at)))))


def qualities(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, good_bytes, bad_bytes, n_bytes of every row of ``docs``.

    Null and empty texts are one empty piece and get its score.  Rows with a null doc_id
    are scored like any other and aren't held out.  Repeated rows come back as often.
    Without labels every score is one half; with labels of one class only, all are near
    that class.  An empty table gives no rows.
    """
    scored = score(docs, *fit(docs, labels, bound))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "good_bytes", "bad_bytes", "n_bytes",
    )
