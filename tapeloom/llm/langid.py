"""Language of a text by sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased; every run of one to three characters, where anything but
letters counts as a blank, is hashed to a fixed number of columns.  Document
frequencies are counted over all training texts.  The weights are learned by
follow-the-regularised-leader with an absolute and a squared penalty, on a bounded
number of training texts per language, and the probabilities are then calibrated by
one temperature on texts set aside from them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import materialize

from .common import in_slices
from .hmm import held_out

WIDTH = 1 << 16
#: The fit reads at most so many training texts of each language, chosen by a hash of their id.
PER_LANGUAGE = 1500
EPOCHS = 2
ALPHA, BETA, ABSOLUTE, SQUARED = 0.5, 1.0, 1e-2, 1e-4
TEMPERATURES = np.exp(np.linspace(np.log(0.05), np.log(5.0), 60))
#: Characters of a long text are taken in pieces of this size that overlap by two.
PIECE = 1 << 20
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)


@dataclass
class Model:
    languages: list[str]
    rarity: np.ndarray
    weights: np.ndarray
    temperature: float


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed run of one to three characters occurs in a whole text."""
    total = np.zeros(WIDTH, dtype=np.int64)
    for at in range(0, len(text), PIECE):
        piece = text[max(at - 2, 0) : at + PIECE].lower()
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(codes < 128, _ASCII[np.minimum(codes, 127)], codes).astype(np.uint64)
        lead = min(at, 2)
        runs = codes
        for n in range(1, 4):
            hashed = ((runs + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
            total += np.bincount(hashed[max(lead - n + 1, 0) :].astype(np.int64), minlength=WIDTH)
            runs = runs[:-1] * np.uint64(0x100000001B3) + codes[n:]
    return total


def vector(text: str, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and normed TF-IDF values of a text."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * rarity[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], languages: list[str], rarity: np.ndarray) -> Model:
    """Weights by follow-the-regularised-leader over four fifths of the texts, the temperature on the rest."""
    names = sorted(set(languages))
    number = {n: i for i, n in enumerate(names)}
    vectors = [vector(t, rarity) for t in texts]
    own = np.array([number[n] for n in languages])
    z, squares = np.zeros((WIDTH, len(names))), np.zeros((WIDTH, len(names)))

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - ABSOLUTE, 0)
        return -shrunk / ((BETA + np.sqrt(squares[at])) / ALPHA + SQUARED)

    aside = np.arange(len(texts)) % 5 == 4
    for _ in range(EPOCHS):
        for k in np.flatnonzero(~aside):
            at, x = vectors[k]
            w = weights(at)
            gap = softmax(x @ w)
            gap[own[k]] -= 1
            gradient = x[:, None] * gap[None, :]
            grown = squares[at] + gradient**2
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(squares[at])) / ALPHA * w
            squares[at] = grown
    final = weights(slice(None))
    scores, truth = np.array([x @ final[at] for at, x in (vectors[k] for k in np.flatnonzero(aside))]).reshape(-1, len(names)), own[aside]
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).sum() for t in TEMPERATURES]
    return Model(names, rarity, final, float(TEMPERATURES[int(np.argmin(loss))]) if len(truth) else 1.0)


def rarities(texts: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of every column over all rows of ``text``."""

    def run(batches):
        import pyarrow as pa

        seen, rows = np.zeros(WIDTH, dtype=np.int64), 0
        for batch in batches:
            for part in in_slices(batch, 2000):
                for text in part.column(0).to_pylist():
                    rows += 1
                    seen += gram_counts(text or "") > 0
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], names=["at", "seen"])

    found = texts.select("text").mapInArrow(run, "at long, seen long").groupBy("at").agg(F.sum("seen").alias("seen")).toPandas()
    rows = int(found.loc[found["at"] == -1, "seen"].sum())
    own = found[found["at"] >= 0]
    seen = np.zeros(WIDTH)
    seen[own["at"].to_numpy(dtype=np.int64)] = own["seen"].to_numpy()
    return np.log((1 + rows) / (1 + seen)) + 0.1


def train(docs: DataFrame, parts: int = 4, part: int = 2, most: int = PER_LANGUAGE) -> Model | None:
    """Model of (doc_id, text, lang) rows that are not held out; null if no row has both a text and a language."""
    usable = docs.filter(~held_out(F.col("doc_id"), parts, part) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # Counts by the first bits of the hash say how far each language has to be read, so only these rows are put in order.
    start = F.shiftright(F.xxhash64("doc_id"), 48).alias("_p")
    counts = usable.select("lang", start).groupBy("lang", "_p").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("lang").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    near = materialize(counts.withColumn("_b", F.coalesce(before, F.lit(0))).filter(F.col("_b") < most).select("lang", "_p"))
    ids = usable.select("doc_id", "lang", start).join(near, ["lang", "_p"], "left_semi")
    chosen = materialize(ids.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).select("doc_id").distinct())
    rarity = rarities(usable)

    def run(batches):
        import pyarrow as pa

        texts, languages = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            languages += batch.column(1).to_pylist()
        if texts:
            model = fit(texts, languages, rarity)
            weights = model.weights.astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([model.languages]), pa.array([weights], pa.binary()), pa.array([model.temperature])], names=["languages", "weights", "temperature"])

    # The id may stand in repeated rows: the order and the bound hold for rows.
    rows = usable.join(chosen, "doc_id", "left_semi").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most)
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text", "lang")).select("text", "lang")
    found = rows.mapInArrow(run, "languages array<string>, weights binary, temperature double").first()
    if found is None:
        return None
    weights = np.frombuffer(bytes(found["weights"]), dtype=np.float32).reshape(WIDTH, -1)
    return Model(list(found["languages"]), rarity, weights, found["temperature"])


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score (calibrated probability) of every whole text, from the text alone.

    A null text, or one without letters, is ``und`` with score 0; so is any text if
    there is no model.
    """
    weights = None if model is None else (model.weights / model.temperature).astype(np.float64)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in in_slices(batch, 2000):
                names, scores = [], []
                for text in part.column(len(keep)).to_pylist():
                    if weights is None or text is None or not any(map(str.isalpha, text)):
                        names.append("und")
                        scores.append(0.0)
                        continue
                    at, x = vector(text, model.rarity)
                    p = softmax(x @ weights[at])
                    names.append(model.languages[int(p.argmax())])
                    scores.append(float(p.max()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    slim = docs.select(*keep, "text")
    schema = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"
    return slim.mapInArrow(run, schema)


def languages(docs: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; repeated rows come back as often."""
    rows = docs.select("doc_id", "text", "lang")
    marked = rows.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), "text")
    return predict(marked, train(rows, parts, part), ("doc_id", "held_out"))
