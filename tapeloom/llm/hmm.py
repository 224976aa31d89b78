"""Hidden Markov language model of words, trained by Baum-Welch over all training texts.

Every training word, however rare, is a symbol with emissions of its own.  Texts are kept
in units of some million words; a unit numbers its different words, and its texts hold
these numbers.  The words are dealt out in buckets by a hash.  A round has two halves: a
unit meets the emissions of its words and sends the expected counts of each word to the
word's bucket; a bucket adds up the counts of all units and sends the sums back.  Nothing
holds all words: a task has those of one unit or of one bucket, the driver none but the
most frequent ones.

An emission is the word's expected count in the state plus one occurrence that is spread
over the states like all tokens, so with one state the model is the smoothed unigram model
that is the base, and a word never seen has the same share in every state.

The rounds begin with a model of the pairs of words at a few distances, counted over all
training texts: the ``head`` most frequent words are told apart there, all others are one
symbol, which the first round tells apart by their surroundings.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.session import materialize

from .common import in_slices, shuffle_partitions, word_lists

#: Words that the start tells apart, the distances of its pairs, and passes over their counts.
HEAD = 512
LAGS = (1, 2, 4, 8)
WARM = 100
STATES = 8
ROUNDS = 3
#: Weight of the unigram model in each state of the start, in words.
PRIOR = 200.0
SEED = 7
#: Words of a unit, and of the texts that one row of it holds.
UNIT = 1 << 22
_TOKENS = 1 << 19
#: Buckets of words for each shuffle partition, and at most: a unit sends a row to each.
_BUCKETS, _MOST_BUCKETS = 8, 4096


@dataclass
class Model:
    """``emit`` has a row per symbol."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def _in_steps(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens ordered by their step, texts longest first: edges of the steps, text and place of each token."""
    longest = int(sizes[0]) if len(sizes) else 0
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
    edges = np.concatenate([[0], np.cumsum(active)])
    text = np.arange(edges[-1]) - np.repeat(edges[:-1], active)
    return edges, text, starts[text] + np.repeat(np.arange(longest), active)


def _recursion(model: Model, emitted: np.ndarray, edges: np.ndarray, alphas: np.ndarray | None = None) -> np.ndarray:
    """Scaled forward recursion over tokens in steps: the scale of each token; fills ``alphas`` if given."""
    scales, ones, a = np.ones(len(emitted), dtype=emitted.dtype), np.ones(len(model.start), dtype=emitted.dtype), None
    for lo, hi in itertools.pairwise(edges):
        a = (model.start if lo == 0 else a[: hi - lo] @ model.move) * emitted[lo:hi]
        s = a @ ones
        a /= s[:, None]
        scales[lo:hi] = s
        if alphas is not None:
            alphas[lo:hi] = a
    return scales


def forward(model: Model, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each text, longest first."""
    edges, text, at = _in_steps(starts, sizes)
    return np.bincount(text, weights=np.log(_recursion(model, model.emit[ids[at]], edges)), minlength=len(sizes))


def posteriors(model: Model, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """State probabilities of each token in steps, the tokens' places, expected transitions, and the log likelihood."""
    edges, _, at = _in_steps(starts, sizes)
    ahead, k = model.emit[ids[at]], len(model.start)
    gamma = np.empty_like(ahead)
    scales = _recursion(model, ahead, edges, gamma)
    ahead /= scales[:, None]
    moves, b = np.zeros((k, k)), np.ones((len(sizes), k), dtype=ahead.dtype)
    for t in range(len(edges) - 2, 0, -1):
        lo, hi = edges[t], edges[t + 1]
        n, to = hi - lo, ahead[lo:hi]
        to *= b[:n]
        before = gamma[edges[t - 1] : edges[t - 1] + n]
        moves += before.T @ to
        b[:n] = to @ model.move.T
        before *= b[:n]
    return gamma, at, moves * model.move, float(np.log(scales).sum(dtype=np.float64))


def expected(model: Model, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of one group of texts: start, transitions, emissions, and the log likelihood."""
    gamma, at, moves, likelihood = posteriors(model, ids, starts, sizes)
    return gamma[: len(sizes)].sum(axis=0), moves, _by_symbol(ids[at], gamma, len(model.emit)), likelihood


def _by_symbol(symbols: np.ndarray, gamma: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(symbols, weights=gamma[:, j], minlength=size) for j in range(gamma.shape[1])], axis=1)


def improved(start: np.ndarray, moves: np.ndarray, emits: np.ndarray, unigram: np.ndarray) -> Model:
    """The model of summed counts; every state keeps ``PRIOR`` words of the unigram model."""
    emit = emits + PRIOR * unigram[:, None]
    moves = moves + 1.0
    start = start + 1.0
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _small(model: Model) -> Model:
    return Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))


def _sent(values: np.ndarray) -> bytes:
    """Numbers as they travel: byte by byte of all values, compressed."""
    import pyarrow as pa

    size = np.int64(values.size).tobytes()
    return size + pa.compress(np.ascontiguousarray(values.reshape(-1, 1).view(np.uint8).T).tobytes(), codec="zstd", asbytes=True)


def _got(data: bytes, kind) -> np.ndarray:
    import pyarrow as pa

    size, width = int(np.frombuffer(data, np.int64, 1)[0]), np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], size * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, size).T).view(kind).ravel()


def _units(rows: DataFrame, buckets: int) -> DataFrame:
    """Texts and words of units: a row holds either.

    Texts: unit, held, docs, sizes, ids (the numbers of their words in the unit by falling
    frequency, texts longest first), and in one row of a unit times (how often each of its words
    occurs), from which the numbers of the words follow.  Words: unit, bucket, words (with spaces between them), own (how often each occurs in
    training texts of the unit); they are numbered through the buckets in order.  The empty word is the end of a text.
    """
    schema = rows.schema["doc_id"].dataType.simpleString()
    schema = f"unit long, bucket int, held boolean, docs array<{schema}>, sizes array<long>, ids binary, times binary, words binary, own binary"
    most, group = UNIT, _TOKENS

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        units = itertools.count(TaskContext.get().partitionId() << 32)

        def batch_of(**columns):
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(f, pa.nulls(n, k)) for f, k in kinds], names=[f for f, _ in kinds])

        def closed(number, docs, held, texts, lookup):
            words = list(lookup)
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            own, times = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            for some in range(0, len(texts), 1000):
                times += np.bincount(np.concatenate(texts[some : some + 1000]), minlength=len(times))
            times = times[order]
            rank = np.empty(len(order), np.int32)
            rank[_by_times(times)] = np.arange(len(order), dtype=np.int32)
            told = _sent(times)
            lengths = np.array([len(t) for t in texts])
            for kept in (False, True):
                at = np.flatnonzero(np.array(held) == kept)
                at = at[np.argsort(-lengths[at], kind="stable")]
                first = np.cumsum(lengths[at]) - lengths[at]
                for part in np.split(at, np.flatnonzero(np.diff(first // group)) + 1) if len(at) else []:
                    ids = place[np.concatenate([texts[i] for i in part])]
                    if not kept:
                        own += np.bincount(ids, minlength=len(own))
                    yield batch_of(
                        unit=pa.array([number], pa.int64()), held=pa.array([kept]), docs=pa.array([[docs[i] for i in part]], kinds[3][1]),
                        sizes=pa.array([lengths[part]], pa.list_(pa.int64())), ids=pa.array([_sent(rank[ids])], pa.binary()),
                        times=pa.array([told], pa.binary()),
                    )
                    told = None
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for some in range(0, buckets, 64):
                spans = [(b, edges[b], edges[b + 1]) for b in range(some, min(some + 64, buckets)) if edges[b + 1] > edges[b]]
                if spans:
                    yield batch_of(
                        unit=pa.array([number] * len(spans), pa.int64()), bucket=pa.array([b for b, _, _ in spans], pa.int32()),
                        words=pa.array([_sent(np.frombuffer(b" ".join([words[i] for i in order[lo:hi]]), np.uint8)) for _, lo, hi in spans], pa.binary()),
                        own=pa.array([_sent(own[lo:hi]) for _, lo, hi in spans], pa.binary()),
                    )

        def empty():
            lookup = defaultdict()
            lookup.default_factory = lookup.__len__
            return [], [], [], lookup, lookup[b""]  # the end is number 0

        docs, held, texts, lookup, size = empty()
        kinds = None
        for batch in batches:
            kinds = kinds or [
                ("unit", pa.int64()), ("bucket", pa.int32()), ("held", pa.bool_()), ("docs", pa.list_(batch.schema.field(0).type)),
                ("sizes", pa.list_(pa.int64())), ("ids", pa.binary()), ("times", pa.binary()), ("words", pa.binary()), ("own", pa.binary()),
            ]
            for part in in_slices(batch, 1000):
                for doc, kept, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    own = [np.fromiter(map(lookup.__getitem__, words), np.int32, len(words)) for words in word_lists(text)]
                    texts.append(np.concatenate([*own, np.zeros(1, np.int32)]))
                    docs.append(doc)
                    held.append(kept)
                    size += len(texts[-1])
                    if size >= most:
                        yield from closed(next(units), docs, held, texts, lookup)
                        docs, held, texts, lookup, size = empty()
        if docs:
            yield from closed(next(units), docs, held, texts, lookup)

    return rows.select("doc_id", "held", "text").mapInArrow(run, schema)


def _word_sums(words: DataFrame, head: int) -> DataFrame:
    """(bucket, unit, which, own, c): the word of each number of a unit within its bucket, and how often it occurs in the unit and in all training texts.

    One more row a bucket, with null for the unit: ``top``, its ``head`` most frequent words, and its tokens and distinct words.
    """

    def run(key, table):
        import pyarrow as pa

        word = pa.struct([("word", pa.binary()), ("which", pa.int32()), ("c", pa.int64())])
        units, owns = table["unit"].to_pylist(), table["own"].to_pylist()
        own = np.concatenate([_got(x, np.int64) for x in owns])
        numbers = defaultdict()
        numbers.default_factory = numbers.__len__
        which = [np.fromiter(map(numbers.__getitem__, _got(x.as_py(), np.uint8).tobytes().split(b" ")), np.int32) for x in table["words"]]
        edges, which, named = np.cumsum([0, *map(len, which)]), np.concatenate(which), list(numbers)
        c = np.bincount(which, weights=own, minlength=len(named)).astype(np.int64)
        rows = [(u, _sent(which[lo:hi]), o, _sent(c[which[lo:hi]])) for u, o, lo, hi in zip(units, owns, edges, edges[1:])]
        top = sorted(np.flatnonzero((c > 0) & (c >= np.sort(c)[-min(head, len(c))])).tolist(), key=lambda i: (-c[i], named[i]))[:head]
        rows.append((None, None, None, None))
        n = len(rows)
        more = [[None] * (n - 1) + [x] for x in ([{"word": named[i], "which": i, "c": int(c[i])} for i in top], int(c.sum()), int((c > 0).sum()))]
        columns = [[key[0].as_py()] * n, *map(list, zip(*rows)), *more]
        kind = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(word), pa.int64(), pa.int64()]
        names = ["bucket", "unit", "which", "own", "c", "top", "tokens", "kinds"]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kind)], names=names)

    schema = "bucket int, unit long, which binary, own binary, c binary, top array<struct<word: binary, which: int, c: long>>, tokens long, kinds long"
    return words.groupBy("bucket").applyInArrow(run, schema)


def _by_times(times: np.ndarray) -> np.ndarray:
    """The words of a unit by falling frequency."""
    return np.argsort(-times, kind="stable").astype(np.int32)


def _texts(table):
    """The groups of texts of a unit: held, docs, numbers of words, starts, sizes."""
    words = _by_times(_got(table["times"].drop_null()[0].as_py(), np.int64))
    for held, docs, sizes, ids in zip(*(table[c] for c in ("held", "docs", "sizes", "ids"))):
        sizes = sizes.values.to_numpy()
        yield held.as_py(), docs.values, words[_got(ids.as_py(), np.int32)], np.cumsum(sizes) - sizes, sizes


def _by_bucket(table, *names) -> list[list]:
    """Columns of the rows of a unit, in order of their buckets."""
    order = np.argsort(table["bucket"].to_numpy())
    return [table[n].take(order).to_pylist() for n in names]


def _pairs(texts: DataFrame, sums: DataFrame, symbols: dict[tuple[int, int], int], head: int) -> np.ndarray:
    """Counts of pairs of symbols at the distances of ``LAGS`` in all training texts: head words, and one symbol for all others."""
    size = head + 1
    known: dict[int, dict[int, int]] = defaultdict(dict)
    for (bucket, which), symbol in symbols.items():
        known[bucket][which] = symbol

    def run(left, right):
        import pyarrow as pa

        symbol = []
        for bucket, which in zip(*_by_bucket(right, "bucket", "which")):
            which = _got(which, np.int32)
            own = np.full(len(which), head)
            for w, s in known.get(bucket, {}).items():
                own[which == w] = s
            symbol.append(own)
        symbol = np.concatenate(symbol)
        found = np.zeros((len(LAGS), size * size), np.int64)
        for held, _, ids, _, sizes in _texts(left):
            if not held:
                flat, text = symbol[ids], np.repeat(np.arange(len(sizes)), sizes)
                for i, d in enumerate(LAGS):
                    same = text[:-d] == text[d:]
                    found[i] += np.bincount((flat[:-d] * size + flat[d:])[same], minlength=size * size)
        rows = found.reshape(len(LAGS), size, size).transpose(1, 0, 2).reshape(size, -1)
        seen = np.flatnonzero(rows.any(axis=1))
        return pa.Table.from_arrays([pa.array(seen.astype(np.int32)), pa.array(list(rows[seen]), pa.list_(pa.int64()))], names=["symbol", "pairs"])

    def add(key, table):
        import pyarrow as pa

        whole = np.sum([x.values.to_numpy() for x in table["pairs"]], axis=0)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([whole], pa.list_(pa.int64()))], names=["symbol", "pairs"])

    schema = "symbol int, pairs array<long>"
    own = texts.groupBy("unit").cogroup(sums.select("unit", "bucket", "which").groupBy("unit")).applyInArrow(run, schema)
    whole = np.zeros((len(LAGS), size, size))
    for r in own.groupBy("symbol").applyInArrow(add, schema).collect():
        whole[:, r["symbol"], :] = np.reshape(r["pairs"], (len(LAGS), size))
    return whole


def first_model(pairs: np.ndarray, unigram: np.ndarray, states: int) -> Model:
    """A model of the pairs at all distances, from seeded random emissions and states that tend to stay."""
    random = np.random.default_rng(SEED)
    emit = unigram[:, None] * np.exp(random.normal(0, 0.5, (len(unigram), states)))
    model = Model(np.full(states, 1 / states), np.full((states, states), 0.2 / states) + 0.8 * np.eye(states), emit / emit.sum(axis=0))
    if not pairs.any():
        return model
    for _ in range(WARM):
        start, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros(emit.shape)
        for lag, counts in zip(LAGS, pairs):
            steps = [np.linalg.matrix_power(model.move, t) for t in range(lag + 1)]
            joint = model.start[:, None] * steps[lag]
            left, right = model.emit @ joint, model.emit @ joint.T
            ratio = counts / np.maximum(left @ model.emit.T, 1e-300)
            ahead, behind = ratio @ right, ratio.T @ left
            emits += model.emit * (ahead + behind)
            ends = model.emit.T @ ratio @ model.emit
            start += (joint * ends).sum(axis=1)
            bridge = model.start[:, None] * ends
            moves += model.move * sum(steps[t].T @ bridge @ steps[lag - 1 - t].T for t in range(lag))
        model = improved(start, moves, emits, unigram)
    return model


@dataclass
class Totals:
    """What is known of all training tokens, and the start."""

    tokens: int
    kinds: int
    first: Model
    symbols: dict[tuple[int, int], int]

    @property
    def whole(self) -> float:
        return float(self.tokens + self.kinds + 1)


def _first_emissions(right, totals: Totals, rest: float) -> np.ndarray:
    """Emissions of the words of a unit in the start; words it doesn't tell apart share one symbol by their counts."""
    emit, known, found = totals.first.emit, defaultdict(dict), []
    for (bucket, which), symbol in totals.symbols.items():
        known[bucket][which] = symbol
    for bucket, which, c in zip(*_by_bucket(right, "bucket", "which", "c")):
        which, c = _got(which, np.int32), _got(c, np.int64)
        own = (c + 1.0)[:, None] / rest * emit[-1]
        for w, s in known.get(bucket, {}).items():
            own[which == w] = emit[s]
        found.append(own)
    return np.concatenate(found)


def _model(right, totals: Totals) -> Model:
    """The model of the words of a unit, from what the buckets sent; the row of bucket -1 has the sums of all units."""
    k = len(totals.first.start)
    (sums, *shares), (_, *counts) = _by_bucket(right, "sums", "c")
    sums = _got(sums, np.float64).reshape(k + 2, k)
    start, moves, tokens = sums[0] + 1.0, sums[1:-1] + 1.0, sums[-1]
    c = np.concatenate([_got(x, np.int64) for x in counts])
    share = np.concatenate([_got(x, np.float16).reshape(-1, k) for x in shares])
    # One occurrence more of each word is spread over the states like all tokens.
    spread = np.maximum(tokens / tokens.sum(), 1e-9) if tokens.sum() else np.full(k, 1 / k)
    emit = share * (c[:, None] / spread)
    emit += 1.0
    emit /= totals.whole
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emit)


def _round(texts: DataFrame, emissions: DataFrame, sums: DataFrame, totals: Totals, model) -> DataFrame:
    """One Baum-Welch round over all training texts: (unit, bucket, sums, c), from which the next one builds its model.

    Units send the shares of each word's occurrences in the states to its bucket, as 16-bit
    numbers, and their other counts to bucket -1; buckets send the sums back to the units.
    """
    k = len(totals.first.start)

    def expect(key, left, right):
        import pyarrow as pa

        small = _small(model(right))
        emits = np.zeros(small.emit.shape)
        start, moves = np.zeros(k), np.zeros((k, k))
        for held, _, ids, starts, sizes in _texts(left):
            if not held:
                gamma, at, moved, _ = posteriors(small, ids, starts, sizes)
                start += gamma[: len(sizes)].sum(axis=0)
                moves += moved
                emits += _by_symbol(ids[at], gamma, len(emits))
        tokens = emits.sum(axis=0)
        emits /= np.maximum(emits.sum(axis=1, keepdims=True), 1e-300)
        share = emits.astype(np.float16)
        known = [(b, len(_got(c, np.int64))) for b, c in zip(*_by_bucket(right, "bucket", "c")) if b >= 0]
        edges = np.cumsum([0, *(n for _, n in known)])
        rows = [(b, _sent(share[lo:hi])) for (b, _), lo, hi in zip(known, edges, edges[1:])]
        rows.append((-1, _sent(np.vstack([start, moves, tokens]))))
        columns = [pa.array([b for b, _ in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())]
        return pa.Table.from_arrays(columns, names=["bucket", "unit", "sums"])

    def add(key, left, right):
        import pyarrow as pa

        bucket, units = key[0].as_py(), left["unit"].to_pylist()
        if bucket < 0:
            whole = sum(_got(x.as_py(), np.float64) for x in left["sums"])
            rows = [(u, _sent(whole), _sent(np.zeros(0, np.int64))) for u in units]
        else:
            places = {u: (_got(w, np.int32), _got(o, np.int64), c) for u, w, o, c in zip(*(right[n].to_pylist() for n in ("unit", "which", "own", "c")))}
            size = 1 + max(int(w.max()) for w, _, _ in places.values())
            found, count = np.zeros((size, k)), np.zeros(size)
            for u, x in zip(units, left["sums"].to_pylist()):
                which, own, _ = places[u]
                found[which] += _got(x, np.float16).reshape(-1, k) * own[:, None]  # a unit has a word once
                count[which] += own
            share = (found / np.maximum(count, 1.0)[:, None]).astype(np.float16)
            rows = [(u, _sent(share[places[u][0]]), places[u][2]) for u in units]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32())]
        columns += [pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)]
        return pa.Table.from_arrays(columns, names=["unit", "bucket", "sums", "c"])

    sent = texts.groupBy("unit").cogroup(emissions.groupBy("unit")).applyInArrow(expect, "bucket int, unit long, sums binary")
    return sent.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(add, "unit long, bucket int, sums binary, c binary")


def language_model(docs: DataFrame, parts: int = 7, part: int = 2, states: int = STATES, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """Scores every whole text with models of the texts that are not held out; ``rounds`` is 1 or more.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).
    Null and blank texts are one end token.  Repeated rows are counted and scored one by
    one.  A null doc_id is a training text.  Without training texts every token is
    unseen; an empty table gives no rows.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held"), F.col("text").cast("binary").alias("text"))
    units = materialize(_units(rows, min(_BUCKETS * shuffle_partitions(docs), _MOST_BUCKETS)))
    texts = units.where("bucket is null").select("unit", "held", "docs", "sizes", "ids", "times")
    stored = materialize(_word_sums(units.where("bucket is not null").select("bucket", "unit", "words", "own"), head))
    sums, tops = stored.where("unit is not null").select("bucket", "unit", "which", "own", "c"), stored.where("unit is null")

    tokens, kinds = tops.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    top = tops.select("bucket", F.inline("top")).orderBy(F.desc("c"), "word").limit(head).collect()
    symbols = {(r["bucket"], r["which"]): i for i, r in enumerate(top)}
    masses = np.array([r["c"] + 1.0 for r in top])
    whole = float(tokens + kinds + 1)
    rest = max(whole - masses.sum(), 1.0)
    unigram = np.append(masses, rest) / whole
    first = first_model(_pairs(texts, sums, symbols, len(top)), unigram, states)
    totals = Totals(int(tokens), int(kinds), first, symbols)

    emissions = sums.select("unit", "bucket", "which", "c")
    model = lambda right: Model(first.start, first.move, _first_emissions(right, totals, rest))
    for _ in range(rounds):
        emissions = _round(texts, emissions, sums, totals, model)
        model = lambda right: _model(right, totals)

    def score(left, right):
        import pyarrow as pa

        own = _model(right, totals)
        c = np.concatenate([_got(x, np.int64) for x in _by_bucket(right, "c")[0]])
        logs, found = np.log10((c + 1) / totals.whole), []
        for held, names_of, ids, starts, sizes in _texts(left):
            known, base = np.add.reduceat(c[ids] > 0, starts, dtype=np.int64), np.add.reduceat(logs[ids], starts)
            path = forward(own, ids, starts, sizes) / np.log(10)
            columns = [names_of, pa.array(np.full(len(sizes), held)), *(pa.array(x) for x in (sizes, known, np.full(len(sizes), totals.tokens), base, path))]
            found.append(pa.Table.from_arrays(columns, names=names))
        return pa.concat_tables(found)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("unit").cogroup(emissions.groupBy("unit")).applyInArrow(score, schema)


# Classes of rare words: no part of the model any more, only their test calls them.


@dataclass
class Counts:
    """Head words with counts, and what is known of all training tokens."""

    words: list[bytes]
    head: np.ndarray
    end: int
    tokens: int
    distinct: int


def _encode(rows: DataFrame, counts: Counts) -> DataFrame:
    """doc_id, held, ids (symbols with the end), known (smoothed log counts of head and end), tail (the other words)."""
    lookup = {w: i for i, w in enumerate(counts.words)}
    head = np.log10(counts.head + 1.0)
    last = np.log10(counts.end + 1.0)

    def run(batches):
        import pyarrow as pa

        get, end, rare = lookup.get, len(lookup), len(lookup) + 1
        logs = np.concatenate([head, [last, 0.0]])
        for batch in batches:
            for part in in_slices(batch, 1000):
                ids, tails, sums = [], [], []
                for text in part.column(2).to_pylist():
                    own, tail = [], []
                    for words in word_lists(text):
                        found = np.fromiter(map(get, words, itertools.repeat(rare)), np.int32, len(words))
                        own.append(found)
                        tail.extend(itertools.compress(words, (found == rare).tolist()))
                    own.append(np.array([end], dtype=np.int32))
                    ids.append(np.concatenate(own))
                    tails.append(tail)
                    sums.append(float(logs[ids[-1]].sum()))
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids)) if ids else pa.array([], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(sizes), flat), pa.array(np.diff(sizes).astype(np.int64)), pa.array(sums, pa.float64()), pa.array(tails, pa.list_(pa.binary()))],
                    names=["doc_id", "held", "ids", "n", "known", "tail"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held", "text").mapInArrow(run, f"doc_id {kind}, held boolean, ids array<int>, n long, known double, tail array<binary>")


def word_classes(states: DataFrame, k: int) -> DataFrame:
    """(word, c, class) of all words in (word, k0, k1, ...): class 1 + state for words that keep to a state, else 0.

    The state is the one that holds most of the word compared with all words, the lower
    one of equals; it must hold half of the occurrences, and at least two.
    """
    columns = [f"k{j}" for j in range(k)]
    whole = states.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns]).first()
    shares = F.array(*[F.col(c) / max(float(whole[c]), 1.0) for c in columns])
    state = F.array_position(shares, F.array_max(shares)).cast("int")
    words = states.select("word", sum((F.col(c) for c in columns), F.lit(0.0)).alias("c"), F.element_at(F.array(*columns), state).alias("n"), state.alias("state"))
    return words.select("word", F.col("c").cast("long").alias("c"), F.when((F.col("n") >= 2) & (2 * F.col("n") >= F.col("c")), F.col("state")).otherwise(0).alias("class"))


def _with_classes(encoded: DataFrame, classes: DataFrame, masses: np.ndarray, rare: int) -> DataFrame:
    """The encoded texts with the classes of their words in place of rare; seen, logs and shares of these words."""
    mass = np.log10(masses)
    words = encoded.select("row", F.posexplode("tail").alias("pos", "word")).join(classes, "word")
    packed = F.col("pos").cast("long") * len(masses) + F.col("class")
    # Only places, classes and counts travel; what the classes take off is known where their list is.
    found = words.select("row", packed.alias("at"), F.log10(F.col("c") + 1.0).alias("log"))
    found = found.groupBy("row").agg(F.collect_list("at").alias("at"), F.sum("log").alias("logs"))
    rest = encoded.select("row", "doc_id", "held", "n", "known", F.size("tail").cast("long").alias("rest"), "ids")
    zero = F.lit(0.0)
    joined = rest.join(found, "row", "left").select(
        "doc_id", "held", "n", "known", "rest", F.coalesce("logs", zero).alias("logs"),
        F.coalesce("at", F.array().cast("array<long>")).alias("at"), "ids",
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, ids = batch.column(6), batch.column(7)
            values, sizes = ids.flatten().to_numpy(zero_copy_only=False).copy(), np.diff(at.offsets.to_numpy())
            rest = batch.column(4).to_numpy()
            places = np.flatnonzero(values == rare)
            pos, own = np.divmod(at.flatten().to_numpy(zero_copy_only=False), len(masses))
            values[places[np.repeat(np.cumsum(rest) - rest, sizes) + pos]] = rare + 1 + own
            taken = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=mass[own], minlength=len(sizes))
            shares = pa.array(batch.column(5).to_numpy() - taken)
            offsets = ids.offsets.to_numpy()
            lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], shares, pa.array(sizes.astype(np.int64)), lists], names=[*batch.schema.names[:6], "shares", "seen", "ids"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held boolean, n long, known double, rest long, logs double, shares double, seen long, ids array<int>"
    return joined.sortWithinPartitions("n").mapInArrow(run, schema)
