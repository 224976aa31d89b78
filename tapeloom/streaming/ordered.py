"""Ordered scans of a stream: a reorder buffer in keyed state, released in order.

Rows of a recording may come in any order and in any cut into micro-batches.  They wait
in state until they are next in line: the index that follows the last one, or an index
whose event time the watermark has passed, so that nothing before it can still come.
Rows behind the watermark are dropped by Spark, rows behind the cursor (repeats) here.
So every cut into micro-batches whose delays stay inside the watermark gives the result
of the batch form.

State is bounded: waiting rows by the watermark, the scan's own state by its schema.
Recordings of a shard share one state value, which grows with their number.  A
row marked ``last`` ends its recording and removes its state; without one a timer does
so ``idle`` of event time after the newest row.  A query with these operators needs the
RocksDB state store, which ``durable_state`` sets for the session.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Groups of recordings whose state is one value.
SHARDS = 2048
#: Types whose values pandas hands over as those of Python.
PLAIN = ("int", "bigint", "double", "boolean", "string")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def durable_state(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, on disk with changelogs in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _plain(value):
    """Lists and numbers of Python for what a batch holds, the form in which state is kept."""
    if isinstance(value, np.ndarray):
        return [_plain(x) for x in value] if value.dtype == object else value.tolist()
    if isinstance(value, list | tuple):
        return [_plain(x) for x in value]
    return value


def _columns(rows: list[tuple], width: int) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(width)]


class Scan:
    """What an ordered scan does with rows in order.

    ``columns`` are those of a row besides index, ts and last; ``state`` is the schema of
    what is carried and ``first`` its value before any row; ``output`` the schema of what
    is emitted.  ``step`` takes the carried tuple, the index and a row, ``finish`` the
    carried tuple at the end of the recording; both return it (``finish``: nothing) and
    the emitted rows.
    """

    columns: tuple[str, ...] = ()
    state = ""
    output = ""
    first: tuple = ()

    def step(self, held: tuple, index: int, row: tuple) -> tuple[tuple, list[tuple]]:
        raise TypeError("a scan defines step")

    def finish(self, held: tuple) -> list[tuple]:
        return []


def _release(
    scan: Scan, held: tuple, cursor: int | None, newest: int, queue: list[tuple], start: int | None, idle_ms: int, watermark: int
) -> tuple[tuple, int | None, list[tuple], list[tuple], bool]:
    """Rows that are next in line go through the scan; what is carried, the cursor, the output, the rows that wait on, the end."""
    out, ended, at = [], False, 0
    for at, row in enumerate(queue):  # noqa: B007
        index = row[0]
        if cursor is not None and index < cursor:
            continue
        if index != cursor and row[1] > watermark:
            break
        held, found = scan.step(held, index, row[3:])
        out.extend(found)
        # Without a first index the rows have no next one: they wait for the watermark.
        cursor = index + 1 if start is not None else max(index, cursor or index)
        if row[2]:
            ended = True
            break
    else:
        at = len(queue)
    rest = queue[at:]
    if not ended and not rest and newest + idle_ms <= watermark:
        ended = True
    if ended:
        out.extend(scan.finish(held))
    return held, cursor, out, rest, ended


def ordered(
    frames: DataFrame, scan: Scan, index: str, watermark: str, by: str = "rec_id", start: int | None = 0, idle_ms: int = 60_000,
    shards: int = SHARDS,
) -> DataFrame:
    """The rows that ``scan`` emits over ``frames`` (by, ts, index, its columns, optionally last) in the order of the index.

    ``start`` is the index of a recording's first row; with it a row is released as soon
    as its predecessor was.  With None indices may have gaps and only the watermark
    releases rows; a row that repeats the newest index is then a row of its own.

    Recordings are dealt over ``shards`` by hash; the cursors, carried values and waiting
    rows of a shard are one state value, which comes with its rows and goes back once, so
    a small recording costs no visit of its own.  A restarted stream needs the same number.
    """
    durable_state(frames.sparkSession)
    end = F.coalesce("last", F.lit(False)) if "last" in frames.columns else F.lit(False)
    slim = frames.withWatermark("ts", watermark).select(
        F.pmod(F.xxhash64(by), F.lit(shards)).alias("row_shard"), by, F.col(index).cast("long").alias("row_at"),
        F.unix_millis("ts").alias("row_ms"), end.alias("row_end"), *scan.columns, F.col("ts").alias("row_ts"),
    )
    fields = ["row_at", "row_ms", "row_end", *scan.columns]
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    # One array for each value of a recording and for each column of the waiting rows; ``wake``: when there is something to do.
    carried = T.StructType.fromDDL(f"`key` {kinds[by]}, wake long, row_next long, row_newest long, {scan.state}")
    each = [f"`{f.name}` array<{f.dataType.simpleString()}>" for f in carried.fields]
    waiting = [f"`wait_{c}` array<{kinds[c]}>" for c in (by, *fields)]
    kept = T.StructType.fromDDL(", ".join([*each, *waiting]))
    output = T.StructType.fromDDL(f"`{by}` {kinds[by]}, {scan.output}")
    size, names = len(each), output.names

    def work(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = tuple(state.get) if state.exists else ((),) * len(kept)
        known = {k: rest for k, *rest in zip(*stored[:size], strict=True)}
        queues: dict = {}
        for k, *row in zip(*stored[size:], strict=True):
            queues.setdefault(k, []).append(tuple(row))
        fresh = {}
        for part in parts:
            columns = [part[c].tolist() if kinds[c] in PLAIN else [_plain(v) for v in part[c].tolist()] for c in (by, *fields)]
            for k, *row in zip(*columns, strict=True):
                queues.setdefault(k, []).append(tuple(row))
                fresh[k] = max(fresh.get(k, -1), row[1])
        now, out = state.getCurrentWatermarkMs(), []
        for k in [*known, *(k for k in fresh if k not in known)]:
            wake, cursor, newest, *held = known.get(k) or (0, start, -1, *scan.first)
            if k not in fresh and wake > now:
                continue
            newest = max(newest, fresh.get(k, -1))
            queue = sorted(queues.pop(k, ()), key=lambda r: r[0])
            held, cursor, found, rest, ended = _release(scan, tuple(held), cursor, newest, queue, start, idle_ms, now)
            out.extend((k, *r) for r in found)
            if ended:
                known.pop(k, None)
                continue
            known[k] = (max(min((r[1] for r in rest), default=newest + idle_ms), now + 1), cursor, newest, *held)
            if rest:
                queues[k] = rest
        if known:
            rows = [(k, *r) for k, queue in queues.items() for r in queue]
            state.update((*_columns([(k, *v) for k, v in known.items()], size), *_columns(rows, len(waiting))))
            state.setTimeoutTimestamp(max(min(v[0] for v in known.values()), now + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    return slim.groupBy("row_shard").applyInPandasWithState(work, output, kept, "append", GroupStateTimeout.EventTimeTimeout)


class QuietRuns(Scan):
    """Runs ``[start, end)`` of consecutive quiet frames."""

    columns, state, output, first = ("quiet",), "a long, b long", "start long, end long", (-1, -1)

    def __init__(self, least: int = 1):
        self.least = least

    def _closed(self, a, b):
        return [(a, b)] if a >= 0 and b - a >= self.least else []

    def step(self, held, index, row):
        a, b = held
        if row[0] and a >= 0 and index == b:
            return (a, index + 1), []
        return ((index, index + 1) if row[0] else (-1, -1)), self._closed(a, b)

    def finish(self, held):
        return self._closed(*held)


class OrderViolations(Scan):
    """Rows whose clock does not exceed that of the row before."""

    columns, state, output, first = ("pts",), "pts double", "ordinal long, pts double, previous double", (float("nan"),)

    def step(self, held, index, row):
        pts = float(row[0])
        return (pts,), [(index, pts, held[0])] if pts <= held[0] else []


class RepairedBlocks(Scan):
    """Blocks on one sample clock: overlap trimmed, holes filled with zeros, cut at the limit.

    Emits ``filler`` and sound as ``samples`` rows, and each hole longer than a second
    (``rate`` samples) as a ``hole`` row without samples; ``split_outputs`` takes them apart.
    ``limit`` is the length of the recording in samples, repeated on its rows.
    """

    columns = ("first_sample", "samples", "limit")
    state, output, first = "cursor long, `limit` long", "kind string, first_sample long, end long, filler boolean, samples array<double>", (0, -1)

    def __init__(self, rate: int, tolerant: bool = False):
        self.rate, self.tolerant = rate, tolerant

    def _filled(self, start: int, end: int, limit: int) -> list[tuple]:
        out = [("hole", start, end, True, None)] if end - start > self.rate and not self.tolerant else []
        for at in range(start, min(end, limit), self.rate):
            to = min(at + self.rate, end, limit)
            out.append(("samples", at, to, True, [0.0] * (to - at)))
        return out

    def step(self, held, index, row):
        cursor, _ = held
        begin, samples, limit = int(row[0]), row[1], int(row[2])
        out = self._filled(cursor, begin, limit) if begin > cursor else []
        stop, start = begin + len(samples), max(begin, cursor)
        if min(stop, limit) > start:
            out.append(("samples", start, min(stop, limit), False, [float(x) for x in samples[start - begin : min(stop, limit) - begin]]))
        return (max(cursor, stop), limit), out

    def finish(self, held):
        cursor, limit = held
        return self._filled(cursor, limit, limit) if limit > cursor else []


def split_outputs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples and holes of ``RepairedBlocks`` output, of a stored table or of one micro-batch."""
    samples = rows.where("kind = 'samples'").select("rec_id", "first_sample", "samples", "filler")
    return samples, rows.where("kind = 'hole'").select("rec_id", F.col("first_sample").alias("start"), "end")


class QuietMeter(Scan):
    """Level per short window over all channels, and runs of quiet windows.

    Carries two levels of state: the open window (energy of each channel, peak, samples
    so far) and the open run.  Blocks follow each other on the sample clock and may be cut
    anywhere, also inside a window.  Emits a ``run`` row for each run over the limit and a
    ``report`` row at the end of the recording.
    """

    columns = ("samples",)
    state = "energy array<double>, peak double, filled long, cursor long, start long, longest double"
    output = "kind string, start double, end double, longest double, within boolean"
    first = ([], 0.0, 0, 0, -1, 0.0)

    def __init__(self, rate: int, threshold_db: float, limit: float = 1.5, window: float = 0.02):
        self.rate, self.limit = rate, limit
        self.size = max(1, round(rate * window))
        self.floor = 10 ** (threshold_db / 20)

    def _run(self, start: int, end: int) -> tuple[float, list[tuple]]:
        a, b = start / self.rate, end / self.rate
        over = b - a >= 0.3 and b - a > self.limit + 1e-6
        return b - a, [("run", a, b, None, None)] if over else []

    def _close(self, held):
        """The open window is full, or the last one: it counts as quiet or ends the open run."""
        energy, peak, filled, cursor, start, longest = held
        quiet = math.sqrt(max(energy) / filled) < self.floor and peak < self.floor * 10 ** (3 / 20)
        out: list[tuple] = []
        if quiet:
            start = cursor if start < 0 else start
        elif start >= 0:
            length, out = self._run(start, cursor)
            start, longest = -1, max(longest, length)
        return ([], 0.0, 0, cursor + filled, start, longest), out

    def step(self, held, index, row):
        channels = np.array([np.asarray(c, dtype=np.float64) for c in row[0]])
        out, at, total = [], 0, channels.shape[1] if channels.ndim == 2 else 0
        while at < total:
            energy, peak, filled, cursor, start, longest = held
            part = channels[:, at : at + self.size - filled]
            sums = (part**2).sum(axis=1)
            energy = (sums + np.asarray(energy)).tolist() if len(energy) else sums.tolist()
            held = (energy, max(peak, float(np.abs(part).max())), filled + part.shape[1], cursor, start, longest)
            at += part.shape[1]
            if held[2] == self.size:
                held, found = self._close(held)
                out.extend(found)
        return held, out

    def finish(self, held):
        out: list[tuple] = []
        if held[2]:
            held, out = self._close(held)
        *_, cursor, start, longest = held
        if start >= 0:
            length, found = self._run(start, cursor)
            out, longest = [*out, *found], max(longest, length)
        return [*out, ("report", None, None, round(longest, 4), longest <= self.limit + 1e-6)]


def quiet_runs(frames: DataFrame, least: int = 1, watermark: str = "10 seconds", idle_ms: int = 60_000, start: int | None = 0) -> DataFrame:
    """Quiet runs per recording over ``(rec_id, ts, frame_idx, quiet[, last])``, whatever the order of arrival."""
    return ordered(frames, QuietRuns(least), "frame_idx", watermark, start=start, idle_ms=idle_ms)


def order_violations(packets: DataFrame, watermark: str = "1 minute", idle_ms: int = 600_000) -> DataFrame:
    """Packets ``(rec_id, ts, ordinal, pts)`` whose clock does not exceed the one before, in the order of the ordinal."""
    return ordered(packets, OrderViolations(), "ordinal", watermark, start=None, idle_ms=idle_ms)


def repaired_blocks(blocks: DataFrame, rate: int, tolerant: bool = False, watermark: str = "1 minute", idle_ms: int = 600_000) -> DataFrame:
    """Repaired samples and holes of ``(rec_id, ts, block_idx, first_sample, samples, limit[, last])``; see ``split_outputs``."""
    return ordered(blocks, RepairedBlocks(rate, tolerant), "block_idx", watermark, idle_ms=idle_ms)


def live_quiet_meter(
    blocks: DataFrame, rate: int, threshold_db: float, limit: float = 1.5, window: float = 0.02, watermark: str = "1 minute", idle_ms: int = 600_000
) -> DataFrame:
    """``quiet_meter`` over ``(rec_id, ts, block_idx, samples[, last])``, blocks that follow each other without holes."""
    return ordered(blocks, QuietMeter(rate, threshold_db, limit, window), "block_idx", watermark, idle_ms=idle_ms)


def restartable_scan(
    spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    kind: str = "parquet", files: int = 16, **options,
):
    """Start a scan of the files below ``source``: ``files`` of them a batch, each exactly once into the table at ``out``.

    ``work`` is row-wise (or a stream operator).  The file sink lists a batch in its log
    only when all its files are written, and the checkpoint remembers the files read: a
    scan that stops or fails between or inside batches goes on where it ended, with the
    same table as a scan without a break.  Files added later are read by the next start.
    """
    reader = spark.readStream.format(kind).schema(schema).options(maxFilesPerTrigger=files, **options)
    writer = work(reader.load(source)).writeStream.format("parquet").outputMode("append")
    return writer.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
