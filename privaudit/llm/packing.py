"""Mixture-controlled packing by deficit round-robin.

Each value of the source column is a queue of token ids.  Windows of
``window`` sequences are filled one after the other: a queue's deficit grows by
its target share of the window, it serves as many ids as its deficit allows, the
last few ids of a window go to the largest deficits, and what a queue got too
much or too little is carried to the next window.  Without given shares the
target is the corpus's own mixture, so all queues end together; with given
shares a queue that runs dry leaves its part to the others.

How much each queue serves depends on the queues' totals only.  Deficit
round-robin therefore runs on a tree of windows: the driver deals the queues'
totals to blocks of windows (at most ``_ENTRIES`` numbers, whatever the input),
carrying deficits from block to block, and the tasks that hold documents of a block
deal its ids to ``_FAN`` parts, the parts' to theirs, down to single windows.  A task
keeps the parts it used last, ``_CACHE_BYTES`` of them.  A document's place follows
from the ids of its queue before it, a two-phase prefix sum; no token moves between
machines.

Every id lies in exactly one piece.  All sequences are full but those of the
last, incomplete one, which is split into powers of two, so nothing is padded.

Defined cases: a null text is its end id alone; a null source is a queue of its
own; repeated rows and ids are packed each; an empty table gives no pieces; other
columns are ignored.  A queue's order is the order of the input's partitions and
rows.  Of more than ``max_queues`` sources, those with a given share and the largest
stay queues of their own and the others share ``_SHARED`` queues by hash, whose
target is the sum of theirs; more given shares than that are an error.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from privaudit.llm import worker
from privaudit.llm.storage import materialize
from privaudit.llm.tokens import encoder, listed, slices

#: Numbers (blocks x queues) that the driver deals, and blocks at least and at most.
_ENTRIES, _BLOCKS = 1 << 21, (64, 4096)
_FAN, _CACHE_BYTES = 64, 64 << 20
#: Queues that the smaller sources share when there are too many.
_SHARED = 1000
#: Above so many (task, queue) offsets they are joined instead of broadcast.
_BROADCAST_ROWS = 100_000

_STAGED = pa.schema([("task", pa.int32()), ("queue", pa.string()), ("local", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, window_id long"


def deal(left: np.ndarray, shares: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Deficit round-robin: ids that each queue serves to each window.

    ``sizes`` must sum to the queues' total; every window is filled exactly.
    """
    left, shares = left.astype(np.int64).copy(), np.maximum(shares.astype(np.float64), 1e-12)
    deficit, out = np.zeros(len(left)), np.zeros((len(sizes), len(left)), np.int64)
    for w, size in enumerate(sizes):
        live = left > 0
        deficit = np.where(live, deficit + size * (shares * live) / max((shares * live).sum(), 1e-300), 0.0)
        served = np.minimum(np.maximum(np.floor(deficit), 0).astype(np.int64), left)
        over = int(served.sum()) - size
        if over > 0:  # rounding of carried deficits: give back from the smallest remainders
            for q in np.argsort(deficit - served, kind="stable"):
                back = min(over, int(served[q]))
                served[q] -= back
                over -= back
        rest = size - int(served.sum())
        while rest > 0:
            order = np.argsort(-(deficit - served), kind="stable")
            order = order[left[order] > served[order]]
            if rest <= len(order):  # one id to each of the largest deficits
                served[order[:rest]] += 1
                break
            part = np.minimum(np.maximum(1, rest * shares[order] / shares[order].sum()).astype(np.int64), left[order] - served[order])
            part = np.diff(np.minimum(np.concatenate([[0], np.cumsum(part)]), rest))
            served[order] += part
            rest -= int(part.sum())
        out[w], left, deficit = served, left - served, deficit - served
    return out


class Plan:
    """Where each id of each queue goes."""

    def __init__(self, totals: list[int], shares: list[float], sequence: int, window: int):
        self.sequence, self.size, self.total = sequence, sequence * window, sum(totals)
        self.windows = max(1, -(-self.total // self.size))
        blocks = min(_BLOCKS[1], max(_BLOCKS[0], _ENTRIES // max(1, len(totals))))
        self.root = self._dealt(np.asarray(totals, np.int64), np.asarray(shares, np.float64), self.windows, -(-self.windows // blocks), 0)
        tail = self.total % sequence
        self.tail_at, self.tails = self.total - tail, []
        for bit in range(tail.bit_length() - 1, -1, -1):
            if tail >> bit & 1:
                self.tails.append(1 << bit)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("kept", "held")}

    def _dealt(self, totals: np.ndarray, shares: np.ndarray, windows: int, step: int, first: int) -> tuple:
        """A part's windows dealt in steps: step, queues that have ids, their ids before each step, places in single windows."""
        live = np.flatnonzero(totals)
        left = int(totals.sum())
        sizes = [min(step * self.size, left - at) for at in range(0, left, step * self.size)]
        served = deal(totals[live], shares[live], sizes)
        at = None
        if step == 1 and len(live):
            at = np.empty_like(served)
            for w in range(len(sizes)):  # the round starts one queue further in each window
                order = np.roll(np.arange(len(live)), -((first + w) % len(live)))
                at[w, order] = np.cumsum(served[w, order]) - served[w, order]
        return step, live, np.vstack([np.zeros((1, len(live)), np.int64), np.cumsum(served, axis=0)]), at

    def _part(self, first: int, windows: int, live: np.ndarray, ids: np.ndarray, queues: int) -> tuple:
        """The part of ``windows`` windows from ``first`` on, which holds ``ids``; the parts used last are kept."""
        if not hasattr(self, "kept"):
            self.kept, self.held = OrderedDict(), 0
        key = (first, windows)
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        totals = np.zeros(queues, np.int64)
        totals[live] = ids
        step = 1
        while -(-windows // step) > _FAN:
            step *= _FAN
        part = self._dealt(totals, totals.astype(np.float64), windows, step, first)
        self.kept[key] = part
        self.held += 2 * part[2].nbytes
        while self.held > _CACHE_BYTES and len(self.kept) > 1:
            self.held -= 2 * self.kept.popitem(last=False)[1][2].nbytes
        return part

    def runs(self, queue: int, start: int, length: int) -> Iterator[tuple[int, int]]:
        """Position in the packed stream and length of each part of the queue's [start, start + length)."""
        return self._runs(self.root, 0, self.windows, queue, start, length)

    def _runs(self, part: tuple, first: int, windows: int, queue: int, x: int, length: int) -> Iterator[tuple[int, int]]:
        step, live, before, at = part
        k = int(np.searchsorted(live, queue))
        mine = before[:, k]
        c = int(np.searchsorted(mine, x, "right")) - 1
        while length > 0 and c < len(before) - 1:
            n = min(int(mine[c + 1]) - x, length)
            if n > 0:
                inside = x - int(mine[c])
                if step == 1:
                    yield (first + c) * self.size + int(at[c, k]) + inside, n
                else:
                    below = min(step, windows - c * step)
                    child = self._part(first + c * step, below, live, before[c + 1] - before[c], int(live[-1]) + 1)
                    yield from self._runs(child, first + c * step, below, queue, inside, n)
                x, length = x + n, length - n
            c += 1

    def places(self, position: int, length: int) -> Iterator[tuple[int, int, int]]:
        """Sequence, offset and length of each part of a run."""
        while length:
            if position < self.tail_at:
                sequence, offset = divmod(position, self.sequence)
                n = min(length, self.sequence - offset, self.tail_at - position)
            else:
                sequence, at = self.tail_at // self.sequence, self.tail_at
                for size in self.tails:
                    if position < at + size:
                        break
                    sequence, at = sequence + 1, at + size
                offset = position - at
                n = min(length, size - offset)
            yield sequence, offset, n
            position, length = position + n, length - n


def _stage(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encode, done = TaskContext.get().partitionId(), encoder(tokenizer), {}
        tail = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for part in slices(batch, 2):
                ids = [x + tail for x in listed(encode.column(part.column(2)))]
                queues, n, local = part.column(1).to_pylist(), [len(x) // 2 for x in ids], []
                for queue, size in zip(queues, n):
                    local.append(done.get(queue, 0))
                    done[queue] = local[-1] + size
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(n), pa.int32()), pa.array(queues, pa.string()), pa.array(local, pa.int64()), part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], schema=_STAGED)

    return run


def _place(plan: Plan, names: list[str | None], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: i for i, name in enumerate(names)}
        for batch in batches:
            out: list[tuple] = []
            for queue, local, doc_id, n, ids, first, of in zip(*(batch.column(k).to_pylist() for k in ("queue", "local", "doc_id", "n", "ids", "first", "source"))):
                wide, start = np.frombuffer(ids, "<u2").astype("<u4").tobytes(), 0
                for position, length in plan.runs(number[queue], first + local, n):
                    at = position
                    for sequence, offset, size in plan.places(position, length):
                        piece = wide[4 * start : 4 * (start + size)]
                        out.append((doc_id, start, size, zlib.crc32(piece), n, sequence, offset, of, at // plan.size, ids[2 * start : 2 * (start + size)] if with_ids else None))
                        start, at = start + size, at + size
            columns = list(zip(*out)) or [()] * 10
            kinds = [pa.int64()] * 7 + [pa.string(), pa.int64()] + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "window_id"] + ["ids"] * with_ids)

    return run


def _queues(totals: DataFrame, shares: dict[str | None, float] | None, max_queues: int) -> DataFrame | None:
    """``source, queue`` if there are more sources than queues: the smaller ones share some."""
    if totals.count() <= max_queues:
        return None
    named = [s for s in shares or {} if s is not None]
    if len(named) + _SHARED > max_queues:
        raise ValueError("more shares are given than max_queues allows")
    least = totals.orderBy(F.desc("n")).limit(max_queues - _SHARED - len(named)).agg(F.min("n")).first()[0]
    own = F.col("source").isNull() | F.col("source").isin(named) | (F.col("n") > least)
    return totals.select("source", F.when(own, F.concat(F.lit("="), "source")).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(_SHARED)).cast("string"))).alias("queue"))


def pack(documents: DataFrame, tokenizer: str, end_id: int = 0, sequence: int = 1024, window: int = 64, shares: dict[str | None, float] | None = None, source: str = "source", max_queues: int = 16_384, with_ids: bool = False) -> DataFrame:
    """Pack ``documents`` (``doc_id, text`` and a source column); one row per piece.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue``
    (the source), ``window_id`` and, if asked for, ``ids`` (little-endian unsigned
    16-bit).
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("queue"), F.col("text").cast("string").alias("text"))
    staged = materialize(rows.mapInArrow(worker.task(_stage(tokenizer, end_id), "encoders"), "task int, queue string, local long, doc_id long, n long, ids binary"), "packing")

    parts = materialize(staged.groupBy("task", F.col("queue").alias("source")).agg(F.sum("n").alias("n")), "packing-parts")
    by_source = materialize(parts.groupBy("source").agg(F.sum("n").alias("n")), "packing-sources")
    queues = _queues(by_source, shares, max_queues)
    given = spark.createDataFrame([(s, float(v)) for s, v in (shares or {}).items()], "source string, share double")
    if queues is None:
        placed_parts = parts.withColumn("queue", F.col("source"))
        sums = by_source.select(F.col("source").alias("queue"), "n", F.col("source").alias("member"))
    else:
        queues = materialize(queues, "packing-queues").withColumnRenamed("source", "member")
        placed_parts = parts.join(queues, F.col("source").eqNullSafe(F.col("member"))).drop("member")
        sums = by_source.join(queues, F.col("source").eqNullSafe(F.col("member"))).select("queue", "n", "member")
    # the target of a queue is the sum of its sources' shares
    sums = sums.join(F.broadcast(given), F.col("member").eqNullSafe(F.col("source")), "left")
    totals = sums.groupBy("queue").agg(F.sum("n").alias("n"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("share"))
    totals = sorted(totals.collect(), key=lambda r: (r["queue"] is not None, r["queue"] or ""))  # a row per queue: max_queues at most
    if not totals:
        return spark.createDataFrame([], PIECES + ", ids binary" * with_ids)
    names, sizes = [r["queue"] for r in totals], [r["n"] for r in totals]
    plan = Plan(sizes, [r["share"] for r in totals] if shares else sizes, sequence, window)

    before = Window.partitionBy("queue").orderBy("task", "source").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed_parts.select(F.col("task").alias("of_task"), F.col("source").alias("of_source"), F.col("queue").alias("of_queue"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    offsets = materialize(offsets, "packing-offsets")
    first = F.broadcast(offsets) if offsets.count() <= _BROADCAST_ROWS else offsets
    placed = staged.join(first, (F.col("task") == F.col("of_task")) & F.col("queue").eqNullSafe(F.col("of_source"))).select(F.col("of_queue").alias("queue"), "local", "doc_id", "n", "ids", "first", F.col("queue").alias("source"))
    return placed.mapInArrow(worker.task(_place(plan, names, with_ids)), PIECES + ", ids binary" * with_ids)
