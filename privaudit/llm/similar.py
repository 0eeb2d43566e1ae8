"""Links between texts whose word shingles have a Jaccard similarity of at least a given value.

A text is the set of its shingles' hashes.  Texts come with a ``root``, the component that
they are known to belong to, and are only compared with those of other roots:

1. ``links``: 24 bands of five min-hashes give buckets.  Of each bucket one pivot meets
   one kept and one changing member of every other root, which ties large groups
   together with as many pairs as there are members.
2. ``remaining_links``: texts that still share a bucket with another root are dealt to
   cells of bounded size, a root's together, each pair of cells that has work to one
   task; a large root's cells only meet those of others.  There all members of a bucket
   meet those of other roots as bit sets of the hashes that several of them have; what
   leaves the task is a forest of links, never the pairs that were compared, however
   many texts just below the similarity stand around one template.

All comparisons are exact.  Lost are only links of texts without a common band, at
similarity 0.8 with a chance of 0.00007.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.llm import worker
from privaudit.llm.storage import materialize, partitions_for, spread_join

_BANDS, _ROWS = 24, 5
#: Numbers of texts to read are broadcast up to so many, and joined beyond.
_BROADCAST_ROWS = 100_000
#: Bytes of the sets on each side of a cell of pairs, about.
_CELL_BYTES = 8 << 20
#: Hashes whose members are compared at a time, and words of bit sets held for members and for pairs.
_HASHES, _WORDS = 1 << 20, 1 << 22
_DRAWN = np.random.default_rng(5).integers(0, 1 << 63, (2, _BANDS * _ROWS), np.uint64)
_TIMES, _PLUS = (_DRAWN[0] << np.uint64(1) | np.uint64(1))[:, None], _DRAWN[1][:, None]


def shingles(text: str | None, size: int) -> np.ndarray:
    """The different hashes of a text's word shingles, sorted; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of min-hashes, another for each band; none for an empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    least = np.full(_BANDS * _ROWS, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[at : at + 2048] * _TIMES + _PLUS) >> np.uint64(32)).min(axis=1))
    keys = [xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(_BANDS, _ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def near(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of ``others`` have a Jaccard similarity to ``one`` of at least ``similarity``; none of the sorted sets is empty."""
    lengths = np.array([len(o) for o in others])
    whole = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, whole), len(one) - 1)] == whole
    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(lengths) - lengths)
    return both / (len(one) + lengths - both) >= similarity


def sets(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``number, set`` and the other columns of ``members`` (a written table): the shingle sets, written; ``texts``: ``number, text``."""
    names = [c for c in members.columns if c != "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), size).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), *batch.columns[2:]], names=["number", "set", *names])

    few = members.count() <= _BROADCAST_ROWS
    rows = texts.join(F.broadcast(members) if few else members, "number").select("number", "text", *names)
    kinds = dict(members.dtypes)
    return materialize(rows.mapInArrow(worker.task(run), ", ".join(["number long", "set array<long>", *(f"{c} {kinds[c]}" for c in names)])), "similar-sets")


class _Forest:
    """Joins trees of texts and their roots; ``label`` of a text is the same within a tree."""

    def __init__(self, roots: np.ndarray):
        self.label = np.unique(roots, return_inverse=True)[1]

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        self.label[self.label == max(x, y)] = min(x, y)
        return True


def _compare(one: np.ndarray, other: np.ndarray | None, held: list[np.ndarray], forest: _Forest, similarity: float) -> Iterator[tuple[int, int]]:
    """Links between the texts ``one``, or between those and ``other``, that join two trees."""
    both = one if other is None else np.concatenate([one, other])
    label = forest.label[both]
    if (label == label[0]).all():
        return
    sizes = np.array([len(held[i]) for i in both])
    large = sizes.sum() > _HASHES
    if not large:
        values, codes, n = np.unique(np.concatenate([held[i] for i in both]), return_inverse=True, return_counts=True)
        common = n > 1  # only hashes that several texts have count
        large = len(both) * -(-int(common.sum()) // 64) > _WORDS
    if large and len(both) > 2:
        halves = [np.array_split(x, 2) if len(x) > 1 else [x] for x in ([one] if other is None else [one, other])]
        for i, x in enumerate(halves[0]):
            for y in [None, *halves[0][i + 1 :]] if other is None else halves[1]:
                yield from _compare(x, y, held, forest, similarity)
        return
    if sizes.sum() > _HASHES:  # two long texts
        values, codes, n = np.unique(np.concatenate([held[i] for i in both]), return_inverse=True, return_counts=True)
        common = n > 1
    feature, row = (np.cumsum(common) - 1)[codes], np.repeat(np.arange(len(both)), sizes)
    row, feature = row[common[codes]], feature[common[codes]]
    bits = np.zeros((len(both), max(1, -(-int(common.sum()) // 64))), np.uint64)
    np.bitwise_or.at(bits, (row, feature // 64), np.uint64(1) << (feature % 64).astype(np.uint64))
    split = len(both) if other is None else len(one)
    step = max(1, (1 << 20) // len(both))
    for at in range(0, split, step):
        rows, label = np.arange(at, min(at + step, split)), forest.label[both]
        columns = np.arange(at if other is None else split, len(both))
        meets = label[rows][:, None] != label[columns][None, :]
        meets &= np.minimum(sizes[rows][:, None], sizes[columns][None, :]) >= similarity * np.maximum(sizes[rows][:, None], sizes[columns][None, :]) - 1e-9
        if other is None:
            meets &= columns[None, :] > rows[:, None]
        i, j = np.nonzero(meets)
        i, j = rows[i], columns[j]
        for part in range(0, len(i), chunk := max(1, _WORDS // bits.shape[1])):
            a, b = i[part : part + chunk], j[part : part + chunk]
            shared = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
            linked = shared / (sizes[a] + sizes[b] - shared) >= similarity
            for x, y in zip(both[a[linked]].tolist(), both[b[linked]].tolist()):
                if forest.join(x, y):
                    yield x, y


def _cell(similarity: float):
    """Rows ``cx, cy, cell, number, root, buckets, set`` come sorted by ``cx, cy``."""

    def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        cx, cy, cell, number, root = (table[c].to_numpy() for c in ("cx", "cy", "cell", "number", "root"))
        held = [s.values.to_numpy() for s in table["set"]]
        lists = table["buckets"].combine_chunks()
        key = lists.flatten().to_numpy()
        of = np.repeat(np.arange(len(number)), lists.value_lengths().to_numpy())
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]])) if len(key) else [0]
        forest, found = _Forest(root), []
        for a, b in zip(edges, edges[1:]):
            some = of[order[a:b]]
            if b - a == 1:
                continue
            if cx[0] == cy[0]:
                found += _compare(some, None, held, forest, similarity)
            elif 0 < (left := cell[some] == cx[0]).sum() < len(some):
                found += _compare(some[left], some[~left], held, forest, similarity)
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(number[ends[:, k]]) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if held and b > a and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (x[a], y[a]):
                    yield links(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield links(held)

    return run


def shared(members: DataFrame) -> DataFrame:
    """``key, number, root`` and other columns of ``members`` (written; with ``bands``) for the buckets of several roots, written."""
    keyed = members.select(F.explode("bands").alias("key"), *(c for c in members.columns if c != "bands"))
    mixed = keyed.groupBy("key").agg(F.count("*").alias("count"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = materialize(mixed.select("key", "count"), "similar-buckets")
    # merged by shuffle at every size: the buckets grow with the texts
    return materialize(spread_join(keyed, mixed.select("key").hint("merge"), ["key"], counts=mixed), "similar-shared")


def links(near: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """``a, b``: texts of different roots that are at least so similar, of those that meet a bucket's pivot.

    ``near``: ``key, number, root, kept``, a written table; ``texts``: ``number, text``.
    """
    mark = F.struct((~F.col("kept")).alias("other"), F.xxhash64("number", "key").alias("turn"), "number", "root")
    entries = materialize(near.groupBy("key", "root").agg(F.min(mark).alias("first"), F.max(mark).alias("last")), "similar-entries")
    pivots = materialize(entries.groupBy("key").agg(F.count("*").alias("count"), F.min("first").alias("pivot")), "similar-pivots")
    met = spread_join(entries, pivots.select("key", "pivot"), ["key"], counts=pivots).where("root <> pivot.root")
    met = met.select("pivot.number", F.explode(F.array_distinct(F.array("first.number", "last.number"))).alias("other"))
    pairs = materialize(met.select(F.least("number", "other").alias("x"), F.greatest("number", "other").alias("y")).distinct(), "similar-pairs")
    asked = pairs.select(F.explode(F.array("x", "y")).alias("number")).distinct()
    return _similar(pairs, sets(materialize(asked, "similar-asked"), texts, size), similarity)


def remaining_links(near: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """``a, b``: links between texts of different roots that share a bucket and are at least so similar; of each pair of cells a forest.

    ``near``: ``key, number, root``; ``texts``: ``number, text``.
    """
    near = materialize(near, "similar-near")
    mixed = near.groupBy("key").agg(F.count("*").alias("count"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = materialize(mixed.select("key", "count"), "similar-buckets")
    asked = spread_join(near.select("key", "number", "root"), mixed.select("key"), ["key"], counts=mixed).groupBy("number", "root").agg(F.collect_list("key").alias("buckets"))
    held = sets(materialize(asked, "similar-asked"), texts, size)
    columns, k = ["cell", "number", "root", "buckets", "set"], 1 + (held.agg(F.sum(F.size("set") * 8)).first()[0] or 0) // _CELL_BYTES
    if k == 1:
        rows = held.withColumn("cell", F.lit(0).cast("long"))
        dealt = rows.select(F.col("cell").alias("cx"), F.col("cell").alias("cy"), *columns)
    else:
        # a root's texts stand together; one of many bytes has several cells
        parts = held.groupBy("root").agg(F.sum(F.size("set") * 8).alias("count"), F.ceil(F.sum(F.size("set") * 8) / F.lit(_CELL_BYTES)).alias("parts"))
        parts = materialize(parts.where("parts > 1"), "similar-roots")
        own = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("root"), F.lit(k))).otherwise(F.lit(k) + F.pmod(F.xxhash64("root", F.pmod(F.xxhash64("number"), "parts")), F.lit(1 << 40)))
        rows = held.join(F.broadcast(parts.select("root", "parts")) if parts.count() <= _BROADCAST_ROWS else parts.select("root", "parts"), "root", "left").withColumn("cell", own).drop("parts")
        # a text meets the cells with other roots that its buckets reach
        places = materialize(rows.select("number", "root", "cell", F.explode("buckets").alias("key")), "similar-places")
        reach = places.groupBy("key", "cell").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
        reach = reach.groupBy("key").agg(F.sum("n").alias("count"), F.collect_list(F.struct("cell", "low", "high")).alias("cells"))
        reach = materialize(reach, "similar-reach")
        met = spread_join(places.select("number", "root", "key"), reach.select("key", "cells"), ["key"], counts=reach)
        other = F.filter("cells", lambda c: (c["low"] != F.col("root")) | (c["high"] != F.col("root")))
        met = met.select("number", F.explode(F.transform(other, lambda c: c["cell"])).alias("other")).distinct()
        dealt = rows.join(met, "number").select(F.least("cell", "other").alias("cx"), F.greatest("cell", "other").alias("cy"), *columns)
    placed = dealt.repartition(partitions_for(held.sparkSession), "cx", "cy").sortWithinPartitions("cx", "cy")
    return placed.mapInArrow(worker.task(_cell(similarity)), "a long, b long")


def _check(similarity: float):
    """Cells come one after the other, each with its sets before its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            found: list[tuple[int, int]] = []
            own, lists = batch.column(2).is_valid().to_numpy(zero_copy_only=False), batch.column(2)
            rows = zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), own.tolist(), range(batch.num_rows))
            for (cx, cy, x), group in groupby(rows, lambda r: r[:3]):
                if cell != (cx, cy):
                    cell, held = (cx, cy), {}
                pairs = []
                for _, _, _, y, is_set, i in group:
                    if is_set:
                        held[x] = np.sort(lists[i].values.to_numpy().view(np.uint64))
                    else:
                        pairs.append(y)
                for at in range(0, len(pairs), 256):
                    some = pairs[at : at + 256]
                    found += [(x, y) for y, yes in zip(some, near(held[x], [held[y] for y in some], similarity).tolist()) if yes]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _similar(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``x, y`` whose sets (``number, set``) are at least so similar.

    Pairs are dealt to cells by both their numbers, so a task reads each set of a
    cell once, however many pairs it is in, and a cell's sets are bounded.
    """
    size = held.agg(F.sum(F.size("set") * 8)).first()[0] or 0
    k = F.lit(1 + size // _CELL_BYTES)
    cells = pairs.select(F.pmod(F.xxhash64("x"), k).alias("cx"), F.pmod(F.xxhash64("y"), k).alias("cy"), "x", "y")
    ends = cells.select("cx", "cy", F.explode(F.array("x", "y")).alias("number")).distinct()
    given = ends.join(held, "number").select("cx", "cy", "set", F.col("number").alias("x"), F.lit(None).cast("long").alias("y"))
    rows = given.union(cells.select("cx", "cy", F.lit(None).cast("array<long>").alias("set"), "x", "y"))
    placed = rows.repartition(partitions_for(pairs.sparkSession), "cx", "cy").sortWithinPartitions("cx", "cy", F.col("y").isNotNull(), "x")
    return placed.mapInArrow(worker.task(_check(similarity)), "a long, b long")
