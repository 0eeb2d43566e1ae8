"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: a text's ASCII capitals become small, its words (split at ASCII
white space) give shingles, and a fingerprint bit is set if it is set in more
than half of the shingles' XXH64 values.

Linking: fingerprints that differ in at most ``radius`` bits are linked.  Equal
fingerprints meet first, so only different ones are compared.  Cut into
``radius + extra`` bands, two linked fingerprints agree in at least ``extra``
bands, so each combination of that many bands is a table whose key puts every
linked pair into one bucket at least once.  A bucket's members are stored as bit
planes, 64 members to a machine word; a member is compared with 64 others at a
time by adding the differing planes into carry-save counters, and a block is
abandoned as soon as all its 64 counters exceed the radius.  Of a bucket's links
only a spanning forest leaves the task, so the output never grows with the
square of a group; buckets above ``_BLOCK`` members are dealt to several tasks
as pairs of blocks.

Components come from alternating large-star and small-star steps over the links
between different fingerprints, each step written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; repeated rows each get a row; a null ``doc_id`` gets its component's
smallest id, null only if the component has no other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.llm import worker
from privaudit.llm.similar import bands, links, remaining_links, shared, shingles
from privaudit.llm.storage import materialize, partitions_for, spread_join

_BLOCK = 8192
#: Large buckets and components are broadcast up to so many, and joined beyond.
_BROADCAST_ROWS = 100_000
#: (fingerprint, word) comparisons held at a time.
_AT_ONCE = 1 << 17
_BYTES = np.array([[b >> (7 - k) & 1 for k in range(8)] for b in range(256)], np.uint8)


def fingerprint(text: str | None, size: int) -> int:
    """The 64-bit SimHash of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    stops = ends[size - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops)], ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprints(documents: DataFrame, size: int = 4) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed 64-bit number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(worker.task(run), "doc_id long, fp long")


# ---- bit-sliced comparison of the members of one task's buckets


def _planes(fps: np.ndarray, word_of: np.ndarray, lane_of: np.ndarray, words: int) -> np.ndarray:
    """Bit planes [64, words]: bit l of planes[p, w] is bit p of the member in lane l of word w."""
    planes = np.zeros((64, words), np.uint64)
    lane = np.uint64(1) << lane_of.astype(np.uint64)
    for p in range(64):
        on = (fps >> np.uint64(p) & np.uint64(1)).astype(bool)
        np.bitwise_or.at(planes[p], word_of[on], lane[on])
    return planes


def near_lanes(planes: np.ndarray, probe: np.ndarray, word: np.ndarray, used: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare ``probe[i]`` with the 64 lanes of ``word[i]``.

    Returns the indices that have lanes within the radius and those lanes' masks.
    """
    alive = np.arange(len(probe))
    far = ~used[word]
    levels = max(1, radius.bit_length())
    counters = [np.zeros(len(probe), np.uint64) for _ in range(levels)]
    order = [p for k in range(8) for p in range(k, 64, 8)]
    for step, p in enumerate(order):
        bit = (probe >> np.uint64(p) & np.uint64(1)).astype(bool)
        carry = planes[p][word] ^ np.where(bit, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        for k in range(levels):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        far |= carry
        above = np.zeros(len(probe), np.uint64)  # counter > radius, lane by lane
        equal = np.full(len(probe), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(levels - 1, -1, -1):
            if radius >> k & 1:
                equal = equal & counters[k]
            else:
                above |= equal & counters[k]
                equal = equal & ~counters[k]
        far |= above
        if step >= 7 and step % 4 == 3:
            keep = far != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not keep.all():
                alive, probe, word, far = alive[keep], probe[keep], word[keep], far[keep]
                counters = [c[keep] for c in counters]
            if not len(alive):
                break
    return alive, ~far


class _Forest:
    """Keeps the links that join two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def bucket_links(keys: np.ndarray, fps: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside each bucket.

    ``keys`` sorted.  ``side``: 0 compares with all of its bucket; 1 and 2 mark
    the two blocks of a pair, compared only with each other.
    """
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(first, len(keys)))
    big = sizes > 1
    rows = np.repeat(big, sizes)
    keys, fps, side = keys[rows], fps[rows], side[rows]
    if not len(keys):
        return []
    sizes = sizes[big]
    first = np.cumsum(sizes) - sizes
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(keys)) - first[bucket]
    words = (sizes + 63) // 64
    first_word = np.cumsum(words) - words
    word_of, lane_of = first_word[bucket] + rank // 64, rank % 64
    planes = _planes(fps, word_of, lane_of, int(words.sum()))
    used = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_or.at(used, word_of, np.uint64(1) << lane_of.astype(np.uint64))
    row_at = np.full((int(words.sum()), 64), -1, np.int64)
    row_at[word_of, lane_of] = np.arange(len(keys))

    label, forest, links = np.arange(len(keys)), _Forest(), []
    # a member meets its own word and the later ones of its bucket
    later = first_word[bucket] + words[bucket] - word_of
    ends = np.cumsum(later)
    at = 0
    while at < len(keys):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, "right")))
        probe = np.repeat(np.arange(at, stop), later[at:stop])
        word = word_of[probe] + np.arange(len(probe)) - np.repeat(np.cumsum(later[at:stop]) - later[at:stop], later[at:stop])
        alive, lanes = near_lanes(planes, fps[probe], word, used, radius)
        for part in range(0, len(alive), 1 << 14):
            chosen, mask = alive[part : part + (1 << 14)], lanes[part : part + (1 << 14)]
            near = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            a, b = probe[chosen][:, None], row_at[word[chosen]]
            near &= (b > a) & (label[a] != label[b]) & ((side[a] == 0) | (side[a] != side[b]))
            i, lane = np.nonzero(near)
            if len(i):
                a, b = probe[chosen[i]], row_at[word[chosen[i]], lane]
                changed = False
                for x, y in zip(a.tolist(), b.tolist()):
                    if forest.join(x, y):
                        links.append((int(fps[x]), int(fps[y])))
                        changed = True
                if changed:
                    touched = np.array([*forest.parent], np.int64)
                    label[touched] = [forest.root(x) for x in touched.tolist()]
        at = stop
    return links


def _bands(radius: int, extra: int) -> list[int]:
    """Masks of the tables' keys: all combinations of ``extra`` of ``radius + extra`` bands."""
    n = radius + extra
    edges = [round(64 * k / n) for k in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(parts):
            columns = [np.concatenate(c) for c in zip(*parts)]
            marks = np.cumsum(np.concatenate([[1], np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0).astype(np.int64)]))
            found = bucket_links(marks, columns[4].view(np.uint64), columns[3], radius)
            both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

        held: list[tuple] = []
        size = 0
        for batch in batches:
            columns = tuple(c.to_numpy() for c in batch.columns)
            if not batch.num_rows:
                continue
            held.append(columns)
            size += batch.num_rows
            if size < 4 * _BLOCK:
                continue
            whole = tuple(np.concatenate(c) for c in zip(*held))
            # the last bucket may go on in the next batch
            same = np.all([c == c[-1] for c in whole[:3]], axis=0)
            start = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if start:
                yield links([tuple(c[:start] for c in whole)])
            held, size = [tuple(c[start:] for c in whole)], len(same) - start
        if held:
            yield links(held)

    return run


def link(different: DataFrame, radius: int = 4, extra: int | None = None) -> DataFrame:
    """``a, b``: links whose components are those of all pairs within ``radius`` bits.

    ``different``: ``fp``, each value once.  ``extra`` sets how many bands a
    table's key has: more for larger inputs, so that buckets stay small; the
    result is the same for every choice.
    """
    spark = different.sparkSession
    if extra is None:
        n = different.count()
        extra = 1 if n < 1 << 24 else 2 if n < 1 << 32 else 3
    n = partitions_for(spark)
    masks = F.array(*(F.lit(_signed(m)) for m in _bands(radius, extra)))
    keyed = different.select("fp", F.posexplode(masks).alias("table", "mask")).select("table", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"), "fp")
    sizes = keyed.groupBy("table", "bucket").count().where(F.col("count") > _BLOCK)
    hot = materialize(sizes, "simhash-hot")
    if hot.isEmpty():
        rows = keyed.select("table", "bucket", F.lit(0).alias("pair"), F.lit(0).alias("side"), "fp")
    else:
        # a bucket of n members becomes all pairs of its n / _BLOCK blocks
        k = F.ceil(F.col("count") / F.lit(_BLOCK)).cast("int")
        blocks = hot.withColumn("k", k).drop("count")
        known = keyed.join(F.broadcast(blocks) if hot.count() <= _BROADCAST_ROWS else blocks, ["table", "bucket"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        parts = F.when(F.col("k").isNull(), F.array(F.struct(F.lit(0).alias("pair"), F.lit(0).alias("side")))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct((F.least(own, o) * F.col("k") + F.greatest(own, o)).cast("int").alias("pair"), F.when(own == o, 0).when(own < o, 1).otherwise(2).alias("side")))
        )
        rows = known.select("table", "bucket", F.explode(parts).alias("part"), "fp").select("table", "bucket", "part.pair", "part.side", "fp")
    placed = rows.repartition(n, "table", "bucket", "pair").sortWithinPartitions("table", "bucket", "pair", "side", "fp")
    return placed.mapInArrow(worker.task(_links(radius)), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, root``: for each linked node the smallest node of its component."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "simhash-links")
    while True:
        # large star: every larger neighbour is tied to the smallest neighbour or the node itself
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "simhash-large-star")
        # small star: a node's smaller neighbours and the node are tied to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, ["u"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = materialize(small, "simhash-star")
        same = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(different: DataFrame, radius: int = 4, extra: int | None = None) -> DataFrame:
    """``fp, root`` for different fingerprints: the smallest fingerprint of each one's component."""
    roots = materialize(components(link(different.select("fp"), radius, extra)), "simhash-roots")
    found = different.select("fp").join(roots, F.col("fp") == F.col("node"), "left")
    return found.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, size: int = 4, radius: int = 4, extra: int | None = None) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id of each document's component."""
    rows = materialize(fingerprints(documents, size), "simhash-fingerprints")
    different = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-different")
    merged = materialize(different.join(classes(different, radius, extra), "fp"), "simhash-merged")
    ids = materialize(merged.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-components")
    named = materialize(spread_join(merged.select("fp", "root"), ids, ["root"]).select("fp", "component_id"), "simhash-named")
    return spread_join(rows, named, ["fp"]).select("doc_id", "fp", "component_id")


def representatives(documents: DataFrame, size: int = 4, radius: int = 4, extra: int | None = None, similar: tuple[int, float] | None = None) -> DataFrame:
    """One row of ``documents`` per component, with all its columns: the smallest ``doc_id`` (null last), of repeated rows one.

    With ``similar``, a number of words and a Jaccard similarity, texts whose
    shingles of so many words are at least so similar are linked as well.

    Rows are numbered once, in a written table; what is grouped are numbers and
    fingerprints, so the texts of a large group never meet.  Texts are compared once
    for each fingerprint and shingle set (its 64-bit digest).
    """
    from xxhash import xxh64_intdigest

    row = F.struct(*(documents[f"`{c}`"] for c in documents.columns))
    inputs = documents.select(F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("number"), F.col("doc_id").alias("id"), row.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, digests, keys = [], [], []
            for value in batch.column(0):
                text = value.as_py()
                found.append(fingerprint(text, size))
                own = shingles(text, similar[0]) if similar else np.zeros(0, np.uint64)
                digests.append(xxh64_intdigest(own.tobytes(), 9))
                keys.append(bands(own))
            numbers = (pa.array(np.array(c, np.uint64).view(np.int64)) for c in (found, digests))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *numbers, pa.array(keys, pa.list_(pa.int64()))], names=["number", "id", "row", "fp", "digest", "bands"])

    kinds = dict(inputs.dtypes)
    rows = materialize(inputs.mapInArrow(worker.task(run), f"number long, id {kinds['id']}, row {inputs.schema['row'].dataType.simpleString()}, fp long, digest long, bands array<long>"), "simhash-rows")
    best = rows.groupBy("fp", "digest").agg(F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "number")).alias("best"))
    best = materialize(best, "simhash-best")
    merged = materialize(best.join(classes(best.select("fp").distinct(), radius, extra), "fp").select("best", "root"), "simhash-merged")
    near = None
    for last in (False, True) if similar else ():
        members = merged.select("root", F.col("best.number").alias("number"))
        texts = rows.select("number", F.col("row.text").cast("string").alias("text"))
        if last:  # roots only grow, so no other bucket has several of them
            found = remaining_links(near.select("key", "number").join(members, "number"), texts, *similar)
        else:
            kept = merged.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.number").alias("number"), F.lit(True).alias("kept"))
            members = members.join(kept, "number", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
            near = shared(materialize(members.join(rows.select("number", "bands"), "number"), "simhash-members"))
            found = links(near, texts, *similar)
        linked = materialize(found, "simhash-similar")
        of = merged.select(F.col("best.number").alias("number"), "root")
        ends = linked.join(of.select(F.col("number").alias("a"), F.col("root").alias("ra")), "a").join(of.select(F.col("number").alias("b"), F.col("root").alias("rb")), "b")
        tops = materialize(components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top")), "simhash-tops")
        merged = merged.join(F.broadcast(tops) if tops.count() <= _BROADCAST_ROWS else tops, "root", "left")
        merged = materialize(merged.select("best", F.coalesce("top", "root").alias("root")), "simhash-merged")
    chosen = merged.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.number").alias("number"))
    kept = rows.join(chosen.hint("merge"), "number", "left_semi")  # grows with the texts: never broadcast
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in documents.columns))


def fingerprint_hex(fp):
    """A signed fingerprint column as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
