"""Repeated passages by longest-previous-factor arrays.

A passage is a string of ``length`` bytes.  ``keep="first"`` removes every byte that lies
in a passage which also starts at an earlier place, so the first copy stays;
``keep="none"`` removes all copies.  Passages are judged on the input and may overlap;
they never cross documents.

1. Every passage is named by the least hash of its substrings of half its length; equal
   passages have equal names.  The passages that share one occurrence of such a
   substring follow each other and make a segment, named and fingerprinted with rolling
   hashes in one pass over the text.  About every hundredth byte begins a segment.
2. Names are counted, and segments whose name occurs once are dropped.  Equal segments
   of a name form a class: where it has several members, all but the first are copies.
   No text is needed for that, and a hot passage is summed before it is shuffled.
3. Of names with several classes one segment a class is read, and its suffixes are
   ordered inside a task: previous and next smaller positions in suffix order give each
   its longest previous factor (larger positions its longest next one).
4. A name with more than ``_BLOCK`` classes is dealt to several tasks.  Each finds the
   copies among its own; what stands there first is compared over the tasks by 128-bit
   digests of the passages, so no group has to fit into one task and no copy is lost.

Names and classes are 64-bit hashes of which both must agree (128 bits) before bytes are
compared or taken as equal.  A run of one byte gives a segment for each of its passages.

Defined cases: a null text is empty; texts shorter than ``length`` keep all; repeated rows
are copies of each other; the first is that with the smaller ``doc_id`` (null: before
all), of equal ones any single one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.llm.storage import materialize, partitions_for, spread_join
from privaudit.llm.tokens import slices

#: Bytes that are hashed at a time; positions among them take the low bits of a hash.
_PLACE_BITS = 20
#: Classes of a name that one task compares, and bytes of segments it orders at a time, about.
_BLOCK, _PACK_BYTES = 4096, 1 << 20
_DRAWN = np.random.default_rng(11).integers(0, 1 << 63, 260, np.uint64)
_LETTER, _BASE, _MIX = _DRAWN[:256] << np.uint64(1) | np.uint64(1), int(_DRAWN[256]) | 1, _DRAWN[257] | np.uint64(1)
#: Lengths whose ranks are doubled from one to the next.
_LEVELS = (8, 16, 32, 64, 128, 256, 512, 1024)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(29)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(x) - width + 1
    grid = np.full((-(-len(x) // width), width), np.iinfo(x.dtype).max, x.dtype)
    grid.ravel()[: len(x)] = x
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[:n], upto[width - 1 : width - 1 + n])


class Segments:
    """Cuts texts of one length of passage into segments."""

    def __init__(self, length: int):
        self.length, self.half = length, max(1, length // 2)
        self.most = max(1 << _PLACE_BITS, 2 * length)
        if length < 2 or self.most > 1 << 24:
            raise ValueError("passages have 2 bytes to 8 MB")
        self.mask = np.uint64((1 << (self.most - 1).bit_length()) - 1)
        self.power, self.inverse = _powers(_BASE, self.most + 1), _powers(pow(_BASE, -1, 1 << 64), self.most + 1)

    def part(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """First passage, number of passages, name and class of each segment; passages of a text start in [first, end)."""
        length, half, n = self.length, self.half, len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data] * self.power[:n], out=sums[1:])
        hashed = _mixed((sums[half:] - sums[:-half]) * self.inverse[: n - half + 1])
        placed = hashed & ~self.mask | np.arange(len(hashed), dtype=np.uint64)
        at = (sliding_min(placed, length - half + 1) & self.mask).astype(np.int64)
        edge = np.zeros(len(at) + 1, np.int8)
        np.add.at(edge, first, 1)
        np.add.at(edge, end, -1)
        valid = np.cumsum(edge[:-1]) > 0
        new = np.concatenate([[True], at[1:] != at[:-1]])
        begins = np.flatnonzero(valid & (new | ~np.concatenate([[False], valid[:-1]])))
        ends = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
        count, place = ends - begins + 1, at[begins]
        whole = (sums[ends + length] - sums[begins]) * self.inverse[begins]
        kind = _mixed(whole + _mixed(((place - begins) << 32 | count).astype(np.uint64)))
        return [begins, count, hashed[place].view(np.int64), kind.view(np.int64)]

    def texts(self, edges: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
        """Number of the text, first passage in it, number of passages, name and class of each segment."""
        length, step = self.length, self.most - self.length + 1
        found = []
        for at in range(0, len(data) - length + 1, step):
            stop = min(at + step, len(data) - length + 1)  # passages that start in [at, stop)
            some = slice(np.searchsorted(edges, at, "right") - 1, np.searchsorted(edges, stop))
            first = np.maximum(edges[:-1][some], at)
            end = np.minimum(edges[1:][some] - length + 1, stop)
            full = end > first
            if full.any():
                begins, *rest = self.part(data[at : stop + length - 1], first[full] - at, end[full] - at)
                text = np.searchsorted(edges, begins + at, "right") - 1
                found.append([text, begins + at - edges[text], *rest])
        return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 5


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Segments(length)
        for whole in batches:
            for batch in slices(whole, 2):
                texts = batch.column(2).cast(pa.large_binary())
                raw = texts.buffers()
                edges = np.frombuffer(raw[1], np.int64, len(texts) + 1, texts.offset * 8)
                data = np.frombuffer(raw[2] or b"", np.uint8)[edges[0] : edges[-1]]
                text, first, count, name, kind = cutter.texts(edges - edges[0], data)
                taken = [pc.take(batch.column(k), pa.array(text)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(name), pa.array(kind)], names=["ord", "row", "first", "n", "name", "kind"])

    return run


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
    return out


def suffix_order(data: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in order of their first ``length`` bytes, equal ones by position, and the bytes each shares with the one before (``length`` at most).

    ``length`` bytes follow every start.  Ranks of longer and longer prefixes come
    from pairs of ranks of shorter ones.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + n]
    levels = [_ranks(word)] if length >= 8 else []
    for level in _LEVELS[:-1]:
        if 2 * level > length:
            break
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - level)] = levels[-1][level:] + 1
        levels.append(_ranks(levels[-1] << 32 | ahead))
    if not levels:
        raise ValueError("passages of fewer than 8 bytes are not ordered")
    top = _LEVELS[len(levels) - 1]
    offsets = [*range(0, length - top, top), length - top]
    keys = [levels[-1][starts + at] for at in offsets]
    order = np.lexsort([position, *keys[::-1]])
    a, b = starts[order][:-1], starts[order][1:]
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        common = np.zeros(len(a), np.int64)
        for level, rank in zip(reversed(_LEVELS[: len(levels)]), reversed(levels)):
            for _ in range(length // top if level == top else 1):
                same = (common < length) & (rank[np.minimum(a + common, n - 1)] == rank[np.minimum(b + common, n - 1)])
                common += same * level
        for _ in range(7):
            common += (common < length) & (padded[a + np.minimum(common, length)] == padded[b + np.minimum(common, length)])
        shared[1:] = np.minimum(common, length)
    return order, shared


def _nearest_smaller(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """What each suffix shares with the nearest one before it in the order that has a smaller position; 0 if none has."""
    to, low, todo = np.arange(-1, len(position) - 1), shared.copy(), np.arange(len(position))
    while len(todo):
        j = to[todo]
        todo = todo[(j >= 0) & (position[j] > position[todo])]
        j = to[todo]
        low[todo], to[todo] = np.minimum(low[todo], low[j]), to[j]
    return np.where(to >= 0, low, 0)


def longest_factors(data: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start the longest factor (up to ``length``) that also begins at a smaller position, and at a larger one."""
    order, shared = suffix_order(data, starts, position, length)
    place, after = position[order], np.concatenate([shared[1:], [0]])[::-1] if len(order) else shared
    out = []
    for sign in (1, -1):
        found = np.maximum(_nearest_smaller(sign * place, shared), _nearest_smaller(sign * place[::-1], after)[::-1])
        back = np.empty(len(order), np.int64)
        back[order] = found
        out.append(back)
    return out[0], out[1]


def runs(flags: np.ndarray) -> np.ndarray:
    """First and last place of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges.reshape(-1, 2) - [0, 1]


def _pack(rows: list[tuple], length: int, keep: str) -> Iterator[tuple]:
    """Ranges of copies ``row, first, last`` of whole groups, and of cut groups what stands first: its name, digest, order, place and whether a copy is known."""
    _, _, order, row, first, n, members, cut, texts = zip(*rows)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, first = np.array(n), np.array(first)
    base = np.cumsum([0, *map(len, texts)])[:-1]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(base, n) + within
    sort = np.lexsort([np.repeat(first, n) + within, np.repeat(np.array(row), n), np.repeat(np.array(order), n)])
    position = np.empty(len(sort), np.int64)
    position[sort] = np.arange(len(sort))
    earlier, later = (x >= length for x in longest_factors(data, starts, position, length))
    copies = earlier if keep == "first" else earlier | later
    at = 0
    for i, r in enumerate(rows):
        part = slice(at, at + int(n[i]))
        at += int(n[i])
        if keep == "first" or members[i] == 1:
            for a, b in runs(copies[part]).tolist():
                yield row[i], int(first[i]) + a, int(first[i]) + b, None, None, None, None
        if cut[i] > 1:
            known = keep == "none" and members[i] > 1
            for k in np.flatnonzero(~earlier[part]).tolist():
                digest = hashlib.blake2b(texts[i][k : k + length], digest_size=16).digest()
                yield row[i], int(first[i]) + k, int(first[i]) + k, r[0], digest, order[i], bool(known or keep == "none" and copies[part][k])


def _compare(length: int, keep: str):
    """Rows come sorted by name and block; whole blocks are packed up to a bounded size."""

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*_pack(rows, length, keep))) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "first", "last", "name", "digest", "ord", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != last:
                    if size > _PACK_BYTES:
                        yield out(held)
                        held, size = [], 0
                    last = row[:2]
                held.append(row)
                size += len(row[-1])
        if held:
            yield out(held)

    return run


def _read(length: int):
    """The bytes of the segments listed for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "block", "ord", "row", "first", "n", "members", "cut"]
        for batch in batches:
            lists = batch.column(1)
            text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            flat = pc.list_flatten(lists)
            columns = {c: pc.struct_field(flat, c) for c in names if c != "row"}
            columns["row"] = pc.take(batch.column(2), pa.array(text))
            raw, cut = [None] * batch.num_rows, []
            for t, first, n in zip(text.tolist(), columns["first"].to_pylist(), columns["n"].to_pylist()):
                if raw[t] is None:
                    raw[t] = batch.column(0)[t].as_buffer().to_pybytes()
                cut.append(raw[t][first : first + n + length - 1])
                if len(cut) == 8192:
                    yield from _slice(columns, names, cut)
                    columns, cut = {c: v.slice(8192) for c, v in columns.items()}, []
            yield from _slice(columns, names, cut)

    def _slice(columns, names, cut):
        yield pa.RecordBatch.from_arrays([*(columns[c].slice(0, len(cut)) for c in names), pa.array(cut, pa.binary())], names=[*names, "segment"])

    return run


def several_classes(kinds: DataFrame) -> DataFrame:
    """The rows of names that have several classes, with their number ``k``; ``kinds`` is a written table, a hot name's rows stay where they are read."""
    mixed = materialize(kinds.groupBy("name").count().where("count > 1"), "repeats-mixed")
    return spread_join(kinds, mixed.withColumnRenamed("count", "k"), ["name"], counts=mixed)


class Repeats:
    """The repeated passages of one table of documents."""

    def __init__(self, documents: DataFrame, length: int = 400, keep: str = "first"):
        if keep not in ("first", "none"):
            raise ValueError("keep is 'first' or 'none'")
        self.length, self.keep = length, keep
        rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        #: ``row, doc_id, text``; a written table, so a row keeps its number.
        self.rows = materialize(rows, "repeats-rows")
        #: ``row, first, last``: places at which copied passages start.
        self.copies = self._copies()

    def _copies(self) -> DataFrame:
        spark, none = self.rows.sparkSession, self.keep == "none"
        long = self.rows.where(F.octet_length("text") >= self.length).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("ord"), "row", F.col("text").cast("binary").alias("text"))
        segments = materialize(long.mapInArrow(_segments(self.length), "ord long, row long, first int, n int, name long, kind long"), "repeats-segments")
        again = materialize(segments.groupBy("name").count().where("count > 1"), "repeats-names")
        segments = materialize(spread_join(segments, again.select("name"), ["name"], counts=again), "repeats-candidates")
        kinds = materialize(segments.groupBy("name", "kind").agg(F.count("*").alias("members"), F.min(F.struct("ord", "row", "first", "n")).alias("rep")), "repeats-classes")
        # members of a class are copies of each other
        several = kinds.where("members > 1").select("name", "kind", F.col("rep.row").alias("rep_row"), F.col("rep.first").alias("rep_first"))
        members = spread_join(segments, several, ["name", "kind"])
        if not none:
            members = members.where("row <> rep_row or first <> rep_first")
        found = members.select("row", "first", (F.col("first") + F.col("n") - 1).alias("last"))
        # names with several classes: their texts are compared
        cut = F.ceil(F.col("k") / F.lit(_BLOCK)).cast("int")
        listed = F.struct("name", F.pmod("kind", cut).cast("int").alias("block"), "rep.ord", "rep.first", "rep.n", "members", cut.alias("cut"))
        wanted = several_classes(kinds).select(F.col("rep.row").alias("row"), listed.alias("s")).groupBy("row").agg(F.collect_list("s").alias("s"))
        read = self.rows.join(wanted, "row").select(F.col("text").cast("binary").alias("text"), "s", "row")
        read = read.mapInArrow(_read(self.length), "name long, block int, ord long, row long, first int, n int, members long, cut int, segment binary")
        dealt = read.repartition(partitions_for(spark), "name", "block").sortWithinPartitions("name", "block")
        compared = materialize(dealt.mapInArrow(_compare(self.length, self.keep), "row long, first int, last int, name long, digest binary, ord long, known boolean"), "repeats-compared")
        found = found.union(compared.where("digest is null").select("row", "first", "last"))
        # what stands first in a block of a cut name may have copies in other blocks
        firsts = compared.where("digest is not null")
        across = firsts.groupBy("name", "digest").agg(F.count("*").alias("blocks"), F.min(F.struct("ord", "row", "first")).alias("least")).where("blocks > 1")
        more = firsts.join(across, ["name", "digest"])
        more = more.where("not known") if none else more.where("row <> least.row or first <> least.first")
        return materialize(found.union(more.select("row", "first", "last")), "repeats-copies")

    def documents(self) -> DataFrame:
        """A row per document: ``doc_id, text, kept, spans``; ``kept`` are the remaining bytes, ``spans`` the removed runs, ``start`` to before ``end``."""
        length = self.length
        starts = self.copies.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
        rows = self.rows.join(starts, "row", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "starts")
        return rows.mapInArrow(_remove(length), "doc_id long, n_bytes long, kept binary, spans array<struct<start:int,end:int>>")


def merged(starts: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs of bytes covered by passages that start in the given ranges (first, last)."""
    starts = starts[np.argsort(starts[:, 0], kind="stable")]
    first, end = starts[:, 0], np.maximum.accumulate(starts[:, 1] + length)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    return np.stack([first[new], np.concatenate([end[new[1:] - 1], end[-1:]])], axis=1)


def _remove(length: int):
    spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, kept, spans, at = batch.column(2), [], [], 0
            count = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
            flat = pc.list_flatten(lists)
            starts = np.stack([pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("first", "last")], axis=1).astype(np.int64) if len(flat) else np.zeros((0, 2), np.int64)
            for text, n in zip(batch.column(1), count):
                raw = text.as_buffer()
                cut = merged(starts[at : at + n], length).tolist() if n else []
                at += n
                edges = [0, *(e for s in cut for e in s), len(raw)]
                kept.append(b"".join(raw[a:b].to_pybytes() for a, b in zip(edges[::2], edges[1::2])) if cut else raw.to_pybytes())
                spans.append([{"start": a, "end": b} for a, b in cut])
            size = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(kept, pa.binary()), pa.array(spans, spans_kind)], names=["doc_id", "n_bytes", "kept", "spans"])

    return run
