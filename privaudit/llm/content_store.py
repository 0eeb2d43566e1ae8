"""Content-addressed store of token-id streams.

Every document's ids (plus an end id) are cut into chunks by a rolling hash over
the last eight ids, so equal passages give equal chunks wherever they stand.
The store is three Parquet tables in a folder that all executors share:

* ``chunks``: ``digest`` (BLAKE2b-128 of the bytes), ``n`` and ``ids``
  (little-endian unsigned 16-bit); each different chunk once;
* ``recipes``: the documents in ascending ``doc_id`` order with ``local_start``
  (ids before it in its shard), ``n_tokens``, chunk digests and lengths and the
  Merkle ``root`` over the digests;
* ``manifest``: one row per recipe shard: documents, ids, first id position
  and the Merkle root over its documents' roots.

Reading back re-hashes every chunk, recomputes every root of documents and shards,
compares the shards with the manifest and follows every recipe; a difference raises
an error.

Defined cases: a null text is empty; an empty text is its end id alone; a null
``doc_id`` comes first; rows that repeat a ``doc_id`` each get a recipe, ordered
by root and then by content length; an empty table gives an empty store; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privaudit.llm import worker
from privaudit.llm.storage import materialize, partitions_for, scratch, spread_join
from privaudit.llm.tokens import encoder, listed, slices

#: A chunk ends where the top bits of the rolling hash are zero: one id in 512.
_MEAN_BITS, _LEAST, _MOST = 9, 128, 2048
_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)

_LOOSE = "digest binary, n int, ids binary, doc_id long, n_tokens long, digests array<binary>, lengths array<int>, root binary"
_LOOSE_ARROW = pa.schema([("digest", pa.binary()), ("n", pa.int32()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("root", pa.binary())])


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Binary Merkle root; an odd last node moves up unchanged."""
    level = list(leaves) or [b""]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def boundaries(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash allows a cut, for a whole batch."""
    places, step = [], 1 << 20
    for at in range(0, len(ids), step):  # parts that overlap by the window bound the memory
        rolling = _GEAR[ids[max(0, at - 7) : at + step]]
        for age in (1, 2, 4):  # sums over two, four and eight ids, older ones shifted further
            rolling[age:] += rolling[:-age] << np.uint32(age)
        found = np.flatnonzero(rolling >> np.uint32(32 - _MEAN_BITS) == 0) + max(0, at - 7) + 1
        places.append(found[found > at] if at else found)
    return np.concatenate(places) if places else np.zeros(0, np.int64)


def cut(start: int, end: int, allowed: np.ndarray) -> list[int]:
    """Chunk ends of the document at [start, end): content-defined, bounded lengths."""
    ends, at = [], start
    own = allowed[np.searchsorted(allowed, start + _LEAST) : np.searchsorted(allowed, end)].tolist()
    for place in [*own, end]:
        while place - at > _MOST:
            at += _MOST
            ends.append(at)
        if place - at >= _LEAST or place == end > at:
            ends.append(place)
            at = place
    return ends


def _loose(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path), set()
        for batch in batches:
            for part in slices(batch, 1):
                yield from one(encode, seen, part)

    def one(encode, seen, batch):
        coded, tail = listed(encode.column(batch.column(1))), np.array([end_id], "<u2").tobytes()
        stream = b"".join(x for ids in coded for x in (ids, tail))
        allowed = boundaries(np.frombuffer(stream, "<u2"))
        out, at = {name: [] for name in _LOOSE_ARROW.names}, 0
        new: list[tuple[bytes, int, bytes]] = []
        recipes = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), coded):
            n, names, lengths = len(ids) // 2 + 1, [], []
            last = at
            for stop in cut(at, at + n, allowed):
                piece = stream[2 * last : 2 * stop]
                name = digest(piece)
                names.append(name)
                lengths.append(stop - last)
                if name not in seen:
                    seen.add(name)
                    new.append((name, stop - last, piece))
                last = stop
            recipes.append((doc_id, n, names, lengths, merkle_root(names)))
            at += n
        none_r, none_c = [None] * len(recipes), [None] * len(new)
        out["digest"], out["n"], out["ids"] = [[*none_r, *(c[k] for c in new)] for k in range(3)]
        for k, name in enumerate(("doc_id", "n_tokens", "digests", "lengths", "root")):
            out[name] = [*(r[k] for r in recipes), *none_c]
        if len(seen) > 1_000_000:  # repeats within a task are only a saving; all are dropped after the shuffle
            seen.clear()
        yield pa.RecordBatch.from_pydict(out, schema=_LOOSE_ARROW)

    return run


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first chunk of each digest, and all recipe rows; holds the partition's digests only."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for name in listed(batch.column(0)):
            keep.append(name is None or name not in seen)
            if name is not None:
                seen.add(name)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number recipe rows within their shard and add running starts."""
    from pyspark import TaskContext

    shard, start, row = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = np.asarray(batch.column(1).to_pylist(), np.int64)
        ends = start + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), shard, np.int32)), pa.array(row + np.arange(len(n))), pa.array(ends - n), *batch.columns],
            names=["shard", "row", "local_start", *batch.schema.names],
        )
        start, row = (int(ends[-1]) if len(n) else start), row + len(n)


@dataclass(frozen=True)
class Store:
    """Paths of the three tables."""

    path: str

    def chunks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/loose").where("digest is not null").select("digest", "n", "ids")

    def recipes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/recipes")

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/manifest")


def _shard_roots(recipes: DataFrame, n: int) -> DataFrame:
    """Of each shard its documents, ids and the Merkle root over its documents' roots."""

    def roots(batches):
        leaves: list[bytes] = []
        total, shard = 0, None
        for batch in batches:
            shard = batch.column(0)[0].as_py() if batch.num_rows else shard
            leaves += batch.column(1).to_pylist()
            total += sum(batch.column(2).to_pylist())
        if shard is not None:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "documents": [len(leaves)], "ids": [total], "root": [merkle_root(leaves)]}, schema=pa.schema([("shard", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("root", pa.binary())]))

    # a shard's rows were written in order by one task; reading by shard number keeps them together
    ordered = recipes.select("shard", "root", "n_tokens", "row").repartition(n, "shard").sortWithinPartitions("shard", "row")

    def by_shard(batches):
        last, held = None, []
        for batch in batches:
            marks = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(marks)), np.flatnonzero(np.diff(marks)) + 1):
                if len(part):
                    if last is not None and marks[part[0]] != last:
                        yield from roots(held)
                        held = []
                    last = marks[part[0]]
                    held.append(batch.slice(int(part[0]), len(part)))
        yield from roots(held)

    return ordered.mapInArrow(by_shard, "shard int, documents long, ids long, root binary")


def write_store(documents: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> Store:
    """Encode, cut, deduplicate and write; see the module's description.

    One shuffle moves each task's new chunks to the place of their digest; the
    recipes, some per cent of the ids, are then range-sorted by ``doc_id``.
    """
    spark = documents.sparkSession
    path, n = path or scratch(spark, "content-store"), partitions_for(spark)
    loose = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(worker.task(_loose(tokenizer, end_id), "encoders"), _LOOSE)
    # recipes are spread by their root and row: copies of one document must not meet in one task
    place = F.when(F.col("digest").isNotNull(), F.xxhash64("digest")).otherwise(F.xxhash64("doc_id", "root"))
    placed = loose.withColumn("place", place).repartition(n, "place").drop("place")
    placed.mapInArrow(worker.task(_unique), _LOOSE).write.option("compression", "zstd").parquet(f"{path}/loose")

    recipes = spark.read.parquet(f"{path}/loose").where("digest is null").select("doc_id", "n_tokens", "digests", "lengths", "root")
    shards = recipes.repartitionByRange(n, "doc_id", "root").sortWithinPartitions("doc_id", "root", "n_tokens")
    shards.mapInArrow(_shards, "shard int, row long, local_start long, doc_id long, n_tokens long, digests array<binary>, lengths array<int>, root binary").write.option("compression", "zstd").parquet(f"{path}/recipes")

    found = _shard_roots(spark.read.parquet(f"{path}/recipes"), n)
    before = 0
    rows = []
    for r in sorted(found.collect(), key=lambda r: r.shard):  # as many rows as there are shards
        rows.append((r.shard, r.documents, r.ids, before, bytes(r.root)))
        before += r.ids
    spark.createDataFrame(rows, "shard int, documents long, ids long, first_id long, root binary").coalesce(1).write.parquet(f"{path}/manifest")
    return Store(path)


# ---- CRC-32 of a concatenation from the parts' CRCs (carry-less arithmetic modulo the CRC polynomial)

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC's, reflected bit order."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return product


def _tables() -> list[np.ndarray]:
    """For each k: four tables that multiply a CRC by x to the power 32 * 2**k (2**k ids of four bytes)."""
    power, out = 1 << 30, []  # x, in reflected order
    for _ in range(5):  # x ** 32
        power = _times(power, power)
    for _ in range(40):
        basis = [_times(1 << bit, power) for bit in range(32)]
        tables = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                step = 1 << bit
                tables[byte, step : 2 * step] = tables[byte, :step] ^ np.uint32(basis[8 * byte + bit])
        out.append(tables)
        power = _times(power, power)
    return out


_SHIFT: list[np.ndarray] = []


def shift_crc(crc: np.ndarray, ids_after: np.ndarray) -> np.ndarray:
    """What each part's CRC adds to the whole's when so many 4-byte ids follow it."""
    if not _SHIFT:
        _SHIFT.extend(_tables())
    crc, left = crc.astype(np.uint32), ids_after.astype(np.int64).copy()
    for tables in _SHIFT:
        if not left.any():
            break
        odd = (left & 1).astype(bool)
        x = crc[odd]
        crc[odd] = tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]
        left >>= 1
    return crc


def _verify_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, sizes, crcs = batch.column(0), batch.column(1).to_pylist(), []
        for name, n, ids in zip(listed(names), sizes, listed(batch.column(2))):
            if digest(ids) != name or len(ids) != 2 * n:
                raise ValueError(f"chunk {name.hex()} does not hold what its digest says")
            crcs.append(zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([names, batch.column(1), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per place of a chunk, with the ids that follow it in its document; roots are recomputed."""
    schema = pa.schema([("shard", pa.int32()), ("row", pa.int64()), ("digest", pa.binary()), ("length", pa.int32()), ("after", pa.int64())])
    for batch in batches:
        rows: dict[str, list] = {name: [] for name in schema.names}
        for shard, row, n, names, lengths, root in zip(*(c.to_pylist() for c in batch.columns)):
            if merkle_root(names) != root or sum(lengths) != n:
                raise ValueError(f"recipe {shard}/{row} does not match its Merkle root")
            after = n - np.cumsum(lengths)
            rows["shard"] += [shard] * len(names)
            rows["row"] += [row] * len(names)
            rows["digest"] += names
            rows["length"] += lengths
            rows["after"] += after.tolist()
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shard, row, length, after, n, crc = batch.columns
        if n.null_count or (n.to_numpy() != length.to_numpy()).any():
            raise ValueError("a recipe names a chunk that the store does not hold")
        moved = shift_crc(crc.to_numpy().astype(np.uint32), after.to_numpy())
        yield pa.RecordBatch.from_arrays([shard, row, length.cast(pa.int64()), pa.array(moved.astype(np.int64))], names=["shard", "row", "n", "moved"])


def read_checksums(spark: SparkSession, store: Store) -> DataFrame:
    """Follow every recipe through the stored chunks: one row per document.

    ``doc_id, start, n_tokens, ids_crc32, n_chunks, root``.  Only digests,
    lengths and checksums are shuffled: the checksum of a document is put
    together from its chunks' checksums, the chunks' bytes stay where they are.
    """
    chunks = materialize(store.chunks(spark).mapInArrow(worker.task(_verify_chunks), "digest binary, n int, crc long"), "content-store-chunks")
    recipes = store.recipes(spark)
    stated = {r["shard"]: (r["documents"], r["ids"], bytes(r["root"])) for r in store.manifest(spark).collect()}  # a row per shard
    present = {r["shard"]: (r["documents"], r["ids"], bytes(r["root"])) for r in _shard_roots(recipes, partitions_for(spark)).collect()}
    if stated != present:
        raise ValueError(f"the recipes do not match the manifest in shard {min(s for s in {*stated, *present} if stated.get(s) != present.get(s))}")
    references = recipes.select("shard", "row", "n_tokens", "digests", "lengths", "root").mapInArrow(_references, "shard int, row long, digest binary, length int, after long")
    # a chunk that many documents hold is a hot key
    found = spread_join(materialize(references, "content-store-references"), chunks, ["digest"], "left").select("shard", "row", "length", "after", "n", "crc")
    moved = found.mapInArrow(_shifted, "shard int, row long, n long, moved long")
    sums = moved.groupBy("shard", "row").agg(F.bit_xor("moved").alias("ids_crc32"), F.sum("n").alias("read"), F.count("*").alias("n_chunks"))
    first = F.broadcast(store.manifest(spark).select("shard", "first_id"))  # a row per shard
    slim = recipes.select("shard", "row", "doc_id", "local_start", "n_tokens", F.lower(F.hex("root")).alias("root"))
    out = slim.join(sums, ["shard", "row"], "left").join(first, "shard")
    whole = F.when(F.col("read") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document's chunks do not add up to it")).cast("long"))
    return out.select("doc_id", (F.col("first_id") + F.col("local_start")).alias("start"), whole.alias("n_tokens"), "ids_crc32", "n_chunks", "root")


def read_documents(spark: SparkSession, store: Store, doc_ids: DataFrame | None = None) -> DataFrame:
    """The stored ids themselves: ``doc_id, ids`` (little-endian unsigned 16-bit), for all or the given documents."""
    recipes = store.recipes(spark)
    if doc_ids is not None:
        recipes = recipes.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    places = recipes.select("shard", "row", "doc_id", F.posexplode("digests").alias("place", "digest"))
    parts = places.join(store.chunks(spark).select("digest", "ids"), "digest")
    gathered = parts.groupBy("shard", "row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "ids"))).alias("parts"))

    def joined(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(p["ids"] for p in parts) for parts in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return gathered.select("doc_id", "parts").mapInArrow(joined, "doc_id long, ids binary")

