"""Nearest neighbours by multi-index hashing.

Vectors become binary codes by learned rotations: iterative quantisation of the
principal axes, ``_WIDTH`` of them one after the other so that a code has more bits
than a vector components.  They are fitted on about ``sample_rows`` rows, those with
the smallest hashes of ``vec_id`` (the documented bound); every row is indexed.  A
code is split into m substrings, each indexed by its value.  If a code differs from
a query's in at most ``radius`` bits, one of its substrings differs in at most
``radius // m``, so probing each index with all values that near retrieves every
code within the radius.

Index rows (a code's substring number and value, the code, no vector) and probes meet
by shuffle on (substring number, value); buckets above ``block_rows`` rows are split
by hash and their probes repeated.  A pair that shares several buckets is reported by
the first of them alone.  The pairs within the radius are re-ranked by Euclidean
distance in double precision.

Each query has its radius: the one that should hold ``depth`` codes, read off its code
distances to the sample, but not more than the quantile ``coverage`` of the code
distances between sampled vectors and their true neighbours in the sample.  ``depth``
grows with the rows: how many codes stand before the true neighbours is measured on
the sample and on parts of it, and carried on as a power of the rows.  All are
probed with the widest of these.  Queries with fewer than a quarter of ``depth`` codes
within a radius below that quantile, or fewer than ``k`` within one above, are asked
again with a wider one.  So what is re-ranked grows with the queries, not with their
product with the rows.  Substrings
have 16 bits if that takes at most ``_MOST_VALUES`` probes a substring, else 8; the
result is the same.

Of equal vectors only those with the smallest ids can be among the nearest: of each,
``k + 1`` ids and ``k`` rows an id are indexed, so mass copies cost nothing.

Defined cases: vectors that are null, empty, zero, hold null or non-finite
components, have a null ``vec_id`` or another length than most take no part;
ties go to the smaller ``vec_id``; rows that repeat a ``vec_id`` are candidates
each, but none of them for a query of that id, and such a query is asked once; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privaudit.llm.storage import about, materialize

#: Rotations, and code bits at most.
_WIDTH, _MOST_BITS = 4, 256
_MOST_VALUES = 1000
#: Probes of a bucket handled by one task at a time.
_PROBES = 65_536


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the vectors that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and size(embedding) > 0").where(finite & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (lengths[0]["d"] if lengths else 0))


class Codes:
    """The rotations, and codes as rows of bytes."""

    def __init__(self, sample: np.ndarray, iterations: int = 30, seed: int = 11):
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        d = sample.shape[1]
        _, _, axes = np.linalg.svd(centred, full_matrices=True)
        kept = min(d, _MOST_BITS)
        basis, rng, parts = axes.T[:, :kept], np.random.default_rng(seed), []
        projected = centred @ basis
        while sum(p.shape[1] for p in parts) < max(16, min(_MOST_BITS, _WIDTH * d) // 16 * 16):
            rotation, _ = np.linalg.qr(rng.normal(size=(kept, kept)))
            for _ in range(iterations):
                signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
                u, _, vt = np.linalg.svd(signs.T @ projected)
                rotation = (u @ vt).T
            parts.append(basis @ rotation)
        self.bits = max(16, min(_MOST_BITS, _WIDTH * d) // 16 * 16)
        self.matrix = np.hstack(parts)[:, : self.bits]

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.matrix >= 0, axis=1)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=-1, dtype=np.int64)


def depth_of(codes: Codes, sample: np.ndarray, n: int, k: int, recall: float, queries: int = 200) -> int:
    """How many of ``n`` codes stand at most as far from a query as the share ``recall`` of its k nearest, carried on from parts of the sample."""
    coded, points = codes(sample), []
    asked = range(0, len(sample), max(1, len(sample) // queries))
    for size in (len(sample) // 8, len(sample) // 4, len(sample) // 2, len(sample)):
        if size <= 4 * k:
            continue
        ranks = []
        for q in asked:
            part = np.arange(q % (len(sample) // size), len(sample), len(sample) // size)  # the query is one of them or not
            part = part[part != q]
            d = ((sample[part] - sample[q]) ** 2).sum(axis=1)
            apart = distances(coded[part], coded[q])
            near = apart[np.argpartition(d, k)[:k]]
            ranks += np.searchsorted(np.sort(apart), near, "right").tolist()
        points.append((len(part), np.quantile(ranks, recall)))
    if not points:
        return n
    sizes, depths = np.array(points).T
    power = float(np.clip(np.polyfit(np.log(sizes), np.log(depths), 1)[0], 0.5, 1.0)) if len(points) > 1 else 1.0
    return int(min(n, np.ceil(depths[-1] * max(1.0, n / sizes[-1]) ** power)))


def learn(sample: np.ndarray, k: int, coverage: float, queries: int = 300) -> tuple[Codes, int]:
    """The codes and the radius that holds the share ``coverage`` of true neighbours in the sample."""
    codes = Codes(sample)
    coded, apart = codes(sample), []
    norms = (sample**2).sum(axis=1)
    for q in range(min(queries, len(sample))):
        d = norms - 2 * (sample @ sample[q])
        d[q] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        apart += distances(coded[near], coded[q]).tolist()
    return codes, int(np.quantile(apart, coverage, method="higher")) if apart else codes.bits


def radii(coded: np.ndarray, sample: np.ndarray, share: float, most: int) -> np.ndarray:
    """For each code the radius that holds about ``share`` of all codes, judged by the sample's; ``most`` at most."""
    out = np.empty(len(coded), np.int64)
    for i, code in enumerate(coded):
        apart = np.sort(distances(sample, code))
        place = share * len(apart)
        # below the sample's resolution its nearest counts; a wider radius follows where that is too little
        out[i] = apart[min(len(apart) - 1, int(np.ceil(place)))]
    return np.minimum(out, most)


def substring_bits(bits: int, radius: int) -> int:
    """16 where few values need probing, else 8."""
    return 16 if len(near_values(16, radius // (bits // 16))) <= _MOST_VALUES else 8


def near_values(bits: int, radius: int) -> np.ndarray:
    """All differences of at most ``radius`` bits, ``_MOST_VALUES + 1`` at most for 16 bits."""
    found: list[int] = []
    for r in range(min(radius, bits) + 1):
        found += [sum(1 << p for p in c) for c in combinations(range(bits), r)]
        if bits == 16 and len(found) > _MOST_VALUES:
            break
    return np.array(found, np.int64)


def substrings(codes: np.ndarray, bits: int) -> np.ndarray:
    """Values [rows, m] of the codes' substrings."""
    return codes if bits == 8 else np.ascontiguousarray(codes).view(np.uint16)


def within(index: np.ndarray, probes: np.ndarray, own: np.ndarray, table: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and probes within the probes' own radii whose first substring that is near at ``radius`` is ``table``."""
    far = np.bitwise_count(index.view(np.uint64)[None] ^ probes.view(np.uint64)[:, None]) if index.shape[1] % 8 == 0 else np.bitwise_count(index[None] ^ probes[:, None])
    p, i = np.nonzero(far.sum(axis=2, dtype=np.int64) <= own[:, None])
    apart = np.bitwise_count(substrings(index[i], bits) ^ substrings(probes[p], bits))
    first = (apart <= radius // apart.shape[1]).argmax(axis=1) if len(i) else np.zeros(0, np.int64)
    return i[first == table], p[first == table]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bytes(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def _coded(rows: DataFrame, codes: Codes, sample: np.ndarray | None = None, share: float = 1.0, most: int = 0) -> DataFrame:
    """``rows`` and their codes; with a sample's codes also their radii."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = codes(_matrix(batch.column("embedding"))) if batch.num_rows else np.zeros((0, codes.bits // 8), np.uint8)
            more = [pa.array([r.tobytes() for r in found], pa.binary())] + ([pa.array(radii(found, sample, share, most))] if sample is not None else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "code", "radius"][: batch.num_columns + len(more)])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", code binary" + ", radius long" * (sample is not None))


def probe(index: DataFrame, asked: DataFrame, bits: int, radius: int, block_rows: int = 8192) -> DataFrame:
    """``query_id, number``: every code of ``index`` (``number, vec_id, code``) within its radius of one of ``asked`` (``vec_id, code, radius``), once.

    ``radius``: the widest of theirs.
    """
    size = bits // 8
    width = substring_bits(bits, radius)
    near = near_values(width, radius // (bits // width))
    kind = "smallint" if width == 8 else "int"

    def keyed(values: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    found = substrings(_bytes(batch.column("code"), size), width).astype(np.int64)
                    if values is not None:
                        found = found[:, :, None] ^ values
                    n, m = found.shape[:2]
                    each = found.size // n
                    picked = batch.take(pa.array(np.repeat(np.arange(n), each)))
                    table = np.tile(np.repeat(np.arange(m), each // m), n)
                    yield pa.RecordBatch.from_arrays([pa.array(table, pa.int16()), pa.array(found.ravel(), pa.int16() if width == 8 else pa.int32()), *picked.columns], names=["table", "value", *batch.schema.names])

        return run

    indexed = index.select("number", "vec_id", "code").mapInArrow(keyed(None), f"table smallint, value {kind}, number long, vec_id long, code binary")
    probes = asked.select(F.col("vec_id").alias("query_id"), "code", F.col("radius").cast("long").alias("radius")).mapInArrow(keyed(near), f"table smallint, value {kind}, query_id long, code binary, radius long")
    # large buckets and much-asked values are split; there are few of either
    parts = lambda df, name, most: df.groupBy("table", "value").count().where(F.col("count") > most).select("table", "value", F.ceil(F.col("count") / most).cast("int").alias(name))
    rows, calls = materialize(parts(indexed, "n_rows", block_rows), "index-large"), materialize(parts(probes, "n_calls", _PROBES), "index-asked")
    sizes = [d.count() for d in (rows, calls)]
    with_parts = lambda df: df.join(F.broadcast(rows) if sizes[0] <= _PROBES else rows, ["table", "value"], "left").join(F.broadcast(calls) if sizes[1] <= _PROBES else calls, ["table", "value"], "left").fillna(1, ["n_rows", "n_calls"])
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    if any(sizes):
        indexed = with_parts(indexed).withColumn("r", part("number", "n_rows")).select("*", every("n_calls").alias("c"))
        probes = with_parts(probes).withColumn("c", part("query_id", "n_calls")).select("*", every("n_rows").alias("r"))
    else:
        indexed, probes = (d.withColumns({"r": F.lit(0), "c": F.lit(0)}) for d in (indexed, probes))
    keys = ["table", "value", "r", "c"]
    schema = pa.schema([("query_id", pa.int64()), ("number", pa.int64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            table = left["table"][0].as_py()
            codes, numbers, ids = _bytes(left["code"], size), left["number"].to_numpy(), left["vec_id"].to_numpy()
            asking, queries, own = _bytes(right["code"], size), right["query_id"].to_numpy(), right["radius"].to_numpy()
            step = max(1, (1 << 21) // len(codes))
            for at in range(0, len(queries), step):
                i, p = within(codes, asking[at : at + step], own[at : at + step], table, width, radius)
                other = ids[i] != queries[at + p]
                out.append((queries[at + p[other]], numbers[i[other]]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    found = indexed.select(*keys, "number", "vec_id", "code").groupBy(*keys).cogroup(probes.select(*keys, "query_id", "code", "radius").groupBy(*keys))
    return found.applyInArrow(compare, "query_id long, number long")


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (_matrix(batch.column(k)) for k in ("asking", "embedding")) if batch.num_rows else (np.zeros((0, 1)), np.zeros((0, 1)))
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(np.sqrt(((a - b) ** 2).sum(axis=1)))], names=["query_id", "vec_id", "score"])


def search(embeddings: DataFrame, is_query: Column, k: int = 10, sample_rows: int = 4096, coverage: float = 0.98, depth: int = 800, recall: float = 0.95, block_rows: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query row.

    ``recall``: the share of true neighbours that the radii should hold; ``depth``: the codes they hold at least.
    """
    spark = embeddings.sparkSession
    rows = materialize(usable(embeddings), "index-rows")
    sample = sorted(about(rows, sample_rows, "vec_id").limit(2 * sample_rows).collect(), key=lambda r: r["vec_id"])  # a documented bound
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = np.array([r["embedding"] for r in sample])
    codes, most = learn(vectors, k, coverage)
    # of equal vectors only the smallest ids matter
    place = F.row_number().over(Window.partitionBy("embedding", "vec_id").orderBy("vec_id"))
    some = rows.withColumn("place", place).where(F.col("place") <= k).drop("place")
    place = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    some = some.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    index = materialize(_coded(some.select("vec_id", "embedding"), codes).withColumn("number", F.monotonically_increasing_id()), "index")
    n = index.count()
    depth = max(depth, depth_of(codes, vectors, n, k, recall))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = pending = materialize(_coded(asked, codes, codes(vectors), depth / max(1, n), most), "index-queries")

    pairs = None
    while True:
        radius = pending.agg(F.coalesce(F.max("radius"), F.lit(0))).first()[0]
        found = materialize(probe(index, pending, codes.bits, radius, block_rows), "index-pairs")
        # k codes are enough within the neighbours' radius
        wanted = F.when(F.col("radius") >= most, F.lit(min(n, k))).otherwise(F.lit(min(n, max(k, depth // 4))))
        counts = found.groupBy(F.col("query_id").alias("vec_id")).count()
        few = pending.join(counts, "vec_id", "left").where((F.coalesce("count", F.lit(0)) < wanted) & (F.col("radius") < codes.bits)).drop("count")
        few = materialize(few.withColumn("radius", F.least(F.col("radius") + codes.bits // 16, F.lit(codes.bits))), "index-few")
        last = few.isEmpty()
        done = found if last else found.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
        pairs = done if pairs is None else pairs.union(done)
        if last:
            break
        pending = few

    near = pairs.join(index.select("number", "vec_id", "embedding"), "number").join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asking")), "query_id")
    scored = near.select("query_id", "vec_id", "embedding", "asking").mapInArrow(_scores, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return scored.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
