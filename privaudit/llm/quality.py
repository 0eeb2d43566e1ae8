"""Quality classifier by importance resampling.

Hashed n-gram models describe target text (labelled good and not toxic) and raw
text (all documents).  A document's log importance weight is the ratio of its
probability under target and raw text; Gumbel noise is added and the k largest
sums stay, which samples k documents without replacement in proportion to their
weights.

* Words and beginnings: a word's core (without outer signs, lower case) is an
  n-gram, and so are its first 5, 6 and 7 characters, each seen at least once, at
  least twice and at least four times in the document, so that a family of words
  counts though each of them is rare.  All are hashed to ``_BUCKETS`` and counted by
  the documents they stand in.  The target's expected count follows from all
  documents and from the labelled ones, whichever gives less, so that a group of
  copies does not speak for itself.  A bucket's log ratio of shown to expected
  count, smoothed by one, moves towards zero by ``_ERRORS`` of its standard error;
  all buckets count, the well-established ones in full.
* Shapes: bigrams of a word's case, trailing signs, letters or others, and whether
  it repeats the word before, by occurrence; the target's counts are smoothed
  towards the raw counts (``_PRIOR`` occurrences).

Raw text holds target text with the share seen in the labels, so no ratio exceeds
the inverse of that share: what speaks for a document is cut there, for both
models, and does not outweigh what speaks against it.

``k`` is, unless given, the expected number of documents whose weight with noise
exceeds ``exp(threshold)``.  Noise depends on ``doc_id`` and ``seed`` only.

Labels: about ``label_rows`` rows, those with the smallest hashes of ``doc_id``, are
used (a documented bound); everything else is counted over all documents.

Defined cases: null and empty texts have weight one; without usable labels every
weight is one; rows that repeat a ``doc_id`` are judged each, with one noise; a
null ``doc_id`` has the noise of its own; keys equal to the k-th stay as well; an
empty table gives an empty result; further columns are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.llm import worker
from privaudit.llm.storage import about, materialize
from privaudit.llm.tokens import listed

_BITS = 22
_BUCKETS = 1 << _BITS
_SHAPES = 72
_BIGRAMS = (_SHAPES + 1) * (_SHAPES + 1)
_PRIOR, _ERRORS = 4.0, 1.0
_BEGINNINGS, _TIMES = (5, 6, 7), (1, 2, 4)
_SIGNS = b".,;:!?#%&*$|\"'()[]{}<>-_=+/\\"
_ROWS = 1000
#: Counting tasks a core.
_TASKS = 8

_KNOWN: dict[str, tuple[int, ...]] = {}
worker.keeps("words", _KNOWN.clear)


def _word(word: str) -> tuple[int, ...]:
    """The hash of a word's core, its shape without the repeat mark, and the hashes of its beginnings (or -1)."""
    raw = word.encode("utf-8", "surrogatepass")
    core = raw.strip(_SIGNS)
    tail = len(raw) - len(raw.rstrip(_SIGNS))
    case = 0 if word.islower() else 1 if word.isupper() and len(word) > 1 else 2
    other = not (core.isalpha() or core[:1] >= b"\x80")
    low = core.lower()
    if core.isascii():
        n = len(low)
        begins = (crc32(low[:5], 5) if n > 5 else -1, crc32(low[:6], 6) if n > 6 else -1, crc32(low[:7], 7) if n > 7 else -1)
    else:
        letters = low.decode("utf-8", "surrogatepass")
        begins = tuple(crc32(letters[:k].encode("utf-8", "surrogatepass"), k) if len(letters) > k else -1 for k in _BEGINNINGS)
    return crc32(low), case + 3 * min(tail, 2) + 9 * (not core) + 36 * other, *begins


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of all texts: the text's index, the hashes of core and beginnings, the shape bigram."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(parts.values)
    distinct = listed(coded.dictionary)
    if len(_KNOWN) > 150_000:
        _KNOWN.clear()
    found = list(map(_KNOWN.get, distinct))
    for i in [i for i, known in enumerate(found) if known is None]:
        found[i] = _word(distinct[i])
        if len(distinct[i]) < 40:
            _KNOWN[distinct[i]] = found[i]
    table = np.array(found or [(0,) * (2 + len(_BEGINNINGS))], np.int64)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    index = coded.indices.to_numpy(zero_copy_only=False)
    present = np.array([w != "" for w in distinct] or [False], bool)[index] if len(index) else np.zeros(0, bool)
    owner, index = owner[present], index[present]
    core, shape = table[index, 0], table[index, 1]
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    shape[1:] += 18 * ((core[1:] == core[:-1]) & ~first[1:])
    before = np.empty_like(shape)
    before[1:] = shape[:-1]
    before[first] = _SHAPES
    return owner, np.column_stack([core, table[index, 2:]]), before * (_SHAPES + 1) + shape


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different values and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def buckets(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's n-grams, once each: the text's index and the bucket."""
    base = owner << _BITS
    found = [_distinct(base | hashes[:, 0] & _BUCKETS - 1)[0]]
    known = hashes[:, 1:] >= 0
    begins, times = _distinct((base[:, None] | hashes[:, 1:] & _BUCKETS - 1)[known])
    for n in _TIMES:  # another bucket for each number of times
        some = begins[times >= n]
        found.append(some >> _BITS << _BITS | (some & _BUCKETS - 1) * 40_503 + n * 7_368_787 & _BUCKETS - 1)
    both = _distinct(np.concatenate(found))[0]
    return both >> _BITS, both & _BUCKETS - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shape bigrams (raw, target) by occurrence; n-gram buckets (raw, labelled, target) by document."""
    shapes, words, rows = np.zeros((2, _BIGRAMS), np.int64), np.zeros((3, _BUCKETS), np.int32), np.zeros(3, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            label = part.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            owner, hashes, bigram = features(part.column(0))
            shapes[0] += np.bincount(bigram, minlength=_BIGRAMS)
            shapes[1] += np.bincount(bigram[label[owner] == 1], minlength=_BIGRAMS)
            owner, bucket = buckets(owner, hashes)
            for k, some in enumerate((bucket, bucket[label[owner] >= 0], bucket[label[owner] == 1])):
                seen, times = _distinct(some)
                words[k][seen] += times.astype(np.int32)
            rows += [len(label), int((label >= 0).sum()), int((label == 1).sum())]
    seen, used = np.flatnonzero(shapes[0]), np.flatnonzero(words[0])
    none = np.zeros(len(seen), np.int64)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([np.zeros(len(seen), np.int32), np.ones(len(used), np.int32), [2]]).astype(np.int32)),
            pa.array(np.concatenate([seen, used, [0]]).astype(np.int32)),
            pa.array(np.concatenate([shapes[0][seen], words[0][used], rows[:1]]).astype(np.int64)),
            pa.array(np.concatenate([none, words[1][used], rows[1:2]]).astype(np.int64)),
            pa.array(np.concatenate([shapes[1][seen], words[2][used], rows[2:]]).astype(np.int64)),
        ],
        names=["family", "bucket", "raw", "labelled", "target"],
    )


class Model:
    """Log ratios of shape bigrams and of n-gram buckets (in ascending order), and the share of target text."""

    def __init__(self, shapes: np.ndarray, buckets: np.ndarray, ratios: np.ndarray, share: float):
        self.shapes, self.buckets, self.ratios, self.share = shapes, buckets, ratios, share

    def dense(self) -> np.ndarray:
        if not hasattr(self, "_dense"):
            self._dense = np.zeros(_BUCKETS, np.float32)
            self._dense[self.buckets] = self.ratios
        return self._dense

    def weights(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and log importance weight of each text."""
        most = -math.log(self.share)
        owner, hashes, bigram = features(texts)
        n = np.bincount(owner, minlength=len(texts))
        weight = np.minimum(np.bincount(owner, self.shapes[bigram], len(texts)), most)
        if len(self.buckets):
            owner, bucket = buckets(owner, hashes)
            ratio = self.dense()[bucket].astype(np.float64)
            weight += np.minimum(np.bincount(owner, np.maximum(ratio, 0), len(texts)), most) + np.bincount(owner, np.minimum(ratio, 0), len(texts))
        return n, weight


def fit(documents: DataFrame, labels: DataFrame, label_rows: int = 50_000) -> Model:
    """Count the models over all documents; see the module's description."""
    spark = documents.sparkSession
    usable = labels.where("doc_id is not null and quality is not null")
    by_doc = usable.groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("label"))
    sample = materialize(about(materialize(by_doc, "quality-labels"), label_rows, "labelled_id"), "quality-sample")
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    labelled = rows.join(F.broadcast(sample), F.col("id") == F.col("labelled_id"), "left").select("text", "label")  # about label_rows rows at most
    # a task emits a row for each bucket it has seen: few large tasks, so that the counts stay small beside the texts
    counts = labelled.coalesce(_TASKS * spark.sparkContext.defaultParallelism).mapInArrow(worker.task(_count, "words"), "family int, bucket int, raw long, labelled long, target long")
    counts = materialize(counts.groupBy("family", "bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "labelled", "target"))), "quality-counts")
    sums = {r["family"]: r for r in counts.groupBy("family").agg(*(F.sum(c).alias(c) for c in ("raw", "labelled", "target"))).collect()}
    shapes = np.zeros(_BIGRAMS)
    if 0 not in sums or not sums[2]["target"] or not sums[0]["target"]:
        return Model(shapes, np.zeros(0, np.int64), np.zeros(0, np.float32), 1.0)
    scale = sums[0]["target"] / sums[0]["raw"]
    for r in counts.where("family = 0").collect():  # at most _BIGRAMS rows
        shapes[r["bucket"]] = math.log((r["target"] + _PRIOR) / (r["raw"] * scale + _PRIOR))
    n = sums[2]
    expected = F.least(F.col("raw") * F.lit(n["target"] / n["raw"]), F.col("labelled") * F.lit(n["target"] / n["labelled"]))
    shown, e = F.col("target") + F.lit(1.0), F.col("expected") + F.lit(1.0)
    ratio, error = F.log(shown / e), F.sqrt(1 / shown + 1 / e)
    sure = F.signum(ratio) * F.greatest(F.abs(ratio) - F.lit(_ERRORS) * error, F.lit(0.0))
    found = counts.where("family = 1").select("bucket", "target", expected.alias("expected")).select("bucket", sure.alias("ratio")).where("ratio <> 0")
    found = found.select("bucket", F.col("ratio").cast("float").alias("ratio")).toArrow()  # at most _BUCKETS rows of eight bytes
    buckets, ratios = (found.column(c).to_numpy() for c in ("bucket", "ratio"))
    order = np.argsort(buckets)
    return Model(shapes, buckets[order], ratios[order], n["target"] / n["labelled"])


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles."""
    bits = x.astype(np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _score(model: Model, seed: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                n, weight = model.weights(part.column(1))
                u = np.array([xxh64_intdigest(str(i), seed) >> 11 for i in part.column(0).to_pylist()], np.float64)
                key = weight - np.log(-np.log((u + 0.5) / (1 << 53)))
                chance = -np.expm1(-np.exp(np.minimum(weight - threshold, 50.0)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n.astype(np.int64)), pa.array(weight), pa.array(key), pa.array(ordered_bits(key)), pa.array(chance)], names=[*batch.schema.names, "n_words", "log_weight", "key", "bits", "chance"])

    return run


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a 64-bit column by four counting passes of 65,536 digits; None if there are fewer."""
    value, low = F.col(column), None
    for shift in (48, 32, 16, 0):
        part = df if low is None else df.where(F.shiftright(value, shift + 16) == low)
        digits = sorted(part.groupBy(F.shiftright(value, shift).alias("digit")).count().collect(), key=lambda r: -r["digit"])
        for r in digits:
            if k <= r["count"]:
                low = r["digit"]
                break
            k -= r["count"]
        else:
            return None
    return low


def resample(documents: DataFrame, labels: DataFrame, k: int | None = None, threshold: float = -3.0, seed: int = 7, label_rows: int = 50_000, rows: bool = False) -> DataFrame:
    """The k documents with the largest weight and noise.

    ``doc_id, n_words, log_weight, key``; with ``rows``, the chosen rows of
    ``documents`` with all their columns instead.
    """
    model = fit(documents, labels, label_rows)
    inputs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*(documents[f"`{c}`"] for c in documents.columns if c != "text")).alias("row")] if rows else []))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields)
    scored = inputs.mapInArrow(worker.task(_score(model, seed, threshold), "words"), f"{kinds}, n_words long, log_weight double, key double, bits long, chance double")
    scored = materialize(scored if rows else scored.drop("text"), "quality-scores")
    if k is None:
        k = round(scored.agg(F.coalesce(F.sum("chance"), F.lit(0.0))).first()[0])
    least = kth_largest(scored.select("bits"), "bits", k) if k > 0 else None
    kept = scored if least is None and k > 0 else scored.where(F.col("bits") >= F.lit(least)) if k > 0 else scored.limit(0)
    if rows:
        return kept.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns))
    return kept.select("doc_id", "n_words", "log_weight", "key")
