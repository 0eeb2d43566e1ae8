"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case (A-Z) words joined by single spaces.  Every
run of ``window`` consecutive words of a benchmark item, or the whole item if it
has fewer words, is a pattern; one automaton of all patterns scans each document
once.  A document word inside any occurrence of a pattern is hit; the hits' spans
are mapped back to byte offsets of the original text.

The patterns are cut and made distinct by Spark.  A pattern stands for the list of its
items, and the automaton knows the list's number only: a window that many items share
costs no more than another.  Different sets of lists are resolved once each, by joins,
and given to the documents that hit them.

Patterns are dealt by hash to blocks of about ``_PATTERN_BYTES``; an automaton takes some
44 bytes of memory for each, so a task needs about 180 MB whatever the benchmark's size.
The driver takes one block at a time and ships it to the tasks.  Of several blocks each
reads the documents once and writes the hits alone.

Defined cases: a null text or item has no words; an item without words makes no
pattern; repeated items count once by ``item_id``; a null ``item_id`` makes its
document contaminated but is not listed; an empty benchmark hits nothing;
repeated documents each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.llm import worker
from privaudit.llm.storage import materialize, spread_join

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Byte for byte: word bytes stay (A-Z lower-cased), all others become a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PATTERN_BYTES = 4 << 20


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Each different pattern, the ids of the items it stands in, as sorted strings without nulls, and the number of that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids = [], []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                for at in range(max(1, len(w) - window + 1) if w else 0):
                    found.append(b" " + b" ".join(w[at : at + window]) + b" ")
                    ids.append(item_id)
                if len(found) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(ids, pa.string())], names=["pattern", "item"])
                    found, ids = [], []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(ids, pa.string())], names=["pattern", "item"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "pattern binary, item string").groupBy("pattern").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.withColumn("list", F.xxhash64("items"))


def blocks(found: DataFrame, most: int) -> list[DataFrame]:
    """The patterns (``windows``, a written table) in blocks of about ``most`` bytes; one block if there is none."""
    size = found.agg(F.coalesce(F.sum(F.octet_length("pattern") + F.lit(50)), F.lit(0))).first()[0]
    n = max(1, -(-size // most))
    return [found.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == k).select("pattern", "list") for k in range(n)]


class Block:
    """One block's patterns and their lists' numbers, as they go to the tasks."""

    def __init__(self, rows: DataFrame):
        self.patterns = sorted((bytes(r["pattern"]), r["list"]) for r in rows.collect())  # about the bytes of a block
        self.key = uuid.uuid4().hex

    def automaton(self):
        """This worker's automaton; the last one is kept, none for an empty block."""
        import ahocorasick

        if self.key not in _AUTOMATA:
            made = ahocorasick.Automaton()
            for pattern, number in self.patterns:
                # latin-1 makes one character of each byte, so offsets are byte offsets
                made.add_word(pattern.decode("latin-1"), (len(pattern), number))
            if self.patterns:
                made.make_automaton()
            _AUTOMATA.clear()
            _AUTOMATA[self.key] = made if self.patterns else None
        return _AUTOMATA[self.key]


_AUTOMATA: dict[str, object] = {}
worker.keeps("automata", _AUTOMATA.clear)


def scan(automaton, normal: bytes) -> tuple[list[tuple[int, int]], set]:
    """Hit word ranges [first, last] (merged, in order) and the lists' numbers of a normalised text with outer spaces."""
    matches, lists = [], set()
    for end, (length, number) in automaton.iter(normal.decode("latin-1")):
        matches.append((end - length + 1, end))
        lists.add(number)
    if not matches:
        return [], lists
    matches.sort()
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    first = np.searchsorted(spaces, [a for a, _ in matches])
    last = np.searchsorted(spaces, [b for _, b in matches]) - 1
    merged: list[list[int]] = []
    for a, b in zip(first.tolist(), last.tolist()):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged], lists


_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


_LISTS = pa.list_(pa.int64())
_JUDGED = "doc_id long, n_words long, n_hit long, contaminated boolean, spans array<struct<start:int,end:int>>, lists array<long>"


def _hits(block: Block):
    """``row, hits, lists`` of the documents (``row, text``) that one block hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = block.automaton()
        for batch in batches:
            found = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                normal = words(text.as_py()) if automaton is not None else []
                ranges, lists = scan(automaton, b" " + b" ".join(normal) + b" ") if normal else ([], ())
                if ranges:
                    found.append((row, [{"start": a, "end": b} for a, b in ranges], sorted(lists)))
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), _HITS, _LISTS))], names=["row", "hits", "lists"])

    return run


def _judged(block: Block | None):
    """Words, hit words and spans of ``doc_id, text``, by the only block or by the ``hits`` and ``lists`` found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = block.automaton() if block else None
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                normal = raw.translate(_NORMAL).split()
                if block:
                    ranges, lists = scan(automaton, b" " + b" ".join(normal) + b" ") if normal and automaton is not None else ([], ())
                else:
                    ranges, lists = [(h["start"], h["end"]) for h in batch.column(2)[i].as_py() or ()], batch.column(3)[i].as_py() or ()
                inside = np.zeros(len(normal), bool)
                for a, b in ranges:
                    inside[a : b + 1] = True
                spans = []
                if ranges:
                    at = [(m.start(), m.end()) for m in WORD.finditer(raw.lower())]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
                    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in edges.reshape(-1, 2)]
                rows.append((len(normal), int(inside.sum()), bool(ranges), spans, sorted(lists)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.bool_(), _HITS, _LISTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_words", "n_hit", "contaminated", "spans", "lists"])

    return run


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, pattern_bytes: int = _PATTERN_BYTES) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows, and the hit spans as byte offsets of the original text."""
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    found = materialize(windows(benchmark, window), "decontamination-windows")
    parts = blocks(found, pattern_bytes)
    if len(parts) == 1:
        judged = docs.mapInArrow(worker.task(_judged(Block(parts[0])), "automata"), _JUDGED)
    else:
        docs, hits = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "decontamination-documents"), None
        for part in parts:
            own = materialize(docs.select("row", "text").mapInArrow(worker.task(_hits(Block(part)), "automata"), "row long, hits array<struct<start:int,end:int>>, lists array<long>"), "decontamination-hits")
            hits = own if hits is None else hits.union(own)
        merged = hits.groupBy("row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "lists")))  # a row a block at most
        merged = merged.withColumn("lists", F.array_distinct("lists"))
        judged = docs.join(merged, "row", "left").select("doc_id", "text", "hits", "lists").mapInArrow(worker.task(_judged(None)), _JUDGED)
    judged = materialize(judged.withColumn("set", F.array_join(F.col("lists").cast("array<string>"), ",")), "decontamination-judged")
    # each different set of lists is resolved once
    lists = found.groupBy("list").agg(F.first("items").alias("items"))
    sets = judged.where("contaminated").select("set", "lists").distinct().select("set", F.explode("lists").alias("list"))
    named = sets.join(lists, "list").groupBy("set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    named = materialize(named.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "decontamination-sets")
    out = spread_join(judged, named, ["set"], "left")
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), "contaminated", "spans")


def clean(documents: DataFrame, benchmark: DataFrame, window: int = 10, pattern_bytes: int = _PATTERN_BYTES) -> DataFrame:
    """The rows of ``documents``, with all their columns, in which no window occurs.

    Judges each row where it is: no join, so repeated and null ids keep their own decision.
    """
    for k, part in enumerate(blocks(materialize(windows(benchmark, window), "decontamination-windows"), pattern_bytes)):
        documents = (materialize(documents, "decontamination-clean") if k else documents).mapInArrow(worker.task(_untouched(Block(part)), "automata"), documents.schema)
    return documents


def _untouched(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = block.automaton()
        for batch in batches:
            keep = []
            for text in batch.column(batch.schema.get_field_index("text")):
                normal = words(text.as_py()) if automaton is not None else []
                found = normal and next(automaton.iter((b" " + b" ".join(normal) + b" ").decode("latin-1")), None)
                keep.append(not found)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
