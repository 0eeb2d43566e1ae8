"""Source divergence audit by count cells.

How far do a language's sources lie apart, and by which terms?  Each (lang, source)
group and each lang gives every kept term a smoothed share ``p`` in whole billionths;
``f = floor((p - q)^2 / q)`` compares two shares.  All arithmetic is on whole numbers.

``f`` hangs on a term's counts alone, so terms are grouped into count cells:

* ``term``: cells of (group count, lang count).  ``f`` is evaluated once a cell, cells
  of equal value are merged and ranked by the multiplicity before them, and only cells
  that reach into the ranks asked for are expanded to terms, in UTF-8 order.
* ``pair``: cells of (count here, count there) of the terms that both sources have.
  Terms that only one or neither has enter through the sources' own count histograms:
  the sum over all kept terms of f(a, b) is the sum over common terms of
  f(a, b) - f(a, 0) - f(0, b) + f(0, 0), over one side's terms of f(a, 0) - f(0, 0), over
  the other's of f(0, b) - f(0, 0), and f(0, 0) for each kept term.

Texts are counted inside the tasks; what is shuffled are counts.  A group's cells never
meet in one task: the ranks are cut by bounded top lists (a list of the best 200 values
a task), and a hot cell's terms are spread.

Defined cases: null text, lang and source are ''; rows count as documents, repeated ids
included; a group without terms has its pairs (value 0 where no term is kept) and no
terms; a lang with one source has no pairs; ties go to the smaller item in UTF-8; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privaudit.llm.storage import materialize, spread_join
from privaudit.llm.tokens import slices

#: Byte for byte: letters and bytes above 127 stay (A-Z lower-cased), all others become a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a ``large_string`` array without nulls, in order, and the number of each text they come from."""
    raw = texts.buffers()
    edges = np.frombuffer(raw[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = memoryview(raw[2] or b"")[edges[0] : edges[-1]].tobytes().translate(_TERMS)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(edges - edges[0]), pa.py_buffer(data))
    parts = pc.ascii_split_whitespace(plain)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    terms = pc.list_flatten(parts)
    full = pc.greater(pc.binary_length(terms), 0)
    return terms.filter(full), row[full.to_numpy(zero_copy_only=False)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each part of a batch; a row without a term says that the group occurs."""
    for whole in batches:
        for batch in slices(whole, 0):
            texts = pc.fill_null(batch.column(0).cast(pa.large_string()), "")
            names = [pc.dictionary_encode(pc.fill_null(batch.column(k), "")) for k in (1, 2)]
            langs, sources = (n.dictionary for n in names)
            pair = names[0].indices.to_numpy().astype(np.int64) * len(sources) + names[1].indices.to_numpy()
            groups, group = np.unique(pair, return_inverse=True)
            terms, row = split_terms(texts)
            coded = pc.dictionary_encode(terms)
            size, code = max(1, len(coded.dictionary)), coded.indices.to_numpy().astype(np.int64)
            keys, n = np.unique(group[row] * size + code, return_counts=True)
            once = np.unique(row * size + code)
            docs = np.unique(group[once // size] * size + once % size, return_counts=True)[1]
            at = np.concatenate([groups[keys // size], groups])
            term = pa.concat_arrays([pc.take(coded.dictionary, pa.array(keys % size)).cast(pa.string()), pa.nulls(len(groups), pa.string())])
            zero = np.zeros(len(groups), np.int64)
            columns = [pc.take(langs, pa.array(at // len(sources))), pc.take(sources, pa.array(at % len(sources))), term, pa.array(np.concatenate([n, zero])), pa.array(np.concatenate([docs, zero]))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(documents: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group; a null term for the group itself."""
    rows = documents.select(*(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    return rows.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, kept: str, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / (total + kept)); decimals, since counts of a large corpus exceed a long here."""
    whole = lambda c: f"cast({c} as decimal(20,0))"
    return F.expr(f"1 + cast({scale} as decimal(12,0)) * {whole(f'{n} + 1')} div {whole(f'{total} + {kept}')}")


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """The counts of one table of documents, written, and what is read from them."""

    def __init__(self, documents: DataFrame, least_docs: int = 3, scale: int = 1_000_000_000):
        self.scale = scale
        counts = materialize(term_counts(documents), "divergence-counts")
        known = counts.where("term is not null")
        kept = known.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
        #: ``lang, source, term, n, total`` of the kept terms that a group has.
        self.rows = materialize(known.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-terms")
        #: ``lang, source, n, total`` and the number ``m`` of terms with these counts.
        self.cells = materialize(self.rows.groupBy("lang", "source", "n", "total").agg(F.count("*").alias("m")), "divergence-cells")
        sizes = self.cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("size"))
        # a term is in the rows once for each source that has it: its first source stands for it
        langs = self.rows.groupBy("lang", "term").agg(F.max("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_size"))
        groups = counts.where("term is null").select("lang", "source")
        #: ``lang, source, size, v, lang_size`` of each group that occurs.
        self.groups = materialize(groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0), "divergence-groups")

    def pairs(self) -> DataFrame:
        """``lang, source, part, item, value, rank``: the other sources of each group's lang, farthest first."""
        own = self.groups.select("lang", "source", "size", "v")
        other = self.groups.select("lang", F.col("source").alias("item"), F.col("size").alias("item_size"))
        pairs = materialize(own.join(other, "lang").where("source <> item"), "divergence-pairs")
        share = lambda n, size: _share(n, size, "v", self.scale)
        p, q, p0, q0 = share("n", "size"), share("k", "item_size"), share("0", "size"), share("0", "item_size")
        there = self.rows.select("lang", "term", F.col("source").alias("item"), F.col("n").alias("k"))
        common = self.rows.select("lang", "term", "source", "n").join(there, ["lang", "term"]).where("source <> item")
        common = common.groupBy("lang", "source", "item", "n", "k").agg(F.count("*").alias("m")).join(pairs, ["lang", "source", "item"])
        histogram = self.cells.groupBy("lang", "source", "n").agg(F.sum("m").alias("m"))
        here = histogram.join(pairs, ["lang", "source"])
        beyond = histogram.select("lang", F.col("source").alias("item"), F.col("n").alias("k"), "m").join(pairs, ["lang", "item"])
        parts = [
            common.withColumn("w", F.col("m") * (_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0))),
            here.withColumn("w", F.col("m") * (_apart(p, q0) - _apart(p0, q0))),
            beyond.withColumn("w", F.col("m") * (_apart(p0, q) - _apart(p0, q0))),
            pairs.withColumn("w", F.when(F.col("v") > 0, F.col("v") * _apart(p0, q0)).otherwise(0)),
        ]
        first, *rest = [d.select("lang", "source", "item", "w") for d in parts]
        for d in rest:
            first = first.union(d)
        found = first.groupBy("lang", "source", "item").agg(F.sum("w").alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))

    def terms(self, top: int = 200) -> DataFrame:
        """``lang, source, part, item, value, rank``: the terms each group has more of than its lang, to rank ``top``."""
        group = Window.partitionBy("lang", "source")
        cells = self.cells.join(self.groups, ["lang", "source"])
        cells = cells.withColumn("p", _share("n", "size", "v", self.scale)).withColumn("q", _share("total", "lang_size", "v", self.scale)).where("p > q")
        cells = materialize(cells.select("lang", "source", "n", "total", "m", _apart(F.col("p"), F.col("q")).alias("value")), "divergence-values")
        merged = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
        best = merged.withColumn("place", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("place") <= top)
        before = F.sum("m").over(group.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1))
        last = best.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < top).groupBy("lang", "source").agg(F.min("value").alias("last"))
        chosen = materialize(cells.join(last, ["lang", "source"]).where("value >= last").select("lang", "source", "n", "total", "value"), "divergence-chosen")
        found = spread_join(self.rows, chosen, ["lang", "source", "n", "total"])
        rank = F.row_number().over(group.orderBy(F.desc("value"), "term"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= top)
        return found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def audit(documents: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """Both parts of the audit in one table."""
    found = Audit(documents, least_docs)
    return found.pairs().union(found.terms(top))
