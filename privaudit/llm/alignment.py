"""Alignment of two tokenizers over the distinct texts of a corpus.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (sentencepiece)
the text, to which it adds that space itself.  Byte offsets at which tokens of both end
cut a text's tokens into groups; at each such offset the two tokens that end there are
linked.  An id pair's count is the number of its links in the whole corpus.

Equal texts meet by a shuffle on the full text, so each distinct text is tokenised and
aligned once and its links weigh as often as it occurs.  The measures of a text then
join the ids of its documents by the text's SHA-256; a text that holds a great share
of the documents is spread.

Both tokenizers end a token before every single space or line feed between two other
characters, so texts are cut there, each distinct piece of an Arrow batch is aligned
once, and a text's groups are its pieces' in order.  Texts with other or repeated white
space, and those with a piece whose bytes differ, are aligned whole.

Pair counts are broadcast up to ``_BROADCAST_PAIRS`` (counted first), and joined by a
shuffle with spread hot pairs beyond.

Defined cases: null and empty texts, and texts whose joined token bytes differ from the
space and the text, have no tokens: measures are 0 and the digest is ''; repeated rows
each give a row; strings of special tokens are plain text; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from privaudit.llm import worker
from privaudit.llm.storage import materialize, spread_join
from privaudit.llm.tokens import _WHOLE, encoder, listed, slices

#: Texts that have what this finds are aligned whole.
_UNCUT = rf"{_WHOLE}|^[ \n]|[ \n]$"
#: Bytes of text aligned at a time, and pieces whose ids of A a Python worker keeps.
_SLICE_BYTES, _MOST_PIECES = 2 << 20, 150_000
#: Pair counts are broadcast up to so many rows.
_BROADCAST_PAIRS = 2_000_000
#: A pair is ``a * _SIDE + b``.
_SIDE = 1 << 32
_MEASURES = "n_a long, n_b long, n_groups long, links array<long>, groups_sha256 string, groups string"


def default_pieces() -> str:
    """The path of the sentencepiece model that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def cut(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[int]]:
    """The groups of two token lists over the same bytes, and their links; no token is empty."""
    groups, links = [], []
    i = j = first_a = first_b = at_a = at_b = 0
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            at_a += size_a[a[i]]
            i += 1
        else:
            at_b += size_b[b[j]]
            j += 1
        if at_a == at_b:
            groups.append((a[first_a:i], b[first_b:j]))
            links.append(a[i - 1] * _SIDE + b[j - 1])
            first_a, first_b = i, j
    return groups, links


def written(groups: list[tuple[list[int], list[int]]]) -> str:
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def _binary(data, edges: np.ndarray) -> pa.Array:
    """Parts of a buffer as a ``large_binary`` array."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(data)])


def _parts(values: pa.Array) -> tuple:
    """The data and the edges of a ``large_binary`` array."""
    raw = values.buffers()
    return (raw[2] or b"", np.frombuffer(raw[1], np.int64, len(values) + 1, values.offset * 8)) if len(values) else (b"", np.zeros(1, np.int64))


class Aligner:
    """Both tokenizers and tables of their tokens' bytes."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a, self.b = encoder(a, plain=True), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.most = _MOST_PIECES
        back = {letter: byte for byte, letter in self.a.letters.items()}
        vocabulary = self.a.tokenizer.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.space = self.b.piece_to_id("▁")
        self._tables = [(np.array(size), pa.array(tokens, pa.large_binary())) for size, tokens in ((self.size_a, self.bytes_a), (self.size_b, self.bytes_b))]
        self._top = max(len(self.bytes_a), len(self.bytes_b))
        self._names = pa.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(self._top)], pa.large_binary())

    def whole(self, text: str) -> tuple[int, int, int, bytes, bytes] | None:
        """Numbers of tokens and groups, the links, and the groups written; None if the text has no tokens."""
        raw, a, b = text.encode("utf-8", "surrogatepass"), np.frombuffer(self.a.whole(" " + text), "<u2").tolist(), self.b.encode(text)
        if not raw or any(b"".join([of[i] for i in ids]) != b" " + raw for of, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            return None
        groups, links = cut(a, b, self.size_a, self.size_b)
        return len(a), len(b), len(groups), np.array(links, np.int64).tobytes(), written(groups).encode()

    def _ids(self, pieces: list[str], lines: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of both tokenizers and how many each piece has."""
        coded = self.a.pieces(pieces)
        a, n_a = np.frombuffer(b"".join(coded), "<u2").astype(np.int64), np.array([len(c) for c in coded], np.int64) // 2
        coded = self.b.encode(lines)
        n_b = np.array([len(c) for c in coded], np.int64)
        b = np.fromiter(chain.from_iterable(coded), np.int64, int(n_b.sum()))
        after = np.array([p[:1] == "\x01" for p in pieces], bool)  # no space stands before these
        first = (np.cumsum(n_b) - n_b)[after & (n_b > 0)]
        first = first[b[first] == self.space]
        n_b[np.searchsorted(np.cumsum(n_b), first, "right")] -= 1
        return [(a, n_a), (np.delete(b, first), n_b)]

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, list[np.ndarray], pa.Array, pa.Array]:
        """Which pieces' bytes agree; numbers of tokens and groups, links and groups (each ended by ``;``) of those, none for the others.

        A piece is a word after a space, or after a line feed if it begins with ``\x01``.
        """
        lines = [p.replace("\x01", "\n", 1) for p in pieces]
        raw = [(line if p[:1] == "\x01" else " " + line).encode("utf-8", "surrogatepass") for p, line in zip(pieces, lines)]
        length = np.array([len(r) for r in raw], np.int64)
        raw, sides, good = np.frombuffer(b"".join(raw), np.uint8), self._ids(pieces, lines), np.ones(len(pieces), bool)
        held = [np.concatenate([[0], np.cumsum(size[ids])]) for (ids, _), (size, _) in zip(sides, self._tables)]
        for at, (_, n) in zip(held, sides):
            good &= np.diff(at[np.concatenate([[0], np.cumsum(n)])]) == length
        for _ in range(2):  # lengths first, then bytes
            raw, length = raw[np.repeat(good, length)], np.where(good, length, 0)
            sides = [(ids[np.repeat(good, n)], np.where(good, n, 0)) for ids, n in sides]
            for (ids, _), (_, tokens) in zip(sides, self._tables):
                other = np.flatnonzero(np.frombuffer(_parts(pc.take(tokens, pa.array(ids)))[0], np.uint8, len(raw)) != raw)
                good[np.searchsorted(np.cumsum(length), other, "right")] = False
        (a, n_a), (b, n_b) = sides
        end_a, end_b = (np.cumsum(size[ids]) for (ids, _), (size, _) in zip(sides, self._tables))
        edge_a, edge_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        met = np.minimum(np.searchsorted(end_b, end_a), max(0, len(b) - 1))
        last_a, last_b = end_b[met] == end_a if len(b) else np.zeros(0, bool), np.zeros(len(b), bool)
        last_b[met[last_a]] = True
        links = a[last_a] * _SIDE + b[last_b]
        upto_a, upto_b = np.flatnonzero(last_a) + 1, np.concatenate([[0], np.flatnonzero(last_b) + 1])
        names = np.empty(len(a) + len(b), np.int64)
        names[np.arange(len(a)) + upto_b[np.cumsum(last_a) - last_a]] = a + self._top * last_a
        names[np.arange(len(b)) + upto_a[np.cumsum(last_b) - last_b]] = b + 2 * self._top * last_b
        text, at = _parts(pc.take(self._names, pa.array(names)))
        ends = np.concatenate([[0], np.cumsum(last_a)])[edge_a]
        return good, [n_a, n_b, np.diff(ends)], _binary(links.tobytes(), 8 * ends), _binary(text, at[edge_a + edge_b])

    def column(self, texts: pa.Array, keep_groups: bool) -> list[pa.Array]:
        """The measures of each text (``large_string``, without nulls)."""
        n = len(texts)
        uncut = pc.match_substring_regex(texts, _UNCUT)
        lines = pc.replace_substring(pc.if_else(uncut, pa.scalar("", pa.large_string()), texts), "\n", " \x01")
        parts = pc.split_pattern(lines, " ")
        coded = pc.dictionary_encode(parts.values)
        edges = np.frombuffer(parts.buffers()[1], np.int64 if pa.types.is_large_list(parts.type) else np.int32, n + 1)
        good, numbers, links, groups = self.pieces(listed(coded.dictionary))
        code = coded.indices.to_numpy()
        upto = lambda values: np.concatenate([[0], np.cumsum(values[code])])[edges]
        sums = [np.diff(upto(x)) for x in numbers]
        slow = np.diff(upto((~good).astype(np.int64))) > 0
        slow |= uncut.to_numpy(zero_copy_only=False)
        (links, at), (groups, g) = ((memoryview(x), y[edges]) for x, y in (_parts(pc.take(v, coded.indices)) for v in (links, groups)))
        some = {int(i): self.whole(texts[int(i)].as_py()) or (0, 0, 0, b"", b"") for i in np.flatnonzero(slow)}
        for i, f in some.items():
            for k in range(3):
                sums[k][i] = f[k]
        own = [some[i][4] if i in some else groups[g[i] : max(g[i], g[i + 1] - 1)] for i in range(n)]
        digests = [hashlib.sha256(x).hexdigest() if len(x) else "" for x in own]
        if some:
            held = [some[i][3] if i in some else links[at[i] : at[i + 1]] for i in range(n)]
            flat, ends = np.frombuffer(b"".join(held), np.int64), np.cumsum([0, *(len(x) // 8 for x in held)])
        else:
            flat, ends = np.frombuffer(links, np.int64, len(links) // 8), at // 8
        linked = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(flat[ends[0] : ends[-1]]))
        kept = pa.array([bytes(x).decode() for x in own], pa.string()) if keep_groups else pa.nulls(n, pa.string())
        return [*(pa.array(s) for s in sums), linked, pa.array(digests, pa.string()), kept]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
worker.keeps("aligners", _ALIGNERS.clear)


def _aligned(a: str, b: str, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a, b) not in _ALIGNERS:
            _ALIGNERS[a, b] = Aligner(a, b)
        for whole in batches:
            for batch in slices(whole, 0, _SLICE_BYTES):
                columns = _ALIGNERS[a, b].column(batch.column(0).cast(pa.large_string()), keep_groups)
                names = ["key", "copies", "n_a", "n_b", "n_groups", "links", "groups_sha256", "groups"]
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *columns], names=names)

    return run


class Alignment:
    """The aligned distinct texts of one table of documents, written, and what is read from them.

    ``keep_groups`` also writes each text's groups, ``a1,a2|b1;a3|b2,b3``.
    """

    def __init__(self, documents: DataFrame, a: str, b: str, keep_groups: bool = False):
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        key = F.unhex(F.sha2("text", 256))
        self.documents = materialize(docs.select("doc_id", key.alias("key")), "alignment-documents")
        distinct = docs.where("octet_length(text) > 0").groupBy("text").agg(F.count("*").alias("copies")).select("text", key.alias("key"), "copies")
        #: ``key, copies, n_a, n_b, n_groups, links, groups_sha256, groups`` of each distinct text.
        self.texts = materialize(distinct.mapInArrow(worker.task(_aligned(a, b, keep_groups), "encoders", "aligners"), f"key binary, copies long, {_MEASURES}"), "alignment-texts")
        links = self.texts.select("copies", F.explode("links").alias("pair"))
        counts = links.groupBy("pair").agg(F.sum("copies").alias("count"))
        best = F.max("count").over(Window.partitionBy(F.col("pair") % _SIDE))
        #: ``pair, count`` and whether the pair's count is its B id's highest.
        self.counts = materialize(counts.withColumn("best", F.col("count") == best), "alignment-pairs")

    def pairs(self) -> DataFrame:
        """``a, b, count, best`` of each linked id pair."""
        return self.counts.select((F.col("pair") / _SIDE).cast("int").alias("a"), (F.col("pair") % _SIDE).cast("int").alias("b"), "count", "best")

    def measures(self, most: int = _BROADCAST_PAIRS) -> DataFrame:
        """A row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups``."""
        links = self.texts.select("key", F.explode("links").alias("pair"))
        if self.counts.count() <= most:
            counted = links.join(F.broadcast(self.counts), "pair")
        else:
            counted = spread_join(links, self.counts, ["pair"])
        sums = counted.groupBy("key").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
        plain = self.texts.select("key", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups_sha256", "groups")
        found = spread_join(self.documents, materialize(plain.join(sums, "key", "left"), "alignment-measures"), ["key"], "left")
        return found.fillna(0, ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]).fillna("", ["groups_sha256"]).drop("key")
