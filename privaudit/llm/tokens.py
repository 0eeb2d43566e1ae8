"""Token ids of whole texts with a public byte-level BPE vocabulary.

``encode_column`` gives exactly what ``Tokenizer.encode(text,
add_special_tokens=False).ids`` gives.  A byte-level BPE cuts a text before
every single space or line feed that stands between two other characters, so
such texts are cut there, each distinct piece of an Arrow batch is encoded
once, and the pieces' ids are gathered by an Arrow ``take``.  Texts with other
white space or runs of it are encoded whole.

Ids are little-endian unsigned 16-bit (all vocabularies here have fewer than
65,536 entries); a wider vocabulary is refused.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from privaudit.llm import worker

#: Texts that have what this finds are encoded whole.
_WHOLE = (
    r"[ \n][ \n]|[\x01\x02\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: Pieces kept per Python worker; when there are more, those that came again stay.
_MOST_PIECES = 450_000
#: Bytes of text encoded at a time.
_SLICE_BYTES = 10 << 20
#: Words that any version of Unicode's tables takes as letters only.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: ASCII signs that may end a word; more than a few of them are no ending.
_SIGNS, _MOST_SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_{|}~", 8


def default_tokenizer() -> str:
    """The path of the byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def listed(values: pa.Array) -> list:
    """The values of a flat array; ``to_pylist`` makes a scalar object of each first."""
    return values.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """A tokenizer with a bounded cache of the pieces seen by this worker."""

    def __init__(self, path: str, plain: bool = False):
        """``plain``: the strings of special tokens are text like any other."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("token ids need more than 16 bits")
        self.known: dict[str, bytes] = {}
        self.most = _MOST_PIECES
        self.newline = self.whole("\n")
        self.marks: dict[str, bytes | None] = {}
        self.letters = self._byte_letters()

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u2").tobytes()

    def _byte_letters(self) -> dict[int, str] | None:
        """The vocabulary's letters for bytes, if words of letters can go straight to its merges."""
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        other = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        words = ["the", " the", "Straße", " élan", "ñandú", " internationalisation", "aaaaaaaaaaaaaaaa"]
        return self.letters if self._merged(words) == [self.whole(w) for w in words] else None

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters (a space may lead), by the merges alone."""
        merge, ids, ends, letters = self.tokenizer.model.tokenize, [], [], self.letters
        space = letters[32]
        for w in words:
            mapped = w.replace(" ", space) if w.isascii() else w.encode().decode("latin-1").translate(letters)
            ids += [t.id for t in merge(mapped)]
            ends.append(2 * len(ids))
        raw = np.asarray(ids, dtype="<u2").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _many(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space but for one leading space."""
        if not words:
            return []
        joined = np.asarray(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, dtype="<u2")
        cuts = np.flatnonzero(joined == np.frombuffer(self.newline, "<u2")[0]) if len(self.newline) == 2 else []
        if len(cuts) != len(words) - 1:
            return [self.whole(w) for w in words]
        raw, ends = joined.tobytes(), [*(int(c) * 2 for c in cuts), len(joined) * 2]
        return [raw[a:b] for a, b in zip([0, *(e + 2 for e in ends[:-1])], ends)]

    def _mark(self, signs: str) -> bytes | None:
        """Ids of signs that end a word, if they are cut off before the merges."""
        if signs not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            ids = self.whole(signs)
            cut = all(self.whole(word + signs) == self.whole(word) + ids for word in ("the", " Straße"))
            self.marks[signs] = ids if cut else None
        return self.marks[signs]

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces: words of letters, with or without signs at the end, or anything else."""
        known = self.known
        easy, hard, later = [], [], []
        for piece in pieces:
            if piece.isascii() and piece.isalpha() or _LETTERS(piece):
                easy.append(piece)
                continue
            core = piece.rstrip(_SIGNS)
            if core and len(piece) - len(core) <= _MOST_SIGNS and (core.isalpha() or core[:1] in ("\x01", "\x02") and core[1:].isalpha()):
                if core == piece:
                    (easy if _LETTERS(core[1:]) and core[0] < " " else hard).append(piece)
                elif (ids := self._mark(piece[len(core) :])) is not None:
                    later.append((piece, core, ids))
                else:
                    hard.append(piece)
            else:
                hard.append(piece)
        for core in {core for _, core, _ in later}.difference(known, easy, hard):
            (easy if _LETTERS(core[1:] if core[0] < " " else core) else hard).append(core)
        if self.letters:
            # a piece after a line feed or at the start of a text has no space before it
            words = [" " + p if p[0] > "\x02" else p[1:] for p in easy]
            found = self._merged(words)
            known.update(zip(easy, found))
            known.update((p, self.newline + ids) for p, ids in zip(easy, found) if p[0] == "\x01")
        else:
            hard += easy
        spaced = [p for p in hard if p[:1] not in ("\x01", "\x02")]
        known.update(zip(spaced, self._many([" " + p for p in spaced])))
        raw = [p for p in hard if p[:1] in ("\x01", "\x02")]
        words = [p for p in raw if len(p) > 1]
        for piece, ids in zip(words, self._many([p[1:] for p in words])):
            known[piece] = self.newline + ids if piece[0] == "\x01" else ids
        for piece in raw:
            if len(piece) == 1:
                known[piece] = self.newline if piece == "\x01" else b""
        known.update((piece, known[core] + ids) for piece, core, ids in later)

    def pieces(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        if len(self.known) > self.most:
            self.known = {p: ids for p, ids in zip(pieces, found) if ids is not None}
            if len(self.known) > self.most:
                self.known, found = {}, [None] * len(pieces)
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = [pieces[i] for i in missing]
            self._learn(new)
            for i, ids in zip(missing, map(self.known.__getitem__, new)):
                found[i] = ids
        return found

    def column(self, texts: pa.Array) -> pa.Array:
        """Ids of each text (null: empty) as a ``large_binary`` array."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, _WHOLE)
        cut = pc.if_else(whole, pa.scalar("", pa.large_string()), texts)
        cut = pc.binary_join_element_wise(pa.scalar("\x02", pa.large_string()), pc.replace_substring(cut, "\n", " \x01"), pa.scalar("", pa.large_string()))
        parts = pc.split_pattern(cut, " ")
        coded = pc.dictionary_encode(parts.values)
        known = pa.array(self.pieces(listed(coded.dictionary)), pa.large_binary())
        taken = pc.take(known, coded.indices)
        starts = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8) if len(taken) else np.zeros(1, np.int64)
        ends = starts[np.frombuffer(parts.buffers()[1], np.int64 if pa.types.is_large_list(parts.type) else np.int32, len(parts) + 1)]
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(ends)), taken.buffers()[2]])
        if pc.any(whole).as_py():
            chosen = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            slow = {int(i): self.whole(texts[int(i)].as_py()) for i in chosen}
            out = pa.array([slow.get(i, b) for i, b in enumerate(out.to_pylist())], pa.large_binary())
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}
worker.keeps("encoders", _ENCODERS.clear)


def encoder(path: str, plain: bool = False) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = Encoder(path, plain)
    return _ENCODERS[path, plain]


def slices(batch: pa.RecordBatch, column: int, most: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded size of text (single long texts aside)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
