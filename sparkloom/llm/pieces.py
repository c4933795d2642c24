"""SentencePiece BPE by a table over prefixes.

A text's encoding is the one token sequence in which each neighbouring pair is what BPE makes of the pair's own text,
and so is each prefix's. So every prefix has one last token: among the vocabulary pieces that end there (found by an
automaton) the one that is compatible with the last token of the prefix before it. The ids are recovered backwards
from the end. Symbols outside the vocabulary become byte pieces after that.

No piece holds a space mark after another character, nor some characters at all (line ends, for instance), so no token
crosses such a place; texts are parted there, each distinct part is encoded once and its ids and decoded text are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE_KIND = 1, 2, 3, 6
CACHE = 400_000


class PieceTable:
    """Encoder and decoder for the BPE model in ``path`` (identity normalizer, dummy prefix, byte fallback)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the identity normalizer, a dummy prefix and byte fallback are known")
        if odd := [p.piece for p in model.pieces if p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE_KIND)]:
            raise ValueError(f"pieces of other kinds: {odd[:3]}")
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE_KIND}
        self.text = [p.piece.replace(MARK, " ").encode() if p.type == NORMAL else b"" for p in model.pieces]
        for value, i in self.byte.items():
            self.text[i] = bytes([value])
        self.bytes_ids = frozenset(self.byte.values())
        self.unk_id = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.unk_text = trainer.unk_surface
        self.end_id = next((i for i, p in enumerate(model.pieces) if p.piece == (trainer.eos_piece or "</s>")), 2)
        self.pieces = [p.piece for p in model.pieces]
        self.matches = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.matches.add_word(piece, (i, len(piece)))
        self.matches.make_automaton()
        letters = {c for p in self.id for c in p}
        if odd := letters - self.id.keys():
            raise ValueError(f"characters of pieces that are no pieces: {sorted(odd)[:3]}")
        self.bigrams = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.parts_at_marks = not any(b[1] == MARK and b[0] != MARK for b in self.bigrams)
        lone = "[^" + "".join(regex.escape(c) for c in sorted(letters)) + "]"  # in no piece
        mark = regex.escape(MARK)
        self.parts = regex.compile(f"{lone}|{mark}*(?:(?!{lone}|{mark}).)+|{mark}+" if self.parts_at_marks else f"{lone}|(?:(?!{lone}).)+", regex.DOTALL)
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.words: dict[str, tuple[int, str, str]] = {}

    def forget(self) -> None:
        """Drop what is kept of words and pairs of tokens."""
        self.fits.clear()
        self.known.clear()
        self.words.clear()

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: again and again the neighbours whose joint piece scores highest, the first of equals."""
        out, score = list(text), self.score
        while True:
            best = max(((score[a + b], -k) for k, (a, b) in enumerate(zip(out, out[1:], strict=False)) if a + b in score), default=None)
            if best is None:
                return out
            k = -best[1]
            out[k : k + 2] = [out[k] + out[k + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two tokens stay two, and as they are, when their joint text is merged; left is "" at the start."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def tokens(self, text: str) -> list[int]:
        """The ids of a text of known characters by the prefix table."""
        n, size, fits, pieces = len(text), len(self.pieces), self.fits, self.pieces
        last = [-1] * n  # of the prefix that ends with each character
        for end, (i, length) in self.matches.iter(text):  # in order of ends, the longest first
            if last[end] >= 0:
                continue
            if length <= end:
                before = last[end - length]
                if before < 0:
                    continue
            else:
                before = size
            fit = fits.get(key := before * size + i)
            if fit is None:
                if len(fits) > 4 * CACHE:
                    fits.clear()
                fit = fits[key] = self.compatible(pieces[before] if before < size else "", pieces[i])
            if fit:
                last[end] = i
        out, n = [], n - 1
        while n >= 0:
            out.append(last[n])
            n -= len(pieces[last[n]])
        return out[::-1]

    def ids(self, part: str) -> list[int]:
        return self.tokens(part) if part[0] in self.id else [self.byte[b] for b in part.encode()]

    def _result(self, part: str) -> tuple[int, str, str]:
        ids = self.ids(part)
        return len(ids), " ".join(map(str, ids)), self.joined(ids)

    def _part(self, part: str) -> tuple[int, str, str]:
        if len(self.known) > CACHE // 4:
            self.known.clear()
        found = self.known[part] = self._result(part)
        return found

    def joined(self, ids: list[int]) -> str:
        """The text of ids as it stands, before the dummy prefix goes: whole characters from runs of byte pieces, U+FFFD for other bytes."""
        if self.bytes_ids.isdisjoint(ids) and self.unk_id not in ids:
            return b"".join([self.text[i] for i in ids]).decode()
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.bytes_ids:
                run += self.text[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                del run[:n]
            if i == self.unk_id:
                out.append(self.unk_text)
            elif i >= 0:
                out.append(self.text[i].decode())
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: the space of the dummy prefix goes, control pieces leave nothing."""
        return self.joined(ids).removeprefix(" ")

    def _whole(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by spaces, text) of a part of a text that no token crosses the ends of, spaces being marks."""
        parts = self.parts.findall(text)
        if len(parts) == 1:
            return self._result(text)
        found = [self.known.get(p) or self._part(p) for p in parts]
        return sum([f[0] for f in found]), " ".join([f[1] for f in found]), "".join([f[2] for f in found])

    def _word(self, word: str) -> tuple[int, str, str]:
        """The same for a word with a mark before it. A last point or comma is parted where no piece holds it and the character before."""
        if len(word) > 1 and word[-1] in ".," and word[-2:] not in self.bigrams:
            n, ids, text = self.words.get(word[:-1]) or self._word(word[:-1])
            return n + 1, f"{ids} {self.id[word[-1]]}", text + word[-1]
        found = self._whole(MARK + word)
        if "\n" not in word:
            if len(self.words) > CACHE:
                self.words.clear()
            self.words[word] = found
        return found

    def encode_decode(self, text: str) -> tuple[int, str, str]:
        """(number of ids without an end id, the ids joined by spaces, the decoded text)."""
        if not text:
            return 0, "", ""
        if not self.parts_at_marks or "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            n, ids, decoded = self._whole(MARK + text.replace(" ", MARK))
        else:
            words = self.words
            found = [words.get(w) or self._word(w) for w in text.split(" ")]
            n, ids, decoded = sum([f[0] for f in found]), " ".join([f[1] for f in found]), "".join([f[2] for f in found])
        return n, ids, decoded.removeprefix(" ")


_tables: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """The table for a model, kept for all tasks of a Python worker."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def _digests(model: str, keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        end = str(table.end_id)
        for batch in batches:
            counts, ids, texts = [], [], []
            for value in batch.column("text"):
                n, joined, decoded = table.encode_decode(value.as_py() or "")
                counts.append(n + 1)
                ids.append(hashlib.sha256(f"{joined} {end}".encode() if n else end.encode()).hexdigest())
                texts.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if not keep:
            table.forget()

    return digests


def piece_digests(docs: DataFrame, model: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text encoded with an end id and decoded again.

    Columns used: doc_id, text (null: empty); others are ignored. No row meets another, so repeated and null ids are
    kept as they are, and an empty table gives an empty one. ``model`` must be a path that executors see.
    Words that are known once are kept by a Python worker for its next tasks, or, without ``keep``, until its task ends, as other stages may need the memory.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests(model, keep), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
