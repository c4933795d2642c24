"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped on reading.

A corpus is a folder of shards, in ascending doc_id order by shard number. Shard n has two files:

* ``shard-n.u2.ids`` (``.u4.`` for a vocabulary that needs it) the token ids of its documents one after another, little-endian;
* ``shard-n.docs`` little-endian int64: the number of documents m, the m doc_ids (the smallest int64 for null), then
  m + 1 offsets of tokens within the shard.

``manifest`` (little-endian int64, four a shard: its number, documents, tokens and base) is written last. A shard's base,
the place of its first token in the whole corpus, is the sum of the tokens of the shards before it (a prefix sum over one
number a shard). Every file is written under another name and renamed, so that a repeated or speculative task leaves one
whole shard, and no finished file is changed.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.scratch import new_path

NO_ID = np.iinfo(np.int64).min
#: Pieces of words whose ids a task keeps before it begins anew, bytes of text that it encodes at a time, and pieces that go to the tokenizer as one text.
CACHE, SLICE, JOINED = 300_000, 4 << 20, 4096
#: Characters that are one letter, digit or mark for every tokenizer, also in another case: visible ASCII and the letters of Latin-1.
PLAIN = "[!-~À-ÖØ-öø-ÿ]+"


class WordTokens:
    """Ids of texts by a tokenizer that parts texts by one pattern, drops white space, and encodes what the pattern matches on its own.

    A text is parted at ASCII white space, a PLAIN word (in lower case if the tokenizer wants that) once more by the tokenizer's pattern. Distinct
    pieces are looked up; new ones go to the tokenizer many at a time, with spaces between them, if their
    last ids can be told by the vocabulary's end-of-word suffix. Words with other characters or
    with one of the tokenizer's added tokens are pieces as they are, encoded on their own. Tokenizers of another kind are refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        steps = (kind["pre_tokenizer"] or {}).get("pretokenizers", [])
        parts = [p["type"] for p in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and steps[0]["behavior"] == "Removed"
        changes = (kind["normalizer"] or {}).get("normalizers", [kind["normalizer"]] if kind["normalizer"] else [])
        spaces = [c["pattern"] == {"Regex": r"\s+"} and c["content"] == " " for c in changes if c["type"] == "Replace"]
        self.lower = any(c["type"] == "Lowercase" for c in changes)
        if not all(spaces) or not {c["type"] for c in changes} <= {"NFC", "Lowercase", "Replace"} or not parts or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
            raise ValueError(f"{path}: not a tokenizer that encodes the matches of one pattern on their own")
        letters, pattern = "a-zA-ZÀ-ÖØ-öø-ÿ", steps[0]["pattern"]["Regex"]
        self.pattern = pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"\p{L}", letters).replace(r"[\p{N}]", "[0-9]").replace(r"\p{N}", "0-9")
        if not all(re.fullmatch(self.pattern, chr(c)) for c in range(0x21, 0x100) if re.match(PLAIN, chr(c))):
            raise ValueError(f"{path}: its pattern drops characters other than white space")
        self.added = "|".join(re.escape(t["content"]) for t in kind["added_tokens"])
        self.tokenizer = Tokenizer.from_file(path)
        suffix = kind["model"].get("end_of_word_suffix")  # the last id of every piece, and no other, has it
        self.ends = np.zeros(1 + max(kind["model"]["vocab"].values()), bool)
        self.ends[[i for t, i in kind["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}  # ids as uint32

    def _plain(self, words: pa.Array) -> pa.Array:
        plain = pc.match_substring_regex(words, f"^{PLAIN}$")
        return pc.and_not(plain, pc.match_substring_regex(words, self.added)) if self.added else plain

    def _pieces(self, words: pa.Array) -> pa.Array:
        """The list of each word's pieces."""
        plain, own = self._plain(words), words
        if self.lower:
            own = pc.utf8_lower(words)
            plain = pc.and_(plain, self._plain(own))
        parted = pc.ascii_trim_whitespace(pc.replace_substring_regex(own, f"({self.pattern})", r"\1 "))
        return pc.ascii_split_whitespace(pc.if_else(plain, parted, words))

    def _learn(self, pieces: pa.Array) -> None:
        plain = self._plain(pieces)
        for names, joined in ((pieces.filter(plain).to_pylist(), True), (pieces.filter(pc.invert(plain)).to_pylist(), False)):
            for k in range(0, len(names), JOINED):
                some = names[k : k + JOINED]
                if joined and self.ends.any():
                    (found,) = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
                    ids = np.array(found.ids, np.uint32)
                    cuts = [0, *(4 + 4 * np.flatnonzero(self.ends[ids])).tolist()]
                    if len(cuts) == len(some) + 1:
                        whole = ids.tobytes()
                        self.known.update(zip(some, [whole[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
                        continue
                each = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
                self.known.update(zip(some, (np.array(e.ids, np.uint32).tobytes() for e in each), strict=True))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each has; null is empty."""
        if len(self.known) > CACHE:
            self.known = {}
        lists = pc.ascii_split_whitespace(column.fill_null(""))
        words = pc.dictionary_encode(lists.flatten())
        pieces = self._pieces(words.dictionary)
        coded = pc.dictionary_encode(pieces.flatten())
        names = coded.dictionary.to_pylist()
        ids = list(map(self.known.get, names))
        if None in ids:
            self._learn(coded.dictionary.filter(pa.array([i is None for i in ids])))
            ids = list(map(self.known.get, names))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        flat, per_word = _gathered(flat, sizes, coded.indices.to_numpy(zero_copy_only=False), _offsets(pieces))
        return _gathered(flat, per_word, words.indices.to_numpy(zero_copy_only=False), _offsets(lists))


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return lists.offsets.to_numpy() - lists.offsets[0].as_py()


def _gathered(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of ``flat`` (cut in runs of ``sizes``) one after another, and how many values those between two offsets have."""
    lengths, starts = sizes[at], (np.cumsum(sizes) - sizes)[at]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    values = flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
    return values, np.diff(np.concatenate([[0], ends])[offsets])


def _row_slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of about ``size`` bytes of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff(np.cumsum(lengths) // size, prepend=0))
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)], strict=True):
        if j > i:
            yield batch.slice(i, j - i)


def local_path(url: str) -> str:
    """The path under which executors see the shared folder; only mounted file systems can be memory-mapped."""
    if url.startswith("file:"):
        return "/" + url[5:].lstrip("/")
    if "://" in url:
        raise ValueError(f"token files are memory-mapped, so their folder must be a mounted one, not {url}")
    return url


def _put(path: str, values: np.ndarray) -> None:
    """Little-endian int64 values as a file that is there whole or not at all."""
    own = f"{path}.{uuid.uuid4().hex}"
    np.asarray(values, "<i8").tofile(own)
    os.replace(own, path)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1) -> DataFrame:
    """Encode every whole text and write the files in ascending doc_id order; returns (shard long, n_docs long, n_tokens long, base long).

    Columns used: doc_id long, text string (null: empty); others are ignored, whatever their names. Every document ends with
    ``end_id``. Documents are dealt to shards by ranges of doc_id and a hash of the text; null ids come first, rows with one
    doc_id follow each other by that hash. An empty table gives a folder without shards.
    """
    where = local_path(folder)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        words, shard = WordTokens(tokenizer), TaskContext.get().partitionId()
        kind = np.dtype("<u2") if max(words.tokenizer.get_vocab_size(), end_id) <= 1 << 16 else np.dtype("<u4")
        os.makedirs(where, exist_ok=True)
        name = f"{where}/shard-{shard:06d}"
        own = f"{name}.{uuid.uuid4().hex}"
        doc_ids, sizes = [], []
        with open(own, "wb") as out:
            for batch in batches:
                for part in _row_slices(batch):
                    ids, counts = words.encode(part.column("text"))
                    np.insert(ids, np.cumsum(counts), end_id).astype(kind).tofile(out)
                    sizes.append(counts + 1)
                    doc_ids.append(part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
        if not sizes:
            os.remove(own)
            return
        counts, kept = np.concatenate(sizes), np.concatenate(doc_ids)
        os.replace(own, f"{name}.{kind.str[1:]}.ids")
        _put(f"{name}.docs", np.concatenate([[len(kept)], kept, [0], np.cumsum(counts)]))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(kept)], "n_tokens": [int(counts.sum())]})

    counts = ordered.mapInArrow(encode, "shard long, n_docs long, n_tokens long").collect()  # one row per shard
    rows, base = [], 0
    for shard, n_docs, n_tokens in sorted(map(tuple, counts)):
        rows.append((shard, n_docs, n_tokens, base))
        base += n_tokens
    os.makedirs(where, exist_ok=True)
    _put(f"{where}/manifest", np.array(rows, np.int64).ravel())
    return docs.sparkSession.createDataFrame(rows, "shard long, n_docs long, n_tokens long, base long")


def shards_of(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, n_docs, n_tokens, base): what the manifest of a folder lists."""
    rows = np.fromfile(f"{local_path(folder)}/manifest", "<i8").reshape(-1, 4).tolist()
    return spark.createDataFrame(rows, "shard long, n_docs long, n_tokens long, base long")


def read_token_files(spark: SparkSession, folder: str, shards: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the memory-mapped files of the given shards (all by default).

    start counts the ids of all documents before; ids_crc32 is the unsigned CRC-32 of a document's ids as little-endian uint32.
    """
    where = local_path(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import glob

        for batch in batches:
            for shard, base in zip(*(batch.column(c).to_pylist() for c in ("shard", "base")), strict=True):
                docs = np.memmap(f"{where}/shard-{shard:06d}.docs", "<i8", "r")
                (name,) = glob.glob(f"{where}/shard-{shard:06d}.*.ids")
                ids = np.memmap(name, f"<{name.split('.')[-2]}", "r")
                n = int(docs[0])
                doc_ids, offsets = docs[1 : n + 1], docs[n + 1 :]
                for i in range(0, n, 5000):
                    at = np.asarray(offsets[i : i + 5001])
                    own = np.asarray(doc_ids[i : i + 5000])
                    sums = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NO_ID), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = shards_of(spark, folder) if shards is None else shards
    wide = listed.select("shard", "base").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard")
    return wide.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the token files of ``docs`` and read them back: the rows of ``read_token_files``."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, tokenizer, folder, end_id))
