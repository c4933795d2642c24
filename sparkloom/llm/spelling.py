"""Spelling variants: words one edit apart, each led to a much more frequent form.

The vocabulary is dealt by ranges of words into shards, each a compact trie: a node is a branching or the end of a word
and has the letters that lead to it as one label. Shards are broadcast, at most PASS_WORDS words at a time; every word's
Levenshtein automaton for one edit is intersected with each of them depth first. Before the edit the automaton has one
state a letter, so it follows one path; at every point of it the edit can be a deletion, an insertion or a replacement,
after which only the rest of the word is accepted. What is accepted is counted and the best form kept, for each word.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.text_hash import slices, utf8
from sparkloom.scratch import drop, saved

LETTERS = "[A-Za-zÀ-ÿ]+"
#: Words of so many code points that occur so often; a form is so many times as frequent.
LENGTH, TIMES, RATIO = 5, 3, 2
#: A shard's words and letters (one longer word is a shard of its own), and what is broadcast at a time; a task asks for so many words.
SHARD_WORDS, SHARD_LETTERS, PASS_WORDS, PASS_BYTES, TASK_WORDS = 40_000, 1 << 20, 400_000, 16 << 20, 20_000
#: A task counts so many distinct words, or letters of them, before it passes them on.
HELD_WORDS, HELD_LETTERS = 200_000, 4 << 20


def word_counts(docs: DataFrame, alter: Callable[[int | None, dict[str, int]], dict[str, int]] | None = None) -> DataFrame:
    """(word, n): the runs of Latin letters in the texts of ``docs`` (doc_id, text), A-Z in lower case, and how often each occurs.

    Counts are summed within a task before they are shuffled. ``alter`` may replace a document's counts, by (doc_id, counts). A null text has no words.
    """
    find = re.compile(LETTERS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        letters = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 4 << 20):
                for k in range(i, j):
                    text = data[offsets[k] : offsets[k + 1]].tobytes().lower().decode()
                    own = Counter(find.findall(text) if len(text) < 1 << 20 else (m[0] for m in find.finditer(text)))
                    for word, n in (alter(ids[k], own) if alter else own).items():
                        if word in held:
                            held[word] += n
                        else:
                            held[word] = n
                            letters += len(word)
                    if len(held) >= HELD_WORDS or letters >= HELD_LETTERS:
                        yield out()
                        held.clear()
                        letters = 0
        if held:
            yield out()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """A compact trie over words in ascending order, as flat lists so that its depth is no limit."""

    def __init__(self, words: list[str], counts: list[int]):
        self.label, self.kids, self.n = [""], [None], [0]  # the root
        path, before = [(0, 0)], ""  # (node, its depth) from the root to the word before
        for word, n in zip(words, counts, strict=True):
            common, most = 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                common = most
            else:
                while word[common] == before[common]:
                    common += 1
            below = None
            while path[-1][1] > common:
                below = path.pop()
            top, depth = path[-1]
            if depth < common:  # the words part within the label of the node below: a new node takes its first letters
                new = self._node(self.label[below[0]][: common - depth])
                self.kids[top][self.label[new][0]] = new
                self.label[below[0]] = self.label[below[0]][common - depth :]
                self.kids[new] = {self.label[below[0]][0]: below[0]}
                path.append((new, common))
                top = new
            if len(word) > common:
                leaf = self._node(word[common:])
                if self.kids[top] is None:
                    self.kids[top] = {}
                self.kids[top][word[common]] = leaf
                path.append((leaf, len(word)))
            self.n[path[-1][0]] = n
            before = word

    def _node(self, label: str) -> int:
        self.label.append(label)
        self.kids.append(None)
        self.n.append(0)
        return len(self.label) - 1

    def near(self, w: str) -> Iterator[tuple[str, int]]:
        """The words that one deletion, insertion or replacement makes of ``w``, each once, and their counts."""
        label, kids, count, size = self.label, self.kids, self.n, len(w)

        def accepted(node: int, off: int, i: int) -> int:
            """The count of the word that w[i:] leads to from a point within a node's label, or 0."""
            while True:
                more = len(label[node]) - off
                if more:
                    if w[i : i + more] != label[node][off:]:
                        return 0
                    i += more
                if i == size:
                    return count[node]
                if not kids[node] or (node := kids[node].get(w[i])) is None:
                    return 0
                off = 0

        node = off = 0
        for d in range(size + 1):
            here = w[d] if d < size else ""
            inside = off < len(label[node])
            ways = ((label[node][off], node, off + 1),) if inside else [(c, kid, 1) for c, kid in kids[node].items()] if kids[node] else ()
            # what two edits make alike is made by the last of them: of equal letters the last is deleted, and none is put before its like
            if here and w[d + 1 : d + 2] != here and (n := accepted(node, off, d + 1)):
                yield w[:d] + w[d + 1 :], n
            on = None
            for c, at, reached in ways:
                if c == here:
                    on = at, reached
                    continue
                if n := accepted(at, reached, d):
                    yield w[:d] + c + w[d:], n
                if here and (n := accepted(at, reached, d + 1)):
                    yield w[:d] + c + w[d + 1 :], n
            if on is None:
                return
            node, off = on


def trie_shards(words: DataFrame, n_words: int) -> DataFrame:
    """(trie, n_words, size): the words (word, n) as tries of bounded size, each over a range of words."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        counts: list[int] = []
        letters = 0

        def out() -> pa.RecordBatch:
            trie = Trie(words, counts)
            blob = pickle.dumps((trie.label, trie.kids, trie.n))
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([len(blob)], pa.int64())], ["trie", "n_words", "size"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words and (len(words) >= SHARD_WORDS or letters + len(word) > SHARD_LETTERS or word <= words[-1]):
                    yield out()
                    words, counts, letters = [], [], 0
                words.append(word)
                counts.append(n)
                letters += len(word)
        if words:
            yield out()

    parts = max(1, -(-n_words // SHARD_WORDS))
    dealt = words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    return dealt.mapInArrow(built, "trie binary, n_words long, size long")


_unpacked: dict[str, list[Trie]] = {}


def _tries(shared) -> list[Trie]:
    """The tries of a broadcast, unpacked once in each worker; only the last pass is kept."""
    if shared.id not in _unpacked:
        _unpacked.clear()
        out = []
        for blob in shared.value:
            trie = Trie.__new__(Trie)
            trie.label, trie.kids, trie.n = pickle.loads(blob)
            out.append(trie)
        _unpacked[shared.id] = out
    return _unpacked[shared.id]


class _Broadcast:
    """A broadcast with a name that no other has, in whichever job a worker meets it."""

    def __init__(self, held):
        self.held, self.id = held, uuid.uuid4().hex

    @property
    def value(self) -> list[bytes]:
        return self.held.value


def _asked(words: DataFrame, shared: _Broadcast) -> DataFrame:
    """(word, n, n_near, best_n, best) of words that have neighbours in the broadcast tries."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tries = _tries(shared)
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                near = [(-m, other) for trie in tries for other, m in trie.near(word)]
                if near:
                    best = min(near)
                    rows.append((word, n, len(near), -best[0], best[1]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "n", "n_near", "best_n", "best"])

    return words.mapInArrow(ask, "word string, n long, n_near long, best_n long, best string")


def _passes(shards: DataFrame) -> Iterator[list[bytes]]:
    """The shards' tries, in lists of at most PASS_WORDS words and PASS_BYTES bytes, or of one shard."""
    sizes = shards.select("shard", "n_words", "size").orderBy("shard").collect()  # three numbers for some ten thousand words
    ids: list[int] = []
    words = size = 0
    for r in [*sizes, None]:
        if ids and (r is None or words + r.n_words > PASS_WORDS or size + r["size"] > PASS_BYTES):
            yield [x.trie for x in shards.where(F.col("shard").isin(ids)).select("trie").collect()]
            ids, words, size = [], 0, 0
        if r is not None:
            ids.append(r.shard)
            words, size = words + r.n_words, size + r["size"]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best), saved: for each of the distinct words (word, n) how many others are one edit away, and the most frequent of them (the first by code points of equals); null if none."""
    spark = words.sparkSession
    n_words = words.count()
    shards = saved(trie_shards(words, n_words).withColumn("shard", F.monotonically_increasing_id()), "tries")
    asked = words.select("word", "n").repartition(max(1, -(-n_words // TASK_WORDS), int(spark.conf.get("spark.sql.shuffle.partitions"))), "word")
    found = []
    for blobs in _passes(shards):
        held = spark.sparkContext.broadcast(blobs)
        found.append(saved(_asked(asked, _Broadcast(held)), "near"))
        held.unpersist()
    out = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    for part in found:
        out = out.unionAll(part)
    ranked = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))
    out = saved(out.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(ranked).alias("first")).select("word", "n", "n_near", (-F.col("first.less")).alias("best_n"), "first.best"), "neighbours")
    drop(shards, *found)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root), saved: the last of the forms that follow each word of (word, form). Each round doubles the steps; a form is RATIO times as frequent, so there are few."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = saved(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop(now)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")
        now._saved_at = after._saved_at


def spelling_groups(counts: DataFrame, length: int = LENGTH, times: int = TIMES, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of ``counts`` (word, n) with at least ``length`` code points and ``times`` occurrences.

    Words are near if one inserted, deleted or replaced code point tells them apart. A word's form is the most frequent of
    its near words (ties: the first by code points) if that is ``ratio`` (2 or more) times as frequent, else null; root follows forms to the
    last, and is the word itself without any. n_near is the number of near words, form_n the form's n or null. Rows that
    repeat a word are summed, null words are dropped; other columns are not looked at; an empty table gives an empty one. Words may be of any
    length; what a task or a broadcast holds is bounded by words and letters, and by the longest word.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms lead to an end")
    kept = counts.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = saved(kept.where((F.char_length("word") >= length) & (F.col("n") >= times)), "words")
    judged = near_words(words)
    found = F.col("best_n") >= F.lit(ratio) * F.col("n")
    led = judged.select("word", F.when(found, F.col("best")).alias("form"), "n", "n_near", F.when(found, F.col("best_n")).alias("form_n"))
    roots = _roots(led.where("form is not null"))
    drop(words)
    return led.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
