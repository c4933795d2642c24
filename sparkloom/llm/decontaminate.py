"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

A window (10 consecutive words of a benchmark item, or a whole shorter item) is a set of words that a document must
hold completely, so that any of its words would do as a prefix: the PREFIX ones that are rarest in the documents. They are joined
with the positions of the documents' words. A joined position fixes where the window would begin; it goes on
only if the window would begin and end within the document and all prefix words give the same beginning (length and
positional bound). What is left is verified word by word against the document, and windows that hold are merged to runs of hit words.

The prefix table is sent to every executor in parts of about PART_BYTES, one pass over the documents for each, so that a
benchmark of any size is joined by the same plan. Only texts with candidates are shuffled, once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.marks import marks, parted
from sparkloom.scratch import drop, saved

WINDOW, PREFIX = 10, 2
#: Bytes of prefix words that one pass over the documents sends to every executor.
PART_BYTES = 16 << 20
#: ASCII but digits and letters, one by one: Java looks single characters up in a table, but tries range after range.
SEPARATORS = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A text is known by two hashes of its bytes.
TEXT = ["k1", "k2"]


def raw_words(text: Column) -> Column:
    """The words of a text, letters as they are: A-Z in lower case would part it at the same places."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def n_words(text: Column) -> Column:
    """The number of words of a text; null has none. Parting takes a sixth of the time that counting the matches of a negated class does."""
    return F.coalesce(F.array_size(raw_words(text)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_keys(text: str = "text") -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _windows(items: DataFrame) -> DataFrame:
    """(item_id, window) with window an array of words; an item of fewer than WINDOW words is one window."""
    words = items.select("item_id", raw_words(ascii_lower("text")).alias("words")).where("size(words) > 0")
    last = F.greatest(F.size("words") - WINDOW + 1, F.lit(1))
    at = words.select("item_id", "words", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    return at.select("item_id", F.slice("words", F.col("at"), WINDOW).alias("window")).distinct()


def _prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, folded, place, length, need): the PREFIX words of each window that are rarest in the documents (all of a shorter one's), saved."""
    spread = windows.select("window_id", F.size("window").alias("length"), F.posexplode("window").alias("place", "word")).withColumn("folded", F.lower("word"))
    # lower() folds more than A-Z, so equal words have equal folded forms; the exact form is compared in the end
    counts = docs.select(F.explode(raw_words(F.col("text"))).alias("raw")).groupBy(F.lower("raw").alias("folded")).count()
    rarity = saved(counts.join(spread.select("folded").distinct(), "folded", "left_semi"), "rarity")
    first = Window.partitionBy("window_id").orderBy(F.coalesce("count", F.lit(0)), "word", "place")
    rarest = spread.join(rarity, "folded", "left").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PREFIX)
    out = saved(rarest.select("window_id", "folded", "place", "length", F.least(F.col("length"), F.lit(PREFIX)).alias("need")), "prefix")
    drop(rarity)
    return out


def _candidates(docs: DataFrame, part: DataFrame) -> DataFrame:
    """(k1, k2, window_id, begin): where all prefix words of a window stand in a text at their places, the window being within the text; saved.

    Positions are gathered by text as a set, so that copies of a text count once.
    """
    asked = F.broadcast(part.select("folded").distinct())
    words = docs.select(*text_keys(), raw_words(F.col("text")).alias("words"))
    each = words.select(*TEXT, F.size("words").alias("n"), F.posexplode("words").alias("pos", "raw")).select(*TEXT, "n", "pos", F.lower("raw").alias("folded"))
    found = each.join(asked, "folded").groupBy(*TEXT, "n").agg(F.collect_set(F.struct("folded", "pos")).alias("found"))  # within one text
    begin = F.col("pos") - F.col("place")
    met = found.select(*TEXT, "n", F.explode("found").alias("f")).select(*TEXT, "n", "f.*").join(F.broadcast(part), "folded")
    fits = met.where((begin >= 0) & (begin + F.col("length") <= F.col("n")))
    return saved(fits.groupBy(*TEXT, "window_id", begin.alias("begin"), "need").count().where("count = need").select(*TEXT, "window_id", "begin"), "candidates")


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(k1, k2, n_hit, n_items, joined) for every distinct text of ``docs`` (text) that holds a window of ``items`` (item_id, text), saved; joined are the item_ids."""
    windows = saved(_windows(items).withColumn("window_id", F.monotonically_increasing_id()), "windows")
    prefix = _prefixes(docs, windows)
    parts = 1 + int((prefix.agg(F.sum(F.octet_length("folded") + 64)).first()[0] or 0) // PART_BYTES)
    # each part is of about PART_BYTES
    tables = [_candidates(docs, prefix.where(F.pmod(F.xxhash64("window_id"), F.lit(parts)) == n)) for n in range(parts)]
    tried = saved(reduce(DataFrame.unionAll, tables).join(windows, "window_id").groupBy(*TEXT).agg(F.collect_list(F.struct("begin", "window", "item_id")).alias("tried")), "tried")
    bitmap = marks(tried, TEXT)
    keyed = docs.select(*text_keys(), "text")
    texts = parted(keyed, TEXT, bitmap)[0].groupBy(*TEXT).agg(F.first("text").alias("text")).join(tried.hint("merge"), TEXT)
    # the words are parted once: as a variable, not as a column that Spark may put into the inner function
    holds = lambda words: F.filter("tried", lambda c: F.slice(words, c.begin + 1, F.size(c.window)) == c.window)
    held = texts.select(*TEXT, F.explode(F.flatten(F.transform(F.array(raw_words(ascii_lower("text"))), holds))).alias("h")).select(*TEXT, "h.item_id", "h.begin", F.size("h.window").alias("length"))
    held = saved(held.distinct(), "held")

    spans = held.select(*TEXT, "begin", "length").distinct()
    before = Window.partitionBy(*TEXT).orderBy("begin", "length").rowsBetween(Window.unboundedPreceding, -1)
    ends = spans.withColumn("end", F.col("begin") + F.col("length")).withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    hit = ends.groupBy(*TEXT).agg(F.sum(F.greatest(F.col("end") - F.greatest("begin", "reached"), F.lit(0))).cast("long").alias("n_hit"))
    ids = held.groupBy(*TEXT).agg(F.collect_set(F.struct("item_id")).alias("items"))
    named = ids.select(*TEXT, F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort(F.transform("items", lambda x: x.item_id.cast("string"))), ",").alias("joined"))
    out = saved(hit.join(named, TEXT), "hits")
    drop(windows, prefix, *tables, tried, bitmap, held)
    return out


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every text of ``docs`` (doc_id, text) against ``items`` (item_id, text).

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case. A document word inside any occurrence
    of a window is hit; n_items counts the items with a window that occurs; items_sha256 is the hash of their ids, sorted
    as strings and joined by commas (of the empty string if there is none). Null and empty texts have no words. Other columns
    are ignored. Rows that repeat a doc_id are judged one by one. Without items, or with items that have no words, nothing is hit; a null
    item_id counts as an item but adds nothing to the hash. Repeated items with one item_id count once.
    """
    found = hits(docs.select("text"), items)
    rows = docs.select("doc_id", *text_keys(), n_words(F.col("text")).alias("n_words"))
    out = rows.join(found.hint("merge"), TEXT, "left")
    n_hit, n_items = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n_hit", "n_items"))
    judged = saved(out.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.coalesce("joined", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")), "judged")
    drop(found)
    return judged
