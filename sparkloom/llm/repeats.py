"""Removal of repeated byte strings with suffix arrays over shards of windows that can be equal.

A window is a place where LENGTH bytes of one text begin. Equal windows have the same minimizer (the GRAM bytes in them
with the least hash), so windows are dealt by minimizer: neighbouring windows with one minimizer travel as one run, the
bytes that they cover. A minimizer that occurs in one run alone, and there once, has no equal windows. Equal runs are counted as one content; all
windows of a content that occurs twice repeat. Contents that share a minimizer but differ go, by minimizer, to shards
whose suffix arrays (induced sorting) and permuted common prefixes show which of their windows repeat. A minimizer
with more than HOT contents is dealt again by longer minimizers. Runs that share a long minimizer and together exceed LARGE bytes (a passage
with many different texts beside it) are parted into their windows, which Spark counts by their bytes: no group has to fit one suffix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.suffix_array import common_prefixes, suffix_array
from sparkloom.llm.text_hash import BASE, BASE_INV, BYTE, LANES, U, mix, powers, slices, utf8
from sparkloom.scratch import drop, saved, small_batches

LENGTH = 200
GRAM, LONG_GRAM = 32, 184
HOT = 5000
#: Bytes of one suffix array (small enough for the caches of a core), bytes of a group beyond which it is parted, and most windows of a run.
SHARD, LARGE, RUN = 1 << 19, 4 << 20, 400
#: Bytes of texts whose hashes a task holds at once (their arrays are 150 times as large), and texts whose remains it passes on at once.
TEXTS, REMAINS = 1 << 18, 500
#: Parts of a window's occurrences.
SALT = 16
KEY = ["gram", "content", "size"]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on; gram is a multiple of 8."""
    n = len(data) - gram + 1
    words = np.array(np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)))
    with np.errstate(over="ignore"):
        out = words[:n] * LANES[0]
        for k in range(1, gram // 8):
            out += mix(words[8 * k : 8 * k + n]) * LANES[k] if k % 2 else words[8 * k : 8 * k + n] * LANES[k]
    return mix(out)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values, by running minima within blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], fore[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, minimizer, content hash, repeats) of the runs of windows with one minimizer.

    Starts count within each text. ``repeats`` is 2 if the minimizer is in the run more than once, so that windows of
    the run itself may be equal, else 1.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    part = data[lo:hi]
    if len(part) < LENGTH:
        return (*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, U)] * 2, np.zeros(0, np.int32))
    width = LENGTH - gram + 1
    hashes = gram_hashes(part, gram)
    least = sliding_least(hashes, width)
    at = offsets - lo
    first, last = at[:-1], np.maximum(at[1:] - LENGTH + 1, at[:-1])  # a text's windows
    edge = np.zeros(len(least) + 1, np.int32)
    np.add.at(edge, np.minimum(first, len(least)), 1)
    np.add.at(edge, np.minimum(last, len(least)), -1)
    inside = np.cumsum(edge[:-1]) > 0
    fresh = np.ones(len(least), bool)
    fresh[1:] = least[1:] != least[:-1]
    fresh[first[first < len(least)]] = True
    begins = np.flatnonzero(fresh & inside)
    ends = np.minimum(np.append(begins[1:], len(least)), last[np.searchsorted(at, begins, "right") - 1])
    pieces = -(-(ends - begins) // RUN)  # long runs come of periodic text
    start = np.repeat(begins, pieces) + RUN * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.minimum(start + RUN, np.repeat(ends, pieces))
    text = np.searchsorted(at, start, "right") - 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U(0)], np.cumsum(BYTE[part] * powers(BASE, len(part)))])
        content = mix((sums[end + LENGTH - 1] - sums[start]) * powers(BASE_INV, len(part))[start])
    # a gram is the minimizer of some window if it is the greatest of the minima of the windows that hold it
    most = ~sliding_least(np.concatenate([np.full(width - 1, ~U(0)), ~least, np.full(width - 1, ~U(0))]), width)
    marked = np.flatnonzero(most == hashes)
    names, rank = np.unique(hashes[marked], return_inverse=True)
    spots = np.sort(rank.astype(np.int64) * len(hashes) + marked)
    own = np.searchsorted(names, least[start]).astype(np.int64) * len(hashes)
    count = np.searchsorted(spots, own + np.minimum(end + width - 1, len(hashes)), "left") - np.searchsorted(spots, own + start, "left")
    return text, start - at[text], end - start, least[start], content, np.minimum(count, 2).astype(np.int32)


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie"))
        for i, j in slices(offsets, TEXTS):
            text, start, windows, gram, content, repeats = runs(data, offsets[i : j + 1], GRAM)
            if len(text):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + text]), pa.array(ties[i + text]), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(content.view(np.int64)), pa.array(repeats)], ["doc", "tie", "start", "size", "gram", "content", "repeats"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that stand for a content, cut out of their texts."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for k, wanted in enumerate(batch.column("wanted")):
            rows = wanted.as_py()
            cut = [data[offsets[k] + r["start"] : offsets[k] + r["start"] + r["size"] + LENGTH - 1].tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int32() if c == "size" else pa.int64()) for c in KEY] + [pa.array(cut, pa.binary())], [*KEY, "bytes"])


def _dealt_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of hot minimizers as runs of long minimizers; ``at`` is where the run begins in its content."""
    for batch in batches:
        for k in range(len(batch)):
            data = np.frombuffer(batch.column("bytes")[k].as_py(), np.uint8)
            _, start, windows, gram, _, _ = runs(data, np.array([0, len(data)]), LONG_GRAM)
            n = len(start)
            own = [pa.array([batch.column(c)[k].as_py()] * n, batch.column(c).type) for c in KEY]
            cut = [data[a : a + w + LENGTH - 1].tobytes() for a, w in zip(start.tolist(), windows.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(gram.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(cut, pa.binary())], [*KEY, "deal", "at", "bytes"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs cut into their windows of LENGTH bytes; ``at`` is where a window begins in its content."""
    for batch in batches:
        sizes = np.array([len(b) - LENGTH + 1 for b in batch.column("bytes").to_pylist()], np.int64)
        for i, j in slices(np.append(0, np.cumsum(sizes * LENGTH))):
            cut = [b[k : k + LENGTH] for b in batch.column("bytes")[i:j].to_pylist() for k in range(len(b) - LENGTH + 1)]
            row = np.repeat(np.arange(i, j), sizes[i:j])
            own = np.arange(len(row)) - np.repeat(np.cumsum(sizes[i:j]) - sizes[i:j], sizes[i:j])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in KEY], pa.array((batch.column("at").to_numpy()[row] + own).astype(np.int32)), pa.array(cut, pa.binary())], [*KEY, "at", "bytes"])


def _equal_windows(runs: DataFrame) -> DataFrame:
    """(gram, content, size, first, last) of the windows in ``runs`` whose bytes occur twice in them, whatever their number."""
    each = saved(runs.mapInArrow(_windows, "gram long, content long, size int, at int, bytes binary"), "parted")
    twice = each.groupBy("bytes").agg(F.count("*").alias("n")).where("n > 1").select("bytes", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    dealt = each.withColumn("salt", F.pmod(F.xxhash64(*KEY, "at"), F.lit(SALT)).cast("int"))
    return dealt.join(twice, ["bytes", "salt"], "left_semi").select(*KEY, F.col("at").alias("first"), (F.col("at") + 1).alias("last"))


def repeated_windows(contents: list[bytes]) -> list[np.ndarray]:
    """For each content, the places of its windows that occur anywhere else in the contents, by a suffix array over all of them."""
    lengths = np.array([len(c) + 1 for c in contents])
    joined = np.frombuffer(b"\0".join(contents) + b"\0" * (LENGTH + 16), np.uint8)
    n = int(lengths.sum())
    ends = np.cumsum(lengths) - 1
    symbols = joined[:n].astype(np.int64) + 1
    symbols[ends] = 0
    array = suffix_array(symbols, 256)
    common = common_prefixes(joined, array, LENGTH)
    owner = np.repeat(np.arange(len(contents)), lengths)
    whole = np.arange(n) + LENGTH <= ends[owner]
    # a common prefix counts if it lies within both contents; suffixes that begin with one window stand together
    high = (common == LENGTH) & whole
    high[array[1:]] &= whole[array[:-1]]
    high[array[0]] = False
    repeat = high.copy()
    repeat[array[:-1][high[array[1:]]]] = True
    places = np.flatnonzero(repeat)
    cuts = np.searchsorted(places, ends - lengths + 1)
    return [p - b for p, b in zip(np.split(places, cuts[1:]), (ends - lengths + 1).tolist(), strict=True)]


def _spans(places: np.ndarray) -> list[tuple[int, int]]:
    """Runs [a, b) of neighbouring places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.append(0, cut + 1)].tolist(), (places[np.append(cut, len(places) - 1)] + 1).tolist(), strict=True))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by ``deal``; whole groups are gathered to shards of SHARD bytes, each with one suffix array."""

    def result(rows: list[tuple]) -> pa.RecordBatch:
        found = [(r, s) for r, places in zip(rows, repeated_windows([r[-1] for r in rows]), strict=True) for s in _spans(places)]
        keys = [pa.array([r[k] for r, _ in found], pa.int32() if c == "size" else pa.int64()) for k, c in enumerate(KEY)]
        return pa.RecordBatch.from_arrays([*keys, *[pa.array([r[4] + s[x] for r, s in found], pa.int32()) for x in (0, 1)]], [*KEY, "first", "last"])

    held: list[tuple] = []
    size = group = 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*KEY, "deal", "at", "bytes")]
        for row in zip(*columns, strict=True):
            if held and row[3] != group and size >= SHARD:
                yield result(held)
                held, size = [], 0
            group = row[3]
            held.append(row)
            size += len(row[-1])
    if held:
        yield result(held)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(k, REMAINS) for whole in batches for k in range(0, len(whole), REMAINS)):
        data, offsets = utf8(batch.column("text"))
        spans = batch.column("spans").to_pylist()
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for k in range(len(batch)):
            own, kept, at, removed, n = data[offsets[k] : offsets[k + 1]].tobytes(), [], 0, 0, 0
            for a, b in sorted((s["a"], s["b"]) for s in spans[k] or ()):
                if b <= at:
                    continue
                if a > at or n == 0:
                    n += 1
                    kept.append(own[at:a])
                removed += b - max(a, at)
                at = b
            kept.append(own[at:])
            left = b"".join(kept)
            for c, v in zip(out, (len(own), removed, n, hashlib.sha256(left).hexdigest(), left), strict=True):
                out[c].append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())], ["doc_id", *out])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) for every text of ``docs`` (doc_id, text) as UTF-8 bytes.

    Each byte goes that is covered by a string of LENGTH bytes that begins at another place too, in the same text or
    another; strings are judged on the input. Null is the empty text; texts shorter than LENGTH stay whole. Rows that
    repeat are copies of each other like any others, also with one doc_id or none. Bytes that are left may be no valid UTF-8.
    """
    with small_batches(docs.sparkSession):
        return _without_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def _without_repeats(docs: DataFrame) -> DataFrame:
    named = docs.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("text", F.col("doc_id").isNull()).alias("tie"), "text")
    rows = saved(named.where(F.octet_length("text") >= LENGTH).mapInArrow(_run_rows, "doc long, tie long, start int, size int, gram long, content long, repeats int"), "runs")
    twice = saved(rows.groupBy("gram").agg(F.sum("repeats").alias("n")).where("n > 1").select("gram"), "grams")
    met = saved(rows.join(twice, "gram"), "met")
    drop(rows)
    contents = saved(met.groupBy(KEY).agg(F.count("*").alias("n"), F.max("repeats").alias("repeats"), F.min(F.struct("doc", "tie", "start")).alias("place")), "contents")
    groups = contents.groupBy("gram").agg(F.count("*").alias("contents"), F.max("repeats").alias("most")).where("contents > 1 or most > 1")
    mixed = saved(contents.join(groups, "gram").select(*KEY, "place.*", "contents"), "mixed")
    hot = saved(mixed.where(F.col("contents") > HOT).select("gram").distinct(), "hot")
    wanted = mixed.groupBy("doc", "tie").agg(F.collect_list(F.struct(*KEY, "start")).alias("wanted"))  # within one text
    texts = named.select("doc", "tie", "text").join(wanted, ["doc", "tie"])
    cut = saved(texts.mapInArrow(_contents, "gram long, content long, size int, bytes binary"), "cut")
    cold = cut.join(hot, "gram", "left_anti").select(*KEY, F.col("gram").alias("deal"), F.lit(0).alias("at"), "bytes")
    again = saved(cut.join(hot, "gram", "left_semi").mapInArrow(_dealt_again, "gram long, content long, size int, deal long, at int, bytes binary"), "again")
    large = saved(again.groupBy("deal").agg(F.sum(F.octet_length("bytes")).alias("n")).where(F.col("n") > LARGE).select("deal"), "large")
    dealt = cold.unionByName(again.join(large, "deal", "left_anti")).repartition("deal").sortWithinPartitions("deal")
    found = dealt.mapInArrow(_searched, "gram long, content long, size int, first int, last int")
    found = found.unionByName(_equal_windows(again.join(large, "deal", "left_semi")))
    whole = contents.where("n > 1").select(*KEY, F.lit(0).alias("first"), F.col("size").alias("last"))
    windows = saved(found.unionByName(whole).distinct(), "windows")
    spans = met.join(windows, KEY).select("doc", "tie", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + LENGTH - 1).alias("b"))
    by_text = saved(spans.groupBy("doc", "tie").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    drop(twice, met, contents, mixed, hot, cut, again, large, windows)
    return named.join(by_text, ["doc", "tie"], "left").select("doc_id", "text", "spans").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
