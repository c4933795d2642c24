"""Shards of near equal bytes by histogram sort. DataFrame functions only.

Rows are ordered by (hash of text, hash of doc_id, row). To part that order into shards, the bytes below candidate
boundaries are counted exactly, over all partitions at once: each round cuts the range in which a splitter is sought into
2**BITS candidates, and goes on in the one between whose ends the wanted number of bytes lies, until an end is near
enough. Rows are then exchanged once, each to a piece of its shard. Equal texts lie side by side: a splitter parts them
only where none beside them is within the tolerance.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.marks import fresh
from sparkloom.scratch import drop, saved

SHARDS, LAW = 16, "bytes"
#: How far from its share of bytes, in shares, a splitter may be where rows allow it.
TOLERANCE = 0.001
BITS = 12
KEYS = ("k1", "k2", "k3")
LEAST, WIDTH = -(1 << 63), 64
#: Pieces to a shuffle partition, and the rows that are worth one.
PIECES, PIECE_ROWS = 4, 1000


@dataclass(frozen=True)
class Bracket:
    """A range of keys: ``above`` fixes the first keys, the next one lies in [low, low + 2**bits); ``below`` bytes come before it."""

    above: tuple[int, ...] = ()
    low: int = LEAST
    bits: int = WIDTH
    below: int = 0

    @property
    def step(self) -> int:
        """Bits within a candidate's range."""
        return max(0, self.bits - BITS)

    def holds(self) -> Column:
        fixed = [F.col(k) == v for k, v in zip(KEYS, self.above, strict=False)]
        return reduce(Column.__and__, fixed, F.lit(True) if self.bits == WIDTH else F.shiftright(self.key, self.bits) == (self.low >> self.bits))

    @property
    def key(self) -> Column:
        return F.col(KEYS[len(self.above)])

    def candidate(self) -> Column:
        return F.shiftright(self.key, self.step) - (self.low >> self.step)

    def within(self, k: int, below: int) -> Bracket:
        """The range between candidates k and k + 1; one of a single key is parted by the next key."""
        low = self.low + (k << self.step)
        return replace(self, low=low, bits=self.step, below=below) if self.step else Bracket((*self.above, low), below=below)


@dataclass(frozen=True)
class Splitter:
    """Rows whose keys come before these, compared in order, are below."""

    keys: tuple[int, ...]

    def below(self) -> Column:
        last = F.lit(True) if self.keys[-1] > -LEAST - 1 else F.col(KEYS[len(self.keys) - 1]) < self.keys[-1]
        for name, value in reversed(list(zip(KEYS, self.keys[:-1], strict=False))):
            last = (F.col(name) < value) | ((F.col(name) == value) & last)
        return last


def splitters(keyed: DataFrame, total: int, shards: int, tolerance: float) -> list[Splitter]:
    """The places that part the rows of ``keyed`` (k1, k2, k3, size), of ``total`` bytes, into shards. A round counts 2**BITS candidates for each splitter, whatever the number of rows."""
    near = int(tolerance * total / shards)
    sought = {t: Bracket() for t in range(1, shards)} if total else {}
    found: dict[int, Splitter] = {}
    while sought:
        brackets = sorted(set(sought.values()), key=lambda b: (b.above, b.low))
        at = F.coalesce(*[F.when(b.holds(), F.struct(F.lit(n).alias("bracket"), b.candidate().alias("k"))) for n, b in enumerate(brackets)])
        counted = keyed.select(at.alias("at"), "size").where("at is not null").groupBy("at.bracket", "at.k").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # at most 2**BITS rows a bracket
        parts = {b: sorted((r.k, r.bytes, r.n) for r in counted if r.bracket == n) for n, b in enumerate(brackets)}
        for t, b in list(sought.items()):
            wanted, low = t * total // shards, b.below
            for k, size, n in parts[b]:
                if wanted < low + size or k == parts[b][-1][0]:
                    break
                low += size
            before, after = wanted - low, low + size - wanted
            if min(before, after) <= near or n == 1:
                found[t] = Splitter((*b.above, b.low + ((k + (after < before)) << b.step)))
                del sought[t]
            else:
                sought[t] = b.within(k, low)
    return [found[t] for t in sorted(found)]


def byte_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and, if ``carry`` names columns of ``docs`` (doc_id, text), a struct ``carried`` of them. One row for each of ``docs``.

    size is the text's bytes in UTF-8 and 1, text_crc32 their checksum; a null text has no bytes. A shard's bytes differ from
    the total / ``shards`` by at most 2 * ``tolerance`` of it, and by the rows that lie on its borders where these are larger than that. slot numbers a
    shard's rows from 0, in the order of pieces that are ranges of the text's hash. Equal texts are neighbours; only where they
    are too many for the tolerance are they parted, by doc_id's hash, and rows alike in both by their place in the input. law is
    ``bytes``; another number of shards moves all borders, so grown_shard is null. Null and repeated doc_ids are kept as they are, an empty
    table gives an empty one, columns of any names may be carried.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    doc_id = F.col("doc_id").cast("long")
    held = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    keyed = saved(docs.select(doc_id.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64(doc_id).alias("k2"), F.monotonically_increasing_id().alias("k3"), *held), "keyed")
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    places = splitters(keyed.select(*KEYS, "size"), total.bytes, shards, tolerance)
    shard = reduce(Column.__add__, [F.when(p.below(), 0).otherwise(1) for p in places], F.lit(0))

    # pieces: ranges of k1, the large ones dealt further by row; their number depends on the shuffle partitions, not on the rows
    rows = max(PIECE_ROWS, total.n // (PIECES * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bits = max(1, (total.n // rows).bit_length())
    placed = keyed.withColumns({"shard": shard, "range": F.shiftright("k1", WIDTH - bits)})
    large = placed.groupBy("shard", "range").agg(F.ceil(F.count("*") / rows).alias("parts"))
    large = saved(large, "ranges")
    piece = F.pmod(F.xxhash64("k3"), F.col("parts"))
    placed = placed.join(F.broadcast(large), ["shard", "range"]).withColumn("part", piece)  # at most 2**bits + 2 * shards rows
    counts = saved(placed.groupBy("shard", "range", "part").agg(F.count("*").alias("n")), "pieces")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = saved(counts.select("shard", "range", "part", before.alias("before")), "offsets")
    drop(counts)
    nth = F.row_number().over(Window.partitionBy("shard", "range", "part").orderBy(*KEYS)) - 1
    numbered = placed.withColumn("nth", nth).join(F.broadcast(offsets), ["shard", "range", "part"])  # about PIECES for each shuffle partition
    return numbered.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("before") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["carried"] if carry else []))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE) -> None:
    """The rows of ``docs`` as Parquet, a folder for each shard; a file's rows are in the order of their slots."""
    name = fresh(docs, "shard")
    found = byte_shards(docs, shards, tolerance, tuple(docs.columns))
    found.sortWithinPartitions("shard", "slot").select(F.col("shard").alias(name), "carried.*").write.partitionBy(name).parquet(path)
