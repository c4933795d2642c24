"""k-mer tables and contigs."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sparkloom.functions.kmers import coded, following
from sparkloom.scratch import drop, saved

#: Letters of the substring by which k-mers are dealt to tasks, and about how many rows a task gets.
MINIMIZER, HELD = 9, 1 << 19
REASONS = ("length", "letter", "extension")
#: Letters of a contig in one row of its chunks.
CHUNK = 1 << 16


def width(lines: DataFrame) -> DataFrame:
    """(k): the length of the first word of a file's first line."""
    return lines.limit(1).select(F.length(F.split("value", r"\s+")[0]).alias("k"))


def parsed(lines: DataFrame, k: int) -> DataFrame:
    """(kmer, b_ext, f_ext) of fixed-width lines."""
    return lines.select(F.substring("value", 1, k).alias("kmer"), F.substring("value", k + 2, 1).alias("b_ext"), F.substring("value", k + 3, 1).alias("f_ext"))


def _fault(k: int) -> Column:
    """Why a k-mer is none: another length, other letters, unknown extensions; null if it is one."""
    return F.when(F.length("kmer") != k, "length").when(~F.col("kmer").rlike(r"^[ACGT]*\z"), "letter").when(~(F.col("b_ext").isin(*"ACGTF") & F.col("f_ext").isin(*"ACGTF")), "extension")


def faults(kmers: DataFrame, k: int) -> DataFrame:
    """(reason, n): k-mers of another length, with other letters, or with unknown extensions."""
    # a filter before the count would judge every k-mer twice
    counts = kmers.select(_fault(k).alias("fault")).agg(*[F.count_if(F.coalesce(F.col("fault") == r, F.lit(False))).alias(r) for r in REASONS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in REASONS])).alias("e")).select("e.*").where("n > 0")


def valid(kmers: DataFrame, k: int, most: float = 0.0) -> tuple[DataFrame, dict[str, int]]:
    """The k-mers that are ones, saved, and how many rows were left out for each reason, counted as they are written. More than the share ``most`` of all rows is an error."""
    seen = Observation()
    judged = kmers.withColumn("fault", _fault(k))
    counts = [F.count_if(F.coalesce(F.col("fault") == r, F.lit(False))).alias(r) for r in REASONS]
    kept = saved(judged.observe(seen, F.count("*").alias("rows"), *counts).where("fault is null").drop("fault"), "valid")
    told = {r: seen.get[r] for r in REASONS if seen.get[r]}
    if sum(told.values()) > most * seen.get["rows"]:
        drop(kept)
        raise ValueError(f"of {seen.get['rows']} k-mers these are none: {told}")
    return kept, told


def starts(kmers: DataFrame) -> DataFrame:
    return kmers.where("b_ext = 'F'")


def ends(kmers: DataFrame) -> DataFrame:
    return kmers.where("f_ext = 'F'")


def _named_as(codes: list[Column]) -> list[Column]:
    return [c.alias(f"_key{i}") for i, c in enumerate(codes)]


def _named(kmer: Column, k: int) -> list[Column]:
    """``coded`` with names to join by."""
    return _named_as(coded(kmer, k))


def _asking(target: Column, row: Column, k: int) -> list[Column]:
    """``_named`` for a row that asks for ``target``; where that is null, keys that nothing has, spread by ``row`` so that they do not meet in one task."""
    first, *more = coded(target, k)
    nothing = F.lit(-4).cast("long") - F.xxhash64(row).bitwiseAND(F.lit((1 << 62) - 1))
    return _named_as([F.when(target.isNull(), nothing).otherwise(first), *more])


def _met(asked: DataFrame, kmers: DataFrame, name: str, k: int) -> DataFrame:
    """``asked``, by ``_asking``, with ``name``: the forward extensions of the k-mers it asks for, null if missing. A sort-merge join of codes, as files do not tell how large a table of k-mers is."""
    held = kmers.select(*_named(F.col("kmer"), k), F.col("f_ext").alias(name))
    return asked.join(held.hint("merge"), _keys(k), "left")


def _keys(k: int) -> list[str]:
    return [f"_key{i}" for i in range(len(coded(F.col("kmer"), k)))]


def _after(kmer: str, f_ext: str, k: int) -> Column:
    """The k-mer that follows, null after an end."""
    return F.when(F.col(f_ext) != "F", following(F.col(kmer), F.col(f_ext), k))


def lookup(kmers: DataFrame, k: int) -> DataFrame:
    """(kmer, next, next_f): every k-mer with the one that follows it, and that one's forward extension; null where it is missing."""
    ahead = _after("kmer", "f_ext", k)
    asked = kmers.where("f_ext <> 'F'").select(*_asking(ahead, F.col("kmer"), k), "kmer", "f_ext")
    return _met(asked, kmers, "next_f", k).select("kmer", ahead.alias("next"), "next_f")


def next_two(kmers: DataFrame, k: int) -> DataFrame:
    """(kmer, next, next_f, second, second_f): every k-mer with the two that follow it and their forward extensions; one shuffle of short texts for both."""
    ahead = _after("kmer", "f_ext", k)
    joined = kmers["kmer"].isNull() | (F.coalesce(F.length(ahead), F.lit(k)) < k)
    seen = kmers.agg(F.count("*").alias("rows"), F.count_if(joined).alias("joined")).first()
    parts = max(int(kmers.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seen.rows // HELD))
    out = _dealt_ahead(kmers, k, parts).repartitionById(parts, "part").select("text").mapInArrow(_answered(k), TWO)
    return out.unionAll(_joined_two(kmers, k, joined)) if seen.joined else out


def _joined_two(kmers: DataFrame, k: int, those: Column) -> DataFrame:
    """``next_two`` of some of the k-mers by joins: for those whose next one is shorter than k, so that its letters do not tell where the second is."""
    ahead = _after("kmer", "f_ext", k)
    one = _met(kmers.where(those).select(*_asking(ahead, F.col("kmer"), k), "kmer", "f_ext"), kmers, "next_f", k)
    second = F.when(F.col("next_f") != "F", following(ahead, F.col("next_f"), k))
    two = _met(one.select(*_asking(second, F.col("kmer"), k), "kmer", "f_ext", "next_f"), kmers, "second_f", k)
    return two.select("kmer", ahead.alias("next"), "next_f", second.alias("second"), "second_f")


TWO = "kmer string, next string, next_f string, second string, second_f string"
#: What a row is to the task that gets it: one that others ask for, and one that asks there.
HAS, ASKS = 1, 2


def _dealt_ahead(kmers: DataFrame, k: int, parts: int) -> DataFrame:
    """(part, text): each row for the task of the k - 1 letters that its k-mer begins with, for that of the ones it ends with, and, as a question, for that of the k - 1 letters after
    the next one's first; mostly all are one task. There, all rows of the next k-mer and of the second are held. Rows whose next k-mer is shorter than k ask nothing."""
    size = max(1, min(MINIMIZER, k - 1))
    text, last = F.substring("kmer", 1, k), F.coalesce(F.substring("f_ext", 1, 1), F.lit(""))
    hashes = [F.xxhash64(F.substring(F.concat(text, last) if i + size > k else F.col("kmer"), i + 1, size)).alias(f"h{i}") for i in range(k - size + 2)]
    asks = F.when(F.coalesce(F.col("f_ext"), F.lit("F")) == "F", "ends").when(F.length(_after("kmer", "f_ext", k)) >= k, "asks").otherwise("not")
    known = kmers.where("kmer is not null").select("kmer", "f_ext", asks.alias("asks"), *hashes)
    home = lambda first: F.lit(0) if k == 1 else F.pmod(F.least(*named) if len(named := [F.col(f"h{i}") for i in range(first, first + k - size)]) > 1 else named[0], F.lit(parts).cast("long")).cast("int")
    homes = known.select("kmer", "f_ext", "asks", home(0).alias("p"), home(1).alias("q"), home(2).alias("r"))
    to = lambda part, role: F.struct(F.col(part).alias("part"), F.lit(role).alias("role"))
    same = F.col("p") == F.col("q")
    held = lambda mine: F.when(same, F.array(to("p", HAS + mine))).otherwise(F.array(to("p", HAS + mine), to("q", HAS)))
    each = (
        F.when((F.col("asks") == "ends") | ((F.col("asks") == "asks") & (F.col("r") == F.col("p"))), held(ASKS))
        .when(F.col("asks") == "not", held(0))
        .when(F.col("r") == F.col("q"), F.array(to("p", HAS), to("q", HAS + ASKS)))
        .otherwise(F.when(same, F.array(to("p", HAS), to("r", ASKS))).otherwise(F.array(to("p", HAS), to("q", HAS), to("r", ASKS))))
    )
    role, size_of = F.col("e.role"), F.length("f_ext")
    plain = F.concat(role.cast("string"), "f_ext", "kmer")
    odd = F.concat(F.char(role + ord("a")), size_of.cast("string"), F.lit(":"), "f_ext", "kmer")
    none = F.concat(F.char(role + ord("A")), "kmer")
    told = F.when(size_of == 1, plain).when(F.col("f_ext").isNull(), none).otherwise(odd)
    return homes.select("kmer", "f_ext", F.explode(each).alias("e")).select(F.col("e.part").alias("part"), told.alias("text"))


def _answered(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of TWO of a task's questions, in the order in which they come, so that k-mers that overlap stay together and files are small. A task holds about HELD rows."""

    def told(questions: Iterator[tuple[str, str | None]], ext: dict[str, tuple | list]) -> Iterator[tuple]:
        missing = (None,)
        for y, f in questions:
            if f is None or f == "F":
                yield y, None, None, None, None
                continue
            x = y[1:k] + f
            for g in ext.get(x, missing):
                if g is None or g == "F":
                    yield y, x, g, None, None
                    continue
                z = x[1:k] + g
                for h in ext.get(z, missing):
                    yield y, x, g, z, h

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ext, single, questions = {}, {}, []
        gc.disable()
        try:
            for batch in batches:
                for t in _listed(batch.column(0)):
                    c = t[0]
                    if c < "A":
                        role, f, kmer = ord(c) - 48, t[1], t[2:]
                    elif c < "a":
                        role, f, kmer = ord(c) - 65, None, t[1:]
                    else:
                        size, _, rest = t[1:].partition(":")
                        role, f, kmer = ord(c) - 97, rest[: int(size)], rest[int(size) :]
                    if role & HAS:
                        old = ext.get(kmer)
                        if old is None:
                            ext[kmer] = single.setdefault(f, (f,))
                        elif type(old) is tuple:
                            ext[kmer] = [*old, f]
                        else:
                            old.append(f)
                    if role & ASKS:
                        questions.append((kmer, f))
            rows = told(iter(questions), ext)
            while some := list(islice(rows, 1 << 15)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], [c.split()[0] for c in TWO.split(", ")])
        finally:
            gc.enable()

    return put


def dangling(kmers: DataFrame, k: int) -> DataFrame:
    """(kmer, next): k-mers whose successor is not in the table."""
    return lookup(kmers, k).where("next_f is null").select("kmer", "next")


def nodes(kmers: DataFrame) -> DataFrame:
    """(kmer, f_ext): one row a k-mer; of rows that repeat a k-mer the least extension counts."""
    return kmers.groupBy("kmer").agg(F.min("f_ext").alias("f_ext"))


def repeated(kmers: DataFrame) -> DataFrame:
    """(kmer, n): k-mers that several rows have."""
    return kmers.groupBy("kmer").agg(F.count("*").alias("n")).where("n > 1")


#: What is known of k-mers that follow each other and nothing else, put together: ``head`` and ``begun`` where walks begin or meet, else ``into``, the
#: k-mer before, held elsewhere (``begun``: a line for each walk, the first letter of its start); behind the last one come ``out``, itself, if what follows is held elsewhere, the fragment ``after``, the missing k-mer ``lost``, or an end.
FRAGMENT = "id long, head string, begun string, into string, out string, after long, lost string, n long, letters string"
_ID, _HEAD, _BEGUN, _INTO, _OUT, _AFTER, _LOST, _N, _LETTERS = range(9)
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
_NAMES = [c.split()[0] for c in FRAGMENT.split(", ")]
#: What a row is to the task that gets it: it holds what leads to the k-mer, what follows it, and a walk starts here.
OWN, TAIL, START = 1, 2, 4


def _rows(rows: Iterator[list]) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows``. They hold no cycles, so nothing is looked for among the many that a task has."""
    gc.disable()
    try:
        rows = iter(rows)
        while some := list(islice(rows, 1 << 15)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _TYPES, strict=True)], _NAMES)
    finally:
        gc.enable()


def _listed(column: pa.Array) -> list:
    """Texts as they are, numbers with -1 for null; far cheaper than one scalar for each."""
    return (column.fill_null(-1) if pa.types.is_integer(column.type) else column).to_numpy(zero_copy_only=False).tolist()


def _dealt(kmers: DataFrame, k: int, parts: int) -> DataFrame:
    """(part, text): each row for the task of the k - 1 letters that its k-mer begins with, and for that of the ones it ends with, if that is another.

    Letters go by their substring of least hash, which neighbours mostly share. So all rows of a k-mer, what leads to it
    and what follows it meet, by one shuffle of one short text. Rows with a null are left out.
    """
    size = max(1, min(MINIMIZER, k - 1))
    least = lambda hashes: hashes[0] if len(hashes) == 1 else F.least(*hashes)
    hashes = [F.xxhash64(F.substring("kmer", i + 1, size)) for i in range(k - size + 1)]
    inner = least(hashes[1:-1]) if len(hashes) > 2 else None
    known = kmers.where("kmer is not null and f_ext is not null").select("kmer", "f_ext", F.coalesce(F.col("b_ext") == "F", F.lit(False)).cast("int").alias("s"), hashes[0].alias("a"), hashes[-1].alias("z"), *([inner.alias("m")] if inner is not None else []))
    near = [F.col("m")] if inner is not None else []
    # k-mers of fewer letters follow each other alone; of one letter there are few
    home = lambda end, letters: F.lit(0) if k == 1 else F.pmod(F.when(F.length("kmer") >= k, least([F.col(end), *near])).otherwise(F.xxhash64(letters)), F.lit(parts).cast("long")).cast("int")
    homes = known.select("kmer", "f_ext", "s", home("a", F.expr("substr(kmer, 1, length(kmer) - 1)")).alias("p"), home("z", F.expr("substr(kmer, 2)")).alias("q"))
    to = lambda part, role: F.struct(F.col(part).alias("part"), F.lit(role).alias("role"))
    each = homes.select("kmer", "f_ext", "s", F.explode(F.when(F.col("p") == F.col("q"), F.array(to("p", OWN + TAIL))).otherwise(F.array(to("p", OWN), to("q", TAIL)))).alias("e"))
    bits = F.col("e.role") + F.col("s") * START
    plain = F.concat(bits.cast("string"), "f_ext", "kmer")
    odd = F.concat(F.char(bits + ord("a")), "f_ext", F.lit("\n"), "kmer")
    return each.select(F.col("e.part").alias("part"), F.when(F.length("f_ext") == 1, plain).otherwise(odd).alias("text"))


def _chained(ext: dict[str, str], roles: dict[str, int], begin: set[tuple[str, str]], k: int, most: int, number: int) -> Iterator[list]:
    """The fragments of one task's k-mers, numbered from ``number``; walks that end at once have one of no k-mer."""
    ahead, led, begun = {}, {}, {}
    for y, role in roles.items():
        if role & TAIL and ext[y] != "F":
            ahead[y] = x = y[1:k] + ext[y]
            if roles.get(x, 0) & OWN:
                led[x] = led.get(x, 0) + 1
    for y, f in begin:
        x = y[1:k] + f
        if f != "F" and roles.get(x, 0) & OWN:
            begun.setdefault(x, []).append(y[:1] if len(y) <= k else y + f)
        else:
            yield [number, y[1:] + (f if f != "F" else ""), y[:1], None, None, None, x if f != "F" else None, 0, ""]
            number += 1
    heads = {}
    for x, role in roles.items():
        if role & OWN and (x in begun or led.get(x, 0) > 1):
            heads[x] = number
            number += 1
    todo = [(None, x) for x, role in roles.items() if role & OWN and (x in heads or x not in led)]
    todo += [(y, ahead[y]) for y, role in roles.items() if not role & OWN and y in ahead]
    while todo:
        into, x = todo.pop()
        first, own, letters, n = x, heads.get(x) if into is None else None, [], 0
        out = after = lost = None
        while True:
            if into is not None or n:  # what x is to the one before it
                if not roles.get(x, 0) & OWN:
                    lost = x
                    break
                if x in heads:
                    after = heads[x]
                    break
                if n == most:
                    out = last
                    todo.append((last, x))
                    break
            last, f = x, ext[x]
            n += 1
            if f == "F":
                break
            letters.append(f)
            if x not in ahead:
                out = x
                break
            x = ahead[x]
        if own is None:
            if into is None and out is None:
                continue  # nothing leads here
            own = number
            number += 1
        seen = into is None and first in heads
        yield [own, first if seen else None, "\n".join(begun[first]) if seen and first in begun else None, into, out, after, lost, n, "".join(letters)]


def _fragments(kmers: DataFrame, k: int, most: int) -> DataFrame:
    """FRAGMENT rows of at most ``most`` k-mers each; of rows that repeat a k-mer the least extension counts. A task holds about HELD rows' distinct k-mers. Rings that nothing leads into are left out."""
    parts = max(int(kmers.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kmers.count() // HELD))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ext, roles, begin = {}, {}, set()
        for batch in batches:
            for t in _listed(batch.column(0)):
                if t[0] < "a":
                    role, f, kmer = ord(t[0]) - 48, t[1], t[2:]
                else:
                    f, _, kmer = t[1:].partition("\n")
                    role = ord(t[0]) - 97
                old = ext.get(kmer)
                if old is None:
                    ext[kmer], roles[kmer] = f, role & 3
                else:
                    roles[kmer] |= role & 3
                    if f < old:
                        ext[kmer] = f
                if role & START and role & TAIL:
                    begin.add((kmer, f))
        yield from _rows(_chained(ext, roles, begin, k, most, TaskContext.get().partitionId() << 33))

    return _dealt(kmers, k, parts).repartitionById(parts, "part").select("text").mapInArrow(put, FRAGMENT)


def _linked(rows: list[tuple], most: int) -> Iterator[list]:
    """``rows`` with those put together that follow each other here, up to ``most`` k-mers; rings are left out, and what nothing leads to once it is whole."""
    follows = {r[_INTO]: r for r in rows if r[_INTO] is not None}
    outs = {r[_OUT] for r in rows if r[_OUT] is not None}
    for r in rows:
        if r[_INTO] in outs:
            continue
        letters = [r[_LETTERS]]
        while True:
            behind = follows.get(r[_OUT]) if r[_OUT] is not None else None
            whole = behind is None or r[_N] + behind[_N] > most
            if whole:
                if r[_INTO] is not None or r[_HEAD] is not None or r[_OUT] is not None:
                    yield [*r[:_AFTER], None if r[_AFTER] == -1 else r[_AFTER], r[_LOST], r[_N], "".join(letters)]
                if behind is None:
                    break
                r, letters = behind, [behind[_LETTERS]]
            else:
                r = [*r[:_OUT], *behind[_OUT:_N], r[_N] + behind[_N], ""]
                letters.append(behind[_LETTERS])


def _contracted(fragments: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """The fragments that are whole, those that are not (or None), and the saved tables that both read.

    In each round a fragment goes to the task of the k-mer before it or of its own last one, whichever has the lesser hash of the round,
    and is put together with what it meets there: at least the local minima of every chain, so a third of all links. It ends where
    nothing is left or little changes, as in chains of fragments of ``most`` k-mers.
    """
    open_ends = "into is not null or out is not null"
    now = saved(fragments, "fragments")
    parts, whole = [now], [now.where(f"not ({open_ends})")]
    active, turn = now.where(open_ends), 0
    left = active.count()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(_linked([r for b in batches for r in zip(*map(_listed, b.columns), strict=True)], most))

    while left:
        by = lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: E731, B023
        key = F.when(F.col("into").isNull() | (F.col("out").isNotNull() & (by("out") < by("into"))), F.col("out")).otherwise(F.col("into"))
        now = saved(active.repartition(-(-4 * left // HELD), key).mapInArrow(put, FRAGMENT), "fragments")
        parts.append(now)
        whole.append(now.where(f"not ({open_ends})"))
        active, turn, before = now.where(open_ends), turn + 1, left
        left = active.count()
        if left > 0.9 * before:
            break
    return reduce(DataFrame.unionAll, whole), active if left else None, parts


def _segments(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(id, seg, pos, steps) and the saved tables that it reads: each fragment of ``links`` (id, single, n, next) with the head of its segment, and how many k-mers and fragments behind it is.

    A segment is a run of fragments that each follow the one before and nothing else; it begins where walks begin or
    meet. Each round doubles how far back a fragment points, until it points to a head; finished ones are not
    joined again, so that no two rows of a round share a key. What is unfinished after as many rounds as the longest
    run can need are rings that no walk enters; they are left out.
    """
    ends = links.where("single").select("id").withColumnRenamed("id", "next")
    before = links.select(F.col("id").alias("back"), "n", "next").join(ends, "next").select(F.col("next").alias("id"), "back", "n")  # one for each
    zero = F.lit(0).cast("long")
    at = links.select("id").join(before, "id", "left").select("id", F.coalesce("back", "id").alias("back"), F.coalesce("n", zero).alias("pos"), F.col("back").isNotNull().cast("long").alias("steps"), F.col("back").isNull().alias("done"))
    now = saved(at, "back")
    parts, active = [now], now.where("not done")
    left = active.count()
    done = [now.where("done")]
    for _ in range(max(1, left).bit_length() + 1):
        if not left:
            break
        at = reduce(DataFrame.unionAll, [*done, active])  # a finished fragment is a hop for those behind it
        hops = at.select(F.col("id").alias("back"), F.col("back").alias("far"), F.col("pos").alias("over"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        now = saved(active.join(hops, "back").select("id", F.col("far").alias("back"), (F.col("pos") + F.col("over")).alias("pos"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done")), "back")
        parts.append(now)
        done.append(now.where("done"))
        active = now.where("not done")
        left = active.count()
    return reduce(DataFrame.unionAll, done).select("id", F.col("back").alias("seg"), "pos", "steps"), parts


def _paths(begun: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(walk, seg, nth, at), saved: every segment of every walk of ``begun`` (walk, next), with its number and how many k-mers come before it; (walk, seg), saved: the walks that run into a ring, and the segment that they meet again; and the rounds it took.

    ``segments`` is (seg, n, after). Each round doubles both what is known of a walk and how far a table of jumps
    leads: after r rounds a walk has its first 2**r segments, and every one of them jumps 2**r further. So the rounds grow with
    the logarithm of the longest walk, and what is written with the result.
    """
    parts = [saved(begun.where("next is not null").select("walk", F.col("next").alias("seg"), F.lit(0).cast("long").alias("nth"), F.lit(0).cast("long").alias("at")), "paths")]
    jumps = saved(segments.where("after is not null").select("seg", F.col("after").alias("to"), F.col("n").alias("over")), "jumps")
    ringed, rounds = [], 0
    while True:
        active = reduce(DataFrame.unionAll, parts)
        for r in ringed:
            active = active.join(r.select("walk"), "walk", "left_anti")
        new = saved(active.join(jumps, "seg").select("walk", F.col("to").alias("seg"), (F.col("nth") + F.lit(1 << rounds)).alias("nth"), (F.col("at") + F.col("over")).alias("at")), "paths")
        rounds += 1
        if new.isEmpty():
            drop(new)
            break
        parts.append(new)
        known = reduce(DataFrame.unionAll, parts)
        again = known.groupBy("walk", "seg").agg(F.count("*").alias("n"), F.min("nth").alias("nth")).where("n > 1")
        if ringed:
            again = again.join(reduce(DataFrame.unionAll, ringed).select("walk"), "walk", "left_anti")
        ringed.append(saved(again.groupBy("walk").agg(F.min_by("seg", "nth").alias("seg")), "ringed"))
        ahead = jumps.select(F.col("seg").alias("to"), F.col("to").alias("further"), F.col("over").alias("more"))
        longer = saved(jumps.join(ahead, "to").select("seg", F.col("further").alias("to"), (F.col("over") + F.col("more")).alias("over")), "jumps")
        drop(jumps)
        jumps = longer
    rings = saved(reduce(DataFrame.unionAll, ringed) if ringed else parts[0].select("walk", "seg").limit(0), "rings")
    # a walk in a ring has each segment once: the first time
    first = F.row_number().over(Window.partitionBy("walk", "seg").orderBy("nth"))
    known = reduce(DataFrame.unionAll, parts)
    whole = known.join(rings.select("walk"), "walk", "left_anti").unionAll(known.join(rings.select("walk"), "walk").withColumn("first", first).where("first = 1").select(*known.columns))
    out = saved(whole, "paths")
    drop(*parts, *ringed, jumps)
    return out, rings, rounds


class Walks:
    """The walks forwards from every start of ``kmers``; tables in the shared folder until ``drop``.

    ``short`` (contig, n_nodes, next, ended): the walks along one fragment, read from it. The others: ``walks`` (walk, n_nodes, next, ended)
    and ``pieces`` (walk, at, text), the text of each in pieces of at most ``chunk`` letters, or of a k-mer and one letter. ``ended`` is false where a walk
    stops before an end, at the k-mer ``next``, which is missing or closes a ring. A start is a row without a k-mer before it; rows that repeat
    start once. Walks that meet go on alike, each to its own contig. No task holds a whole walk of more than ``chunk`` k-mers.
    """

    def __init__(self, kmers: DataFrame, k: int, chunk: int = CHUNK):
        whole, rest, self.parts = _contracted(_fragments(kmers, k, chunk), chunk)
        start = F.when(F.length("e") > 1, F.col("e")).otherwise(F.concat("e", "head"))
        simple = whole.where("after is null").select(F.explode(F.split("begun", "\n")).alias("e"), "head", "letters", "n", "lost")
        self.short = simple.select(F.concat(start, "letters").alias("contig"), (1 + F.col("n")).alias("n_nodes"), F.col("lost").alias("next"), F.col("lost").isNull().alias("ended"))
        self.walks = self.pieces = None
        self.rounds = 0
        met = whole.where("after is not null")
        if rest is None and met.isEmpty():
            return
        begun, names = met.select("id", "head", "begun"), whole.select("id", "head")
        segments = whole.select(F.col("id").alias("seg"), "n", "lost", "after")
        texts = whole.select(F.col("id").alias("seg"), F.lit(0).cast("long").alias("from"), F.col("letters").alias("text"))
        held: list[DataFrame] = []
        if rest is not None:
            ids = rest.where("into is not null").select(F.col("into").alias("out"), F.col("id").alias("next"))
            links = saved(rest.select("id", F.col("into").isNotNull().alias("single"), "n", "out").join(ids, "out", "left").select("id", "single", "n", "next"), "links")
            placed, back = _segments(links)
            letters = saved(placed.join(rest.select("id", "n", "letters", "lost", "after"), "id").select("seg", "pos", "steps", "n", "letters", "lost", "after"), "letters")
            drop(links, *back)
            last = F.max_by(F.struct("lost", "after"), "steps")
            segments = segments.unionAll(letters.groupBy("seg").agg(F.sum("n").alias("n"), last.alias("last")).select("seg", "n", "last.lost", "last.after"))
            texts = texts.unionAll(letters.select("seg", F.col("pos").alias("from"), F.col("letters").alias("text")))
            begun, names = begun.unionAll(rest.select("id", "head", "begun")), names.unionAll(rest.select("id", "head"))
            held.append(letters)
        first = saved(begun.select(F.col("id").alias("next"), "head", F.explode(F.split("begun", "\n")).alias("e")).select(F.monotonically_increasing_id().alias("walk"), start.alias("start"), "next"), "begun")
        paths, rings, self.rounds = _paths(first, segments)
        ends = paths.join(segments.select("seg", "n", "lost"), "seg").groupBy("walk").agg(F.sum("n").alias("n"), F.max_by("lost", "nth").alias("stops"))
        closed = rings.join(names.select(F.col("id").alias("seg"), F.col("head").alias("again")), "seg").select("walk", "again")
        told = first.join(ends, "walk").join(closed, "walk", "left").select("walk", (1 + F.col("n")).alias("n_nodes"), F.coalesce("again", "stops").alias("next"))
        self.walks = saved(told.withColumn("ended", F.col("next").isNull()), "walks")
        more = paths.join(texts, "seg").select("walk", (F.lit(k + 1) + F.col("at") + F.col("from")).alias("at"), "text")
        self.pieces = saved(first.select("walk", F.lit(0).cast("long").alias("at"), F.col("start").alias("text")).unionAll(more), "pieces")
        drop(first, paths, rings, *held)

    def long(self) -> DataFrame | None:
        """(contig, n_nodes, next, ended) of the walks beside ``short``: each one's text in one row."""
        if self.walks is None:
            return None
        text = self.pieces.groupBy("walk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x.text), "").alias("contig"))
        return self.walks.join(text, "walk").select("contig", "n_nodes", "next", "ended")

    def texts(self) -> DataFrame:
        """(contig, n_nodes, next, ended): each walk's text in one row."""
        return self.short if self.walks is None else self.short.unionAll(self.long())

    def drop(self) -> None:
        drop(self.walks, self.pieces, *self.parts)


def walks(kmers: DataFrame, k: int) -> DataFrame:
    """(contig, n_nodes, next, ended) of ``Walks``, saved; short ones are read from their fragments and not written again."""
    found = Walks(kmers, k)
    if found.walks is None:
        return found.short
    out = found.short.unionAll(saved(found.long(), "walks"))
    drop(found.walks, found.pieces)
    return out


def contigs(kmers: DataFrame, k: int) -> DataFrame:
    """(contig, n_nodes) for every start whose walk reaches an end; ``broken`` has the others."""
    return walks(kmers, k).where("ended").select("contig", "n_nodes")


def contig_chunks(kmers: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """(start, n_nodes, chunk, text): the contigs in chunks of ``chunk`` letters (k + 1 or more), the last one shorter; a contig of any length is never in one row or one task."""
    if chunk <= k:
        raise ValueError("chunk must be k + 1 or more")
    found = Walks(kmers, k, chunk)
    start = F.expr(f"substr(contig, 1, {k})").alias("start")
    # the text of a short walk is at most chunk and k + 1 letters
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("contig") - 1) / chunk).cast("long"))).alias("chunk")
    short = found.short.where("ended and contig <> ''").select("contig", "n_nodes", at).select(start, "n_nodes", "chunk", F.expr(f"substr(contig, cast(chunk * {chunk} + 1 as int), {chunk})").alias("text"))
    if found.walks is None:
        return short
    # a piece lies in one chunk or two
    size, at = F.char_length("text"), F.col("at")
    first = chunk - at % chunk
    halves = F.array(F.struct(at.alias("at"), F.expr(f"substring(text, 1, cast({chunk} - at % {chunk} as int))").alias("text")), F.struct((at + first).alias("at"), F.expr(f"substring(text, cast({chunk} - at % {chunk} as int) + 1)").alias("text")))
    parts = found.pieces.where(size > 0).select("walk", F.explode(F.when(size > first, halves).otherwise(F.slice(halves, 1, 1))).alias("p"))
    lists = parts.groupBy("walk", F.floor(F.col("p.at") / chunk).cast("long").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x.text), "").alias("text"))
    starts_of = found.pieces.where("at = 0").select("walk", F.expr(f"substr(text, 1, {k})").alias("start"))
    long = saved(found.walks.where("ended").join(starts_of, "walk").join(lists, "walk").select("start", "n_nodes", "chunk", "text"), "chunks")
    drop(found.walks, found.pieces)
    return short.unionAll(long)


def broken(kmers: DataFrame, k: int) -> DataFrame:
    """(contig, n_nodes, next) of the walks that stop before an end: as far as they came, and the k-mer that is missing or closes a ring."""
    return walks(kmers, k).where("not ended").select("contig", "n_nodes", "next")


def stats(found: DataFrame) -> DataFrame:
    """(n_contigs, n_nodes): as the assembly reports them."""
    return found.agg(F.count("*").alias("n_contigs"), F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("n_nodes"))
