"""MinHash near-duplicates by an inverted join of signature coordinates.

Every distinct shingle set has COORDINATES minima, hence as many tokens (coordinate, value); two sets of Jaccard
similarity 0.75 agree in 96 of 128 coordinates on average, and in fewer than MATCHES with a chance of 3.5e-5 (of 1e-8 at
0.8). Sets that have fewer than SIFT_MATCHES of their first SIFT tokens in common with any other set (a chance of
4e-7 for a linked one) go no further. The tokens of the others are put in one global order, the rarest first; two
signatures with MATCHES common tokens have one in common among the first COORDINATES - MATCHES + 1 of each, so only
those prefixes are posted (prefix filter), and tokens that one set alone has are never posted. Pairs that are already
in one component are skipped: ROUNDS times the documents outside each list's largest component count their collisions
with one head of that component, and the best of these pairs is confirmed on whole shingle sets. The lists that then
still hold several components are put together by their largest one, and the documents outside it meet the others of these lists, in
tasks of two bounded blocks each. A task first counts the common coordinates of whole signatures; only documents with a partner
that reaches MATCHES meet again with their shingle sets, and only links that join components leave a task.

Texts are read in each pass but never shuffled whole: of the documents whose sets are needed, a bitmap of fixed size
leaves out the others before the join. Joins with tables that grow with the corpus are merged at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.components import connected_components
from sparkloom.llm.marks import marks, parted
from sparkloom.llm.text_hash import U, mix, text_shingles
from sparkloom.scratch import drop, saved, small_batches

WIDTH, PERCENT = 5, 75
COORDINATES, MATCHES = 128, 76
SIFT, SIFT_MATCHES = 24, 7
ROUNDS = 2
BLOCK = 2**18
#: Where a class's text is found.
PLACE = ["doc_id", "own_text"]
_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**64, COORDINATES, dtype=U) | U(1)
_B = _rng.integers(0, 2**64, COORDINATES, dtype=U)


def signature(shingles: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    """The minimum of each of the first n hash functions over a set of shingle hashes."""
    out = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            out = np.minimum(out, ((shingles[i : i + 4096, None] * _A[:n] + _B[:n]) >> U(32)).astype(np.uint32).min(axis=0))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 2000):
            part = batch.slice(k, 2000)
            sizes, k1, k2, sigs = [], [], [], []
            for s in text_shingles(part.column("text"), WIDTH):
                sizes.append(len(s))
                with np.errstate(over="ignore"):
                    k1.append(mix(s).sum(dtype=U))
                    k2.append(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U))
                sigs.append(signature(s))
            values = np.concatenate(sigs).view(np.int32) if sigs else np.zeros(0, np.int32)
            carried = [c for c in ("carried",) if c in part.schema.names]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("own_text"), *map(part.column, carried), pa.array(sizes, pa.int64()), pa.array(np.array(k1, U).view(np.int64)), pa.array(np.array(k2, U).view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * COORDINATES), pa.array(values))],
                ["doc_id", "own_text", *carried, "n_shingles", "k1", "k2", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 500):
            part = batch.slice(k, 500)
            found = list(text_shingles(part.column("text"), WIDTH))
            offsets = np.cumsum([0, *map(len, found)])
            values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            others = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(part.column, others), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], [*others, "shingles"])


def _with_sets(texts: DataFrame, sigs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (rep, further columns), each with its class's shingle set, saved."""
    keyed = saved(wanted.join(sigs.select("rep", *PLACE).hint("merge"), "rep"), "wanted")
    bitmap = marks(keyed, PLACE)
    found = parted(texts, PLACE, bitmap)[0].groupBy(*PLACE).agg(F.first("text").alias("text"))  # rows that repeat count once
    types = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in wanted.columns)
    out = saved(found.join(keyed.hint("merge"), PLACE).select(*wanted.columns, "text").mapInArrow(_sets, f"{types}, shingles array<long>"), "sets")
    drop(bitmap, keyed)
    return out


def _tokens(sigs: DataFrame, n: int = COORDINATES) -> DataFrame:
    """(rep, token) for each of the first n coordinates, a token being the coordinate and its value in one long."""
    each = sigs.select("rep", F.posexplode(F.slice("sig", 1, n)).alias("coordinate", "value"))
    return each.select("rep", (F.shiftleft(F.col("coordinate").cast("long"), 32) + F.col("value").cast("long") + 2**31).alias("token"))


def _sifted(classes: DataFrame) -> DataFrame:
    """(rep, doc_id, own_text, sig, n) of each class that has SIFT_MATCHES of its first SIFT tokens in common with others."""
    tokens = _tokens(classes, SIFT)
    counts = tokens.groupBy("token").count().where("count > 1").select("token")
    ids = saved(tokens.join(counts.hint("merge"), "token").groupBy("rep").count().where(F.col("count") >= SIFT_MATCHES).select("rep"), "sifted")
    bitmap = marks(ids, ["rep"])
    found = parted(classes.select("rep", *PLACE, "sig", F.col("n_shingles").alias("n")), ["rep"], bitmap)[0]
    out = saved(found.join(ids.hint("merge"), "rep"), "signatures")
    drop(ids, bitmap)
    return out


def _postings(sigs: DataFrame) -> DataFrame:
    """(token, rep) for the tokens in each signature's prefix that another signature has too."""
    tokens = _tokens(sigs)
    counts = tokens.groupBy("token").count().where("count > 1")
    own = Window.partitionBy("rep")
    ranked = tokens.join(counts.hint("merge"), "token").withColumns({"place": F.row_number().over(own.orderBy("count", "token")), "n": F.count("*").over(own)})
    return saved(ranked.where(F.col("place") + COORDINATES - F.col("n") <= COORDINATES - MATCHES + 1).select("token", "rep"), "postings")


def _placed(postings: DataFrame, component: DataFrame | None) -> DataFrame:
    """(token, rep, component, largest): the lists that hold several components, with each list's largest one."""
    if component is None:
        placed = postings.withColumn("component", F.col("rep"))
    else:
        named = component.select(F.col("node").alias("rep"), F.col("component").alias("found"))
        placed = saved(postings.join(named.hint("merge"), "rep", "left").select("token", "rep", F.coalesce("found", "rep").alias("component")), "placed")
    sizes = placed.groupBy("token", "component").agg(F.count("*").alias("n"))
    lists = sizes.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("parts"))
    lists = saved(lists.where("parts > 1").select("token", "largest"), "lists")
    rest = saved(placed.join(lists.hint("merge"), "token"), "rest")
    drop(placed if component is not None else None, lists)
    return rest


def _head_links(rest: DataFrame, sigs: DataFrame, texts: DataFrame, turn: int) -> DataFrame:
    """Links (a, b) between a document outside its lists' largest components and the head that it collides with most often.

    A list's head is the document of its largest component with the least hash, another one each turn. Collisions are
    counted by pair; pairs with MATCHES common coordinates are confirmed on whole shingle sets.
    """
    inside = rest.where("component = largest").groupBy("token").agg(F.min_by("rep", F.xxhash64("rep", F.lit(turn))).alias("hub"))
    pairs = rest.where("component <> largest").join(inside.hint("merge"), "token").groupBy("rep", "hub").count()
    best = saved(pairs.groupBy("rep").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub")), "heads")
    hub_sigs = sigs.select(F.col("rep").alias("hub"), F.col("sig").alias("hub_sig"))
    agree = F.size(F.filter(F.zip_with("sig", "hub_sig", lambda x, y: x == y), lambda x: x))
    close = best.join(sigs.select("rep", "sig").hint("merge"), "rep").join(hub_sigs.hint("merge"), "hub").where(agree >= MATCHES)
    close = saved(close.select("rep", "hub"), "close")
    wanted = saved(close.unionAll(close.select(F.col("hub").alias("rep"), "hub").distinct()), "wanted")
    sets = _with_sets(texts, sigs, wanted)
    hubs = sets.where("rep = hub").select("hub", F.col("shingles").alias("hub_set")).dropDuplicates(["hub"])
    both = sets.where("rep <> hub").join(hubs.hint("merge"), "hub").withColumn("common", F.size(F.array_intersect("shingles", "hub_set")).cast("long"))
    linked = 100 * F.col("common") >= PERCENT * (F.size("shingles") + F.size("hub_set") - F.col("common"))
    links = saved(both.where(linked).select(F.col("rep").alias("a"), F.col("hub").alias("b")), "links")
    drop(best, close, wanted, sets)
    return links


TASK = ["largest", "inside", "i", "j"]


def _members(rest: DataFrame, sizes: DataFrame) -> DataFrame:
    """(rep, component, n, tasks): which block comparisons a document takes part in, for documents of lists with one largest component.

    The documents outside the largest component (x of them in blocks) meet each other and those inside it (y blocks), one
    task for two blocks; a block is a share of the documents dealt by a hash, of about BLOCK longs whatever the group's size.
    """
    members = saved(rest.select("largest", "rep", "component").distinct().join(sizes.hint("merge"), "rep"), "members")
    outside, weight = F.col("component") != F.col("largest"), F.col("n") + COORDINATES
    blocks = lambda rows: F.coalesce(F.ceil(F.sum(F.when(rows, weight)) / BLOCK), F.lit(0))
    counted = saved(members.groupBy("largest").agg(blocks(outside).alias("x"), blocks(~outside).alias("y")), "blocks")
    dealt = members.join(counted.hint("merge"), "largest")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(outside, F.col("x")).otherwise(F.col("y"))))

    def task(inside, i, j, left, right):
        return F.struct("largest", F.lit(inside).alias("inside"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))

    own, yes, no = F.col("block"), F.lit(True), F.lit(False)
    all_x, all_y = (F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>")) for n in "xy")
    with_x = F.transform(all_x, lambda k: task(False, F.least(own, k), F.greatest(own, k), own <= k, own >= k))
    with_y = F.transform(all_y, lambda k: task(True, own, k, yes, no))
    from_y = F.transform(all_x, lambda k: task(True, k, own, no, yes))
    tasks = F.when(outside, F.concat(with_x, with_y)).otherwise(from_y)
    out = saved(dealt.select("rep", "component", "n", F.explode(tasks).alias("task")).select("rep", "component", "n", "task.*"), "tasks")
    drop(members, counted)
    return out


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a has in common with each of b, by products of incidence matrices of 4096 values each."""
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s]), len(s)) for s in (a, b)]
    shared, out = np.intersect1d(sides[0][0], sides[1][0]), np.zeros((len(a), len(b)), np.int64)
    for k in range(0, len(shared), 4096):
        part, matrices = shared[k : k + 4096], []
        for values, rows, n in sides:
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            matrix = np.zeros((n, len(part)), np.float32)
            matrix[rows[hit], at[hit]] = 1
            matrices.append(matrix)
        out += (matrices[0] @ matrices[1].T).astype(np.int64)
    return out


def _forest(pairs: np.ndarray) -> list[int]:
    """The positions of those pairs that join two trees, taken in order."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    for k, (x, y) in enumerate(pairs.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(k)
    return out


def _near(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, near): the rows of the two blocks, and which of them may be linked: other components, MATCHES equal coordinates, sizes that allow it."""
    component, sizes = table["component"].to_numpy(), table["n"].to_numpy()
    sig = np.ascontiguousarray(table["sig"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES).T)
    left, right = (np.flatnonzero(table[n].to_numpy()) for n in ("left", "right"))
    agree = np.zeros((len(left), len(right)), np.uint8)
    for c in sig:
        agree += c[left, None] == c[right]
    low, high = np.minimum(sizes[left, None], sizes[right]), np.maximum(sizes[left, None], sizes[right])
    return left, right, (agree >= MATCHES) & (component[left, None] != component[right]) & (100 * low >= PERCENT * high)


def _block_partners(table: pa.Table) -> pa.Table:
    """The rows of two blocks that have a possible link, without their signatures."""
    left, right, near = _near(table)
    found = np.union1d(left[near.any(axis=1)], right[near.any(axis=0)])
    return table.drop_columns(["sig"]).take(pa.array(found, pa.int64()))


def _block_links(table: pa.Table) -> pa.Table:
    """Links (a, b) that join the components of two blocks: MATCHES equal coordinates, then the whole shingle sets."""
    rep, component = table["rep"].to_numpy(), table["component"].to_numpy()
    lists = table["shingles"].combine_chunks()
    ends, values = np.cumsum(lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    sizes = np.diff(ends, prepend=0)
    left, right, near = _near(table)
    left, right, near = left[near.any(axis=1)], right[near.any(axis=0)], near[near.any(axis=1)][:, near.any(axis=0)]
    found = np.zeros((0, 2), np.int64)
    if len(left):
        common = _common(*([values[ends[k] - sizes[k] : ends[k]] for k in side] for side in (left, right)))
        x, y = np.nonzero(near & (100 * common >= PERCENT * (sizes[left, None] + sizes[right] - common)))
        found = np.stack([left[x], right[y]], axis=1)
        found = found[_forest(component[found])]
    return pa.table({"a": pa.array(rep[found[:, 0]], pa.int64()), "b": pa.array(rep[found[:, 1]], pa.int64())})


def _links_outside(rest: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between different components, found block by block: by signatures first, then with the sets of documents that have a possible partner."""
    tasks = _members(rest, sigs.select("rep", "n"))
    side = ", ".join(f"{c} {tasks.schema[c].dataType.simpleString()}" for c in tasks.columns)
    signed = tasks.join(sigs.select("rep", "sig").hint("merge"), "rep")
    possible = saved(signed.groupBy(TASK).applyInArrow(_block_partners, side), "partners")
    wanted = saved(possible.select("rep").distinct(), "wanted")
    sets = _with_sets(texts, sigs, wanted)
    whole = possible.join(sets.hint("merge"), "rep").join(sigs.select("rep", "sig").hint("merge"), "rep")
    links = saved(whole.groupBy(TASK).applyInArrow(_block_links, "a long, b long"), "links")
    drop(tasks, possible, wanted, sets)
    return links


def _merged(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of the links so far: those of before with the new ones."""
    every = links
    if component is not None:
        every = links.unionAll(component.select(F.col("node").alias("a"), F.col("component").alias("b")))
    out = connected_components(every)
    drop(component, links)
    return out


def near_duplicates(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for the texts of ``docs`` (doc_id long, text string; other columns are ignored).

    A text's set holds its distinct 5-word shingles (A-Z in lower case, words parted by ASCII white space), or its whole
    word sequence if shorter. Sets with 100 * intersection >= 75 * union are linked; component_id is the smallest doc_id
    reachable, kept says that it is the row's own. A null, empty or blank text has the empty set and stands alone. Rows
    that repeat a doc_id are judged each by its own text. A row without doc_id takes no part: component_id is null, kept
    true. Equal sets are one class from the start, so exact copies never meet in pairs. ``carry`` names a long column of
    ``docs`` that each row brings along, last in the result.
    """
    with small_batches(docs.sparkSession):
        return _judged(docs, carry)


def _judged(docs: DataFrame, carry: str | None) -> DataFrame:
    own = [F.col(carry).cast("long").alias("carried")] if carry else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own_text"), "text", *own)
    shape = f"doc_id long, own_text long, {'carried long, ' if carry else ''}n_shingles long, k1 long, k2 long, sig array<int>"
    features = saved(texts.mapInArrow(_features, shape), "features")
    taking = features.where("n_shingles > 0 and doc_id is not null")
    first = taking.groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct(*PLACE, "sig")).alias("first"))
    classes = saved(first.select(F.monotonically_increasing_id().alias("rep"), "k1", "k2", "n_shingles", "first.*"), "classes")
    sigs = _sifted(classes)
    postings, component = _postings(sigs), None
    for turn in range(ROUNDS):
        rest = _placed(postings, component)
        component = _merged(component, _head_links(rest, sigs, texts, turn))
        drop(rest)
    rest = _placed(postings, component)
    component = _merged(component, _links_outside(rest, sigs, texts))
    drop(rest, postings, sigs)
    joined = component.withColumnRenamed("node", "rep").hint("merge")
    named = saved(classes.select("rep", "k1", "k2", "doc_id").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    found = saved(named.join(least.hint("merge"), "component").select("k1", "k2", "least"), "least")
    drop(classes, component, named)
    out = features.drop("sig").join(found.hint("merge"), ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")))
    judged = out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), *([F.col("carried").alias(carry)] if carry else []))
    judged = saved(judged, "judged")
    drop(features, found)
    return judged
