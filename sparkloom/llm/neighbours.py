"""Approximate nearest neighbours by adaptive dimension scans of inverted lists.

Vectors are dealt to lists by nearest centroid (fitted on a bounded sample); a query scans the lists of its nearest
centroids. Within a list the vectors are rotated at random and held in blocks of columns. After each block the partial
distance is a sample of the whole one: a candidate whose partial distance is too large for the whole to be among the k
nearest, by a hypothesis test on the rotation, is abandoned. Scores of the rest are exact. Each query's nearest lists are
scanned first; the k-th distance found there is the bound for all that follow, and tighter ones are taken on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.scratch import drop, saved

#: Vectors in the sample for the centroids, those to a list at least, the share of lists that a query scans, the least number of them, the part of them that is scanned first. There are as many lists as the root of the rows, as far as the sample goes.
SAMPLE, SAMPLE_LIST, SHARE, LEAST, FIRST = 20_000, 8, 0.75, 8, 0.15
#: Columns of a block, and the tests' parameter: larger abandons less.
COLUMNS, EPSILON = 8, 1.1
#: Rounding of squared distances that the tests allow: a share of the distance, and of the squared norms.
RELATIVE, ABSOLUTE = 1e-9, 1e-12
#: Rows and queries that meet in one task at a time.
ROWS, QUERIES = 8192, 2048


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null, empty or zero and has finite components only."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0))


def centroids(sample: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """n centres of the sample by Lloyd's rounds from a seeded choice of distinct vectors."""
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.random.default_rng(1).permutation(len(distinct))[:n]]
    for _ in range(rounds):
        near = ((distinct**2).sum(1)[:, None] - 2 * distinct @ centres.T + (centres**2).sum(1)).argmin(1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, distinct)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def scan(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, rotation: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query (its id, ids, distances, numbers read) of the k nearest rows that the tests leave. ``bounds`` are squared distances within which the query has k rows already, or infinite."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    turned = rows @ rotation
    norms = (rows**2).sum(1)
    width = rows.shape[1]
    blocks = [np.ascontiguousarray(turned[:, d : d + COLUMNS].T) for d in range(0, width, COLUMNS)]
    for query_id, query, q, bound in zip(query_ids.tolist(), queries, queries @ rotation, bounds, strict=True):
        # rows and queries are rotated apart, so that even copies differ by rounding
        slack = ABSOLUTE * (norms + (query**2).sum())
        alive = np.flatnonzero(ids != query_id)
        partial, read = np.zeros(len(alive)), 0
        for b, block in enumerate(blocks):
            part = block[:, alive] if len(alive) < len(ids) else block
            read += part.size
            partial = partial + ((part - q[b * COLUMNS : b * COLUMNS + len(block), None]) ** 2).sum(0)
            seen = b * COLUMNS + len(block)
            if seen < width:
                if b in (0, len(blocks) // 2) and len(alive) > k:  # the whole distances of the k that look nearest bound the k-th one
                    likely = alive[np.argpartition(partial, k - 1)[:k]]
                    bound = min(bound, ((rows[likely] - query) ** 2).sum(1).max())
                    read += k * width
                keep = partial <= bound * seen / width * (1 + EPSILON / np.sqrt(seen)) ** 2 * (1 + RELATIVE) + slack[alive]
                alive, partial = alive[keep], partial[keep]
        if len(alive) > 4 * k:  # rotation rounds, so keep a little more than k
            limit = np.partition(partial - slack[alive], k - 1)[k - 1]
            alive = alive[partial - slack[alive] <= limit * (1 + RELATIVE) + 2 * slack[alive].max()]
        score = np.sqrt(((rows[alive] - query) ** 2).sum(1))
        best = np.lexsort((ids[alive], score))[:k]
        yield query_id, ids[alive][best], score[best], read


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", column: str = "embedding", share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k nearest rows of ``vectors`` with another id, by Euclidean distance.

    Both have (id long, array of float or double). Null and zero vectors, those with null or non-finite components, without an id, or of
    another length than most of the sample, take no part. Equal distances go by smaller id; a row that repeats is one candidate, a
    query that repeats one query. An empty table, or one without a vector that takes part, gives no rows. All rows are indexed; a query scans at
    least LEAST lists and ``share`` of them, FIRST of these before the others. A list of any size is many groups of bounded size.
    """
    spark = vectors.sparkSession
    clean = lambda df: usable(df.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")), "v").where("id is not null").distinct()
    schema = "query_id long, rank int, vec_id long, score double"
    base_table, asked_table = saved(clean(vectors), "vectors"), saved(clean(queries), "queries")
    base, asked = base_table, asked_table
    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"].tolist()
    if not sample:
        return spark.createDataFrame([], schema)
    sizes = np.bincount([len(v) for v in sample])
    width = int(sizes.argmax())
    points = np.array([v for v in sample if len(v) == width])
    base, asked = base.where(F.size("v") == width), asked.where(F.size("v") == width)
    centres = centroids(points, int(max(1, min(np.sqrt(base.count()), len(points) // SAMPLE_LIST))))
    rotation = np.linalg.qr(np.random.default_rng(2).standard_normal((width, width)))[0]
    probes = min(len(centres), max(LEAST, int(np.ceil(share * len(centres)))))

    def near(v: np.ndarray, n: int) -> np.ndarray:
        away = (centres**2).sum(1) - 2 * v @ centres.T
        return np.argsort(away, axis=1, kind="stable")[:, :n]

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield pdf.assign(list=near(np.stack(pdf["v"].to_numpy()), 1)[:, 0] if len(centres) > 1 else 0)

    def probing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                pdf = pdf.assign(list=list(near(np.stack(pdf["v"].to_numpy()), probes)), nth=[np.arange(probes)] * len(pdf))
                yield pdf.explode(["list", "nth"]).astype({"list": "int32", "nth": "int32"})

    shape = "id long, v array<double>, list int"
    listed, probed = saved(base.mapInPandas(placed, shape), "lists"), saved(asked.mapInPandas(probing, f"{shape}, nth int"), "probes")
    sizes = saved(listed.groupBy("list").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("row_parts")), "sizes")
    first = max(1, int(np.ceil(FIRST * probes)))
    found, best = [], None
    for turn in (F.col("nth") < first, F.col("nth") >= first):
        wanted = probed.where(turn).drop("nth")
        wanted = wanted.join(best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound")), "id", "left") if found else wanted.withColumn("bound", F.lit(None).cast("double"))
        found.append(saved(_met(listed, wanted, sizes, rotation, k), "found"))
        ranked = reduce(DataFrame.unionAll, found).select("query_id", "vec_id", "score").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
        best = ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    drop(base_table, asked_table, listed, probed, sizes)
    return best


def _met(listed: DataFrame, probed: DataFrame, sizes: DataFrame, rotation: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, read): what ``scan`` finds in each list for the queries that probe it, in groups of about ROWS rows and QUERIES queries; read is the share of the group's numbers that the query looked at."""
    # one row a list: in how many parts its rows and its queries meet
    counts = F.broadcast(sizes.join(probed.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("query_parts")), "list"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = listed.join(counts, "list").select("id", "v", "list", part("row_parts").alias("row_part"), every("query_parts").alias("query_part"))
    wanted = probed.join(counts, "list").select("id", "v", "bound", "list", every("row_parts").alias("row_part"), part("query_parts").alias("query_part"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            bounds = np.nan_to_num(right["bound"].to_numpy(float) ** 2, nan=np.inf)
            whole = len(left) * rotation.shape[0]
            for query, ids, scores, read in scan(left["id"].to_numpy(), np.stack(left["v"].to_numpy()), right["id"].to_numpy(), np.stack(right["v"].to_numpy()), bounds, rotation, k):
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids, "score": scores, "read": read / whole}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "read": []})

    keys = ["list", "row_part", "query_part"]
    return rows.groupBy(keys).cogroup(wanted.groupBy(keys)).applyInPandas(meet, "query_id long, vec_id long, score double, read double")
