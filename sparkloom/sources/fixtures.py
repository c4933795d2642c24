"""Particles, k-mers and matrices derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.params import SimParams


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scattered(e: Column, square: int, factor: int, prime: int) -> Column:
    """(e * e * square + e * factor) % prime for any long e. Below -100 and above 0 the sum is positive, and remainders give it without a product that leaves a long."""
    r = F.pmod(e, F.lit(prime).cast("long"))
    return F.when(e.between(-100, 0), (e * e * square + e * factor) % prime).otherwise(r * ((r * square + factor) % prime) % prime)


def particles(spark: SparkSession, sf_dir: str, params: SimParams | None = None) -> tuple[DataFrame, float]:
    """(id, x, y, vx, vy) from ``events``, and the side of their box."""
    events = table(spark, sf_dir, "events")
    size = (params or SimParams()).size(events.count())
    e = F.col("event_id")
    return events.select(
        e.alias("id"),
        (_scattered(e, 7919, 104729, 1000003) * F.lit(size) / 1000003.0).alias("x"),
        (_scattered(e, 15485863, 32452843, 999983) * F.lit(size) / 999983.0).alias("y"),
        ((e % 2001 * 48271 % 2001 - 1000) / 1000.0).alias("vx"),
        ((e % 2001 * 69621 % 2001 - 1000) / 1000.0).alias("vy"),
    ), size


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, v): the whole of ``embeddings`` as a matrix, a row for each vec_id."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def sequences(spark: SparkSession, sf_dir: str, k: int = 19) -> DataFrame:
    """(o_orderkey, q): a sequence of k + 13 bases for each order, dealt out before k-mers multiply them, as the table may be one small file."""
    digest = lambda text: F.translate(F.md5(text.cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    key = F.col("o_orderkey").cast("string")
    q = digest(key) if k + 13 <= 32 else F.concat(digest(key), digest(F.concat(F.lit("a"), key)))
    keys = table(spark, sf_dir, "orders").select("o_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.select("o_orderkey", q.alias("q"))


def kmers(spark: SparkSession, sf_dir: str, k: int = 19) -> DataFrame:
    """(kmer, b_ext, f_ext): the 14 overlapping k-mers of every order's sequence; F marks an end."""
    at = sequences(spark, sf_dir, k).select("q", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("p"))
    return at.select(
        F.expr(f"substr(q, p, {k})").alias("kmer"),
        F.expr("CASE WHEN p = 1 THEN 'F' ELSE substr(q, p - 1, 1) END").alias("b_ext"),
        F.expr(f"CASE WHEN p = 14 THEN 'F' ELSE substr(q, p + {k}, 1) END").alias("f_ext"),
    )


def kmer_lines(spark: SparkSession, sf_dir: str, k: int = 19) -> DataFrame:
    """(line_no, value): the k-mers as lines of a fixed-width file, numbered in the order of o_orderkey and place."""
    keyed = sequences(spark, sf_dir, k)
    at = keyed.select("o_orderkey", "q", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("p"))
    return at.select(
        (F.col("o_orderkey") * 14 + F.col("p") - 1).alias("line_no"),
        F.expr(f"concat(substr(q, p, {k}), ' ', CASE WHEN p = 1 THEN 'F' ELSE substr(q, p - 1, 1) END, CASE WHEN p = 14 THEN 'F' ELSE substr(q, p + {k}, 1) END)").alias("value"),
    )
