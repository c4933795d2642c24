"""The kernels by ``spark.sql``, and bins that are kept between batches."""

from __future__ import annotations

import random
from collections import Counter

from sparkloom.functions import kmers as fk
from sparkloom.plans import sql
from sparkloom.streaming import bins

SF_DIR = "/root/testdata/sf0.001"


def test_functions_of_any_k(spark):
    from pyspark.sql import functions as F

    sql.register(spark)
    rng = random.Random(4)
    for k in (1, 4, 19, 28, 51, 64):
        rows = [("".join(rng.choice("ACGT") for _ in range(k)),) for _ in range(40)]
        spark.createDataFrame(rows, "kmer string").createOrReplaceTempView("some")
        own = spark.table("some").select("kmer", F.hex(fk.packed(F.col("kmer"), k)), fk.unpacked(fk.packed(F.col("kmer"), k), k), fk.unsigned(fk.hashed(F.col("kmer"), k)))
        got = spark.sql(f"SELECT kmer, hex(kmer_pack(kmer)), kmer_unpack(kmer_pack(kmer), {k}), conv(hex(kmer_hash(kmer)), 16, 10) FROM some")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, own.collect()))
        for kmer, packed, unpacked, hashed in own.collect():
            data = bytes(sum("ACGT".index(c) << 6 - 2 * i for i, c in enumerate(kmer[n : n + 4])) for n in range(0, k, 4))
            h = 5381
            for b in data:
                h = (33 * h + b) % 2**64
            assert (packed, unpacked, hashed) == (data.hex().upper(), kmer, str(h))
        assert "decimal" not in own._jdf.queryExecution().executedPlan().toString().lower()
    assert spark.sql("SELECT kmer_next('ACG', 'T'), kmer_prev('ACG', 'T'), cell_of(0.05D, 0.03D, 0.02D, 10L)").first()[:] == ("CGT", "TAC", 21)
    assert [tuple(r) for r in spark.sql("SELECT * FROM cell_stencil(0L, 3L)").collect()] == [(4, 0), (5, 1), (7, 3), (8, 4)]


def test_views(spark):
    sql.register(spark)
    sql.register_views(spark, SF_DIR)
    assert spark.sql("SELECT count(*) FROM contigs JOIN kmers ON substr(contig, 1, 19) = kmer WHERE b_ext = 'F'").first()[0] == 1500
    assert spark.sql("SELECT count(*) FROM kmer_links WHERE next_f IS NULL OR next <> kmer_next(kmer, substr(next, 19, 1))").first()[0] == 0
    assert abs(spark.sql("SELECT sum(ax) FROM forces").first()[0]) < 1 and spark.sql("SELECT count(*) FROM gram").first()[0] == 64 * 64
    assert spark.sql("SELECT count(*) FROM particles WHERE cell <> cell_of(x, y, 0.021D, (SELECT max(bx) + 1 FROM particles))").first()[0] == 0
    near = spark.sql("SELECT a.id, push_coefficient(1e-5D) AS c FROM particles a, LATERAL cell_stencil(a.cell, 34L) s LIMIT 1").first()
    assert abs(near.c - (1 - 0.01 / 1e-5**0.5) / 1e-5 / 0.01) < 1e-3


def test_bins_equal_a_recount_after_every_batch(spark, tmp_path):
    rng = random.Random(5)
    where, path, out = {}, str(tmp_path / "moves"), str(tmp_path / "out")
    for batch in range(4):
        moves = []
        for i in range(60):
            new = rng.choice([None, *range(8)]) if i in where else rng.randrange(8)
            moves.append((batch, i, where.get(i), new))
            if new is None:
                where.pop(i, None)
            else:
                where[i] = new
        spark.createDataFrame(moves, bins.MOVES).coalesce(1).write.mode("append").parquet(path)
        query = bins.run_bins(spark, path, out, str(tmp_path / "state"))  # each time a new query goes on from the state
        assert query.exception() is None
        want = Counter(where.values())
        got = {r.cell: (r.n, r.ids) for r in bins.latest(spark, out).collect()}
        assert got == {c: (n, sum(i for i, at in where.items() if at == c)) for c, n in want.items()}


def test_functions_convert_by_slices_of_any_length(spark):
    sql.register(spark)
    assert all(body.count("div 28") or "div 7" in body for head, body in sql.FUNCTIONS.items() if head.startswith(("kmer_pack", "kmer_unpack", "kmer_hash")))
    texts = [("TGCAACGTTACGGTCA" * 9)[:n] for n in (0, 1, 3, 4, 5, 27, 28, 29, 40, 51, 56, 57, 113)]
    for text in texts:
        data = bytes(sum("ACGT".index(c) << (6 - 2 * i) for i, c in enumerate(text[p : p + 4])) for p in range(0, len(text), 4))
        h = 5381
        for b in data:
            h = (h * 33 + b) % 2**64
        spark.createDataFrame([(text,)], "kmer string").createOrReplaceTempView("one_text")
        row = spark.sql(f"SELECT kmer_pack(kmer) AS p, kmer_hash(kmer) AS h, kmer_unpack(kmer_pack(kmer), {len(text)}) AS u FROM one_text").first()
        assert (bytes(row.p), row.h % 2**64, row.u) == (data, h, text)


def test_short_kmers_take_no_lambdas(spark):
    from pyspark.sql import functions as F

    sql.register(spark)
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGT") for _ in range(k)) for k in range(60)] + ["T" * k for k in (28, 40, 55, 56, 57)] + ["NACG", "ACNT" * 9, "acgt", "C" * 30 + "N"]
    spark.createDataFrame([(t,) for t in [*texts, None]], "kmer string").createOrReplaceTempView("mixed")
    plan = spark.sql("SELECT kmer_pack(kmer), kmer_hash(kmer), kmer_unpack(kmer_pack(kmer), 51) FROM mixed")._jdf.queryExecution().optimizedPlan().toString()
    # each word is computed once, beneath; the lambdas are only for what is longer
    assert "length(kmer" in plan and plan.count("Project") >= 3 and sum("CASE WHEN (length(" in line for line in plan.splitlines()) >= 1
    whole = {"p": sql._ANY_PACK, "h": sql._ANY_HASH, "u": sql._ANY_UNPACK.replace("packed", f"({sql._ANY_PACK})").replace(", k)", ", 51)")}
    want = spark.table("mixed").select("kmer", *[F.expr(e).alias(n) for n, e in whole.items()]).collect()
    got = spark.sql("SELECT kmer, kmer_pack(kmer) AS p, kmer_hash(kmer) AS h, kmer_unpack(kmer_pack(kmer), 51) AS u FROM mixed").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == len(texts) + 1
