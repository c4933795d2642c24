"""The kernels in Spark SQL: functions, a table function, and views of the tables that they derive."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sparkloom.operators import assembly, matrix, spatial
from sparkloom.params import SimParams
from sparkloom.sources import fixtures

P = SimParams()
#: The places of a k-mer's slices of 28 bases, or of 7 bytes, n from 0; the bytes that slice n packs to; its bases as digits, padded as with A.
_SLICES = "sequence(0, greatest(0, (length(kmer) + 27) div 28 - 1))"
_BYTES = "cast(least(7, (length(kmer) + 3) div 4 - 7 * n) as int)"
_DIGITS = f"translate(rpad(substr(kmer, 28 * n + 1, 28), 4 * {_BYTES}, 'A'), 'ACGT', '0123')"
_HALF = str((1 << 32) - 1)
#: Two slices hold the k-mers that most are. Their functions have no lambdas, which Spark interprets; each argument is computed once, as
#: functions that call each other are put into projections above each other. Longer k-mers take the expressions over any number of slices.
SHORT, _TWO = 56, ("least(7, (length(kmer) + 3) div 4)", "least(7, greatest(0, (length(kmer) + 3) div 4 - 7))")
_POWERS = f"array({', '.join(f'{33**n}L' for n in range(8))})"
_WORDS = "short_word(substr(digits, 1, 28), cast({0} as int)), short_word(substr(digits, 29), cast({1} as int))".format(*_TWO)
_SHORT_DIGITS = f"translate(substr(kmer, 1, {SHORT}), 'ACGT', '0123')"
_LOW = f"((hash & {_HALF}L) * {_POWERS}[least(bytes, 4)])"
_SUM = f"(({_LOW} & {_HALF}L) * {_POWERS}[greatest(bytes - 4, 0)] + more)"
_ANY_PACK = f"unhex(array_join(transform({_SLICES}, n -> lpad(conv({_DIGITS}, 4, 16), 2 * {_BYTES}, '0')), ''))"
# bound to a lambda's variable, so that what is given is computed once
_ANY_UNPACK = "substr(translate(transform(array(packed), b -> array_join(transform(sequence(0, greatest(0, (length(b) + 6) div 7 - 1)), n -> lpad(conv(hex(substr(b, 7 * n + 1, 7)), 16, 4), cast(4 * least(7, length(b) - 7 * n) as int), '0')), ''))[0], '0123', 'ACGT'), 1, k)"
# two limbs of 32 bits; the long has the bits of the unsigned value
_ANY_HASH = f"aggregate(transform({_SLICES}, n -> named_struct('word', cast(conv({_DIGITS}, 4, 10) as bigint), 'downs', slice(array(48, 40, 32, 24, 16, 8, 0), 8 - {_BYTES}, {_BYTES}))), named_struct('high', 0L, 'low', 5381L), (h, s) -> aggregate(s.downs, h, (g, d) -> named_struct('high', (g.high * 33 + shiftright(g.low * 33 + (shiftright(s.word, d) & 255), 32)) & {_HALF}L, 'low', (g.low * 33 + (shiftright(s.word, d) & 255)) & {_HALF}L)), h -> shiftleft(h.high, 32) | h.low)"
#: Spark SQL functions of any k, as expressions that Catalyst inlines: no Python runs for them. Those of ``short_`` are parts of others.
FUNCTIONS = {
    "kmer_next(kmer STRING, f_ext STRING) RETURNS STRING": "concat(substr(kmer, 2), f_ext)",
    "kmer_prev(kmer STRING, b_ext STRING) RETURNS STRING": "concat(b_ext, substr(kmer, 1, length(kmer) - 1))",
    # a slice's digits as a number, padded as with A
    "short_word(digits STRING, bytes INT) RETURNS BIGINT": "coalesce(cast(conv(rpad(digits, 4 * bytes, '0'), 4, 10) as bigint), 0L)",
    "short_joined(kmer STRING, first BIGINT, second BIGINT) RETURNS BINARY": f"unhex(concat(lpad(hex(first), cast(2 * {_TWO[0]} as int), '0'), lpad(hex(second), cast(2 * {_TWO[1]} as int), '0')))",
    "short_pack(kmer STRING, digits STRING) RETURNS BINARY": f"short_joined(kmer, {_WORDS})",
    "kmer_pack(kmer STRING) RETURNS BINARY": f"CASE WHEN length(kmer) <= {SHORT} THEN short_pack(kmer, {_SHORT_DIGITS}) ELSE {_ANY_PACK} END",
    "kmer_unpack(packed BINARY, k INT) RETURNS STRING": f"CASE WHEN length(packed) <= 14 THEN substr(translate(concat(lpad(coalesce(conv(hex(substr(packed, 1, 7)), 16, 4), ''), cast(4 * least(7, length(packed)) as int), '0'), lpad(coalesce(conv(hex(substr(packed, 8)), 16, 4), ''), cast(4 * greatest(0, length(packed) - 7) as int), '0')), '0123', 'ACGT'), 1, k) ELSE {_ANY_UNPACK} END",
    # the bytes of a word, each times 33 as often as bytes follow; a word of fewer begins with zeros
    "short_fold(word BIGINT) RETURNS BIGINT": " + ".join(f"(shiftright(word, {8 * n}) & 255) * {33**n}L" for n in range(6, -1, -1)),
    # hash * 33 ** bytes + more modulo 2 ** 64 in limbs of 32 bits; four factors at once and the other three fit a long beside a limb
    "short_mixed(hash BIGINT, more BIGINT, bytes INT) RETURNS BIGINT": f"shiftleft(((shiftright(hash, 32) * {_POWERS}[least(bytes, 4)] + shiftright({_LOW}, 32)) * {_POWERS}[greatest(bytes - 4, 0)] + shiftright({_SUM}, 32)) & {_HALF}L, 32) | ({_SUM} & {_HALF}L)",
    "short_hashed(kmer STRING, first BIGINT, second BIGINT) RETURNS BIGINT": f"short_mixed(5381L * {_POWERS}[cast({_TWO[0]} as int)] + short_fold(first), short_fold(second), cast({_TWO[1]} as int))",
    "short_hash(kmer STRING, digits STRING) RETURNS BIGINT": f"short_hashed(kmer, {_WORDS})",
    "kmer_hash(kmer STRING) RETURNS BIGINT": f"CASE WHEN length(kmer) <= {SHORT} THEN short_hash(kmer, {_SHORT_DIGITS}) ELSE {_ANY_HASH} END",
    "cell_of(x DOUBLE, y DOUBLE, width DOUBLE, dim BIGINT) RETURNS BIGINT": "cast(floor(x / width) * dim + floor(y / width) as bigint)",
    "push_coefficient(r2 DOUBLE) RETURNS DOUBLE": f"(1 - {P.cutoff}D / sqrt(greatest(r2, {P.min_r!r}D * {P.min_r!r}D))) / greatest(r2, {P.min_r!r}D * {P.min_r!r}D) / {P.mass}D",
}


@udtf(returnType="dir int, neighbour bigint")
class CellStencil:
    """The cells of the 3 x 3 stencil around a cell, within a grid of dim x dim."""

    def eval(self, cell: int, dim: int) -> Iterator[tuple[int, int]]:
        bx, by = divmod(cell, dim)
        for k in range(9):
            x, y = bx + k // 3 - 1, by + k % 3 - 1
            if 0 <= x < dim and 0 <= y < dim:
                yield k, x * dim + y


def register(spark: SparkSession) -> None:
    """Makes the functions known to ``spark.sql``."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("cell_stencil", CellStencil)


def register_views(spark: SparkSession, sf_dir: str, k: int = 19) -> None:
    """Views matrix, gram, particles, forces, kmers, kmer_links and contigs over the tables in ``sf_dir``; contigs are assembled once."""
    a = fixtures.matrix(spark, sf_dir)
    p, size = fixtures.particles(spark, sf_dir)
    kmers = fixtures.kmers(spark, sf_dir, k)
    views = {"matrix": a, "gram": matrix.product(matrix.transposed(a), a), "particles": spatial.with_cells(p, size, P), "forces": spatial.forces_binned(p, size, P), "kmers": kmers, "kmer_links": assembly.lookup(kmers, k), "contigs": assembly.contigs(kmers, k)}
    for name, view in views.items():
        view.createOrReplaceTempView(name)
