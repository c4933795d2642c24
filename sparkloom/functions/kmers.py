"""Column functions on k-mers: coding, packing, hashing, neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The codes of the bases are their places here, the first base of a byte weighs most; the hash is h * 33 + byte from 5381.
BASES = "ACGT"
HEX = "0123456789ABCDEF"
HASH_START, HASH_FACTOR = 5381, 33
#: Bytes in one number; bytes whose hash surely fits a long; the low half of a long.
WORD, SURE, HALF = 7, 10, (1 << 32) - 1
#: Bases that one non-negative long holds.
LONGEST = 31


def number(kmer: Column, first: int, bases: int) -> Column:
    """Up to 31 bases from a place from 0 as the digits of a number in base 4."""
    return F.conv(F.translate(F.substring(kmer, first + 1, bases), BASES, "0123"), 4, 10).cast("long")


def byte(kmer: Column, n: int, k: int) -> Column:
    """The n-th packed byte, from four bases; beyond the end they count as A. Bytes come by WORD from one number, which is read once."""
    first = n // WORD * WORD
    bases = min(4 * WORD, k - 4 * first)
    value, down = number(kmer, 4 * first, bases), 2 * (bases - 4 * (n - first + 1))
    return (F.shiftright(value, down) if down >= 0 else F.shiftleft(value, -down)).bitwiseAND(F.lit(255))


def packed(kmer: Column, k: int) -> Column:
    """The 2-bit packing as binary, ceil(k / 4) bytes, padded as with A: the numbers of WORD bytes each in hex digits."""
    parts = [(p, min(4 * WORD, k - p)) for p in range(0, k, 4 * WORD)]
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftleft(number(kmer, p, n), 2 * (-n % 4))), 2 * -(-n // 4), "0") for p, n in parts]))


def unpacked(data: Column, k: int) -> Column:
    """The k-mer of a packing, by WORD bytes at a time: their hex digits as a number in base 4."""
    n = -(-k // 4)
    parts = [(p, min(WORD, n - p)) for p in range(0, n, WORD)]
    digits = [F.lpad(F.conv(F.hex(F.substring(data, p + 1, size)), 16, 4), 4 * size, "0") for p, size in parts]
    return F.substring(F.translate(F.concat(*digits), "0123", BASES), 1, k)


def hashed(kmer: Column, k: int) -> Column:
    """The hash of the packed bytes modulo 2**64, as the long of the same bits (``unsigned`` shows its value)."""
    n = -(-k // 4)
    step = lambda h, b: h * HASH_FACTOR + byte(kmer, b, k)
    h = reduce(step, range(min(n, SURE)), F.lit(HASH_START).cast("long"))
    if n <= SURE:
        return h
    low, high = h.bitwiseAND(F.lit(HALF)), F.shiftright(h, 32)
    for b in range(SURE, n):
        low = step(low, b)
        high = (high * HASH_FACTOR + F.shiftright(low, 32)).bitwiseAND(F.lit(HALF))
        low = low.bitwiseAND(F.lit(HALF))
    return F.shiftleft(high, 32).bitwiseOR(low)


def unsigned(h: Column) -> Column:
    """A hash's decimal digits."""
    return F.conv(F.hex(h), 16, 10)


def coded(kmer: Column, k: int) -> list[Column]:
    """A k-mer as short values to join or group by: its bases by LONGEST as longs, and a text that is empty; anything that is no k-mer of ACGT is the text, beside longs of -1, or of -3 for null. None is ever null, so that joins do not compute them once more to ask."""
    plain = (F.length(kmer) == k) & kmer.rlike(r"^[ACGT]*\z")
    other = F.when(kmer.isNull(), F.lit(-3)).otherwise(F.lit(-1)).cast("long")
    return [*[F.coalesce(F.when(plain, number(kmer, p, min(LONGEST, k - p))), other) for p in range(0, k, LONGEST)], F.coalesce(F.when(plain, F.lit("")).otherwise(kmer), F.lit(""))]


def following(kmer: Column, f_ext: Column, k: int) -> Column:
    return F.concat(F.substring(kmer, 2, k - 1), f_ext)


def preceding(kmer: Column, b_ext: Column, k: int) -> Column:
    return F.concat(b_ext, F.substring(kmer, 1, k - 1))


def bit_length(n: int) -> int:
    """The smallest b with 2**b >= n."""
    return max(0, (n - 1).bit_length())


def shifted_bucket(h: Column, bits: int, size: int) -> Column:
    return F.shiftrightunsigned(h, bits) % size
