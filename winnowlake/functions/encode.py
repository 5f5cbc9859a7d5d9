"""Two-bit symbols, m-mers and small integer functions as column expressions.

A byte's symbol is bits 1 and 2 of its code, so case does not matter, U equals T and letters other
than ACGT alias to one of them. In column form a symbol is one of the digits 0..3, and an m-mer a
string of digits; digit strings of equal length compare like the numbers they spell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "".join(map(chr, range(65, 91)))
#: All one-byte characters that can stand in a sequence line.
PRINTABLE = "".join(map(chr, range(33, 127)))


def symbol(c: str) -> str:
    return str((ord(c) >> 1) & 3)


def letters(text: Column) -> Column:
    """The ASCII letters of a text (stripped before any change of case)."""
    return F.regexp_replace(text, "[^A-Za-z]", "")


def encode_2bit(seq: Column) -> Column:
    """Digits of a sequence of printable ASCII characters."""
    return F.translate(seq, PRINTABLE, "".join(map(symbol, PRINTABLE)))


def mmer(digits: Column, pos: Column, m: int) -> Column:
    """The m-mer at pos (from 1)."""
    return digits.substr(pos, F.lit(m))


def revcomp(digits: Column) -> Column:
    return F.reverse(F.translate(digits, "0123", "2301"))


def canonical(digits: Column) -> Column:
    return F.least(digits, revcomp(digits))


def mmer_hash(digits: Column, seed: int = 42) -> Column:
    """The hash that SQL engines share: MD5 of the digits and the seed."""
    return F.md5(F.concat(digits, F.lit(f"|{seed}")))


def n_kmers(seq: Column, k: int) -> Column:
    return F.greatest(F.length(seq) - k + 1, F.lit(0)).cast("long")


def threshold(kmers: Column, ratio: float) -> Column:
    """Least score of a hit: the single-precision product, cut off, at least 1."""
    return F.greatest(F.lit(1).cast("long"), (kmers.cast("float") * F.lit(ratio).cast("float")).cast("long"))


def guarded_ratio(ratio: float) -> float:
    """A ratio outside ]0, 1] counts as 1, with a warning."""
    if 0 < ratio <= 1:
        return ratio
    import warnings

    warnings.warn(f"ratio {ratio} is outside ]0, 1]; 1.0 is used", stacklevel=2)
    return 1.0


def check_bits(h: Column, b: int) -> Column:
    return h.bitwiseAND(F.lit((1 << b) - 1).cast("long"))


def pack_cid(cid: Column, bits: Column, b: int) -> Column:
    return F.shiftleft(cid, b).bitwiseOR(bits)


def unpack_cid(packed: Column, b: int) -> Column:
    return F.shiftright(packed, b)


def bits_needed(x: Column) -> Column:
    """Bits of a non-negative whole number; 1 for 0."""
    return F.length(F.bin(x))


def slot_bits(n: Column) -> Column:
    """The slot width (8, 16, 32 or 64 bits) that holds ids below n."""
    b = bits_needed(F.greatest(n - 1, F.lit(0)))
    return F.when(b <= 8, 8).when(b <= 16, 16).when(b <= 32, 32).otherwise(64)
