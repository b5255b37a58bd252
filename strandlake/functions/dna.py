"""Column functions on nucleotide strings. Positions are 0-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
COMPLEMENT = "TGCA"
#: Prose as a sequence: the i-th letter of the alphabet, of either case, stands for base i mod 4.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CODES = "ACGT" * 13


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalised(seq: Column | str) -> Column:
    """Upper case, with everything but A, C, G and T as N."""
    return F.regexp_replace(F.translate(_col(seq), "acgt", BASES), "[^ACGT]", "N")


def text_residues(text: Column | str) -> Column:
    """Prose as a sequence: white space goes, letters stand for bases, everything else for N."""
    return F.regexp_replace(F.translate(F.regexp_replace(_col(text), "[ \\t\\r\\n]+", ""), LETTERS, CODES), "[^ACGT]", "N")


def masked(seq: Column | str, exclude: str = "") -> Column:
    """Residues in exclude, and the stop sign, as X."""
    drop = "*" + exclude
    return F.translate(_col(seq), drop, "X" * len(drop))


def revcomp(seq: Column | str) -> Column:
    """Reverse complement of a normalised sequence."""
    return F.reverse(F.translate(_col(seq), BASES, COMPLEMENT))


def residue_value(base: Column | str) -> Column:
    """0 to 3 for A, C, G, T, else -1."""
    return F.instr(F.lit(BASES), _col(base)) - 1


def bases_match(a: Column | str, b: Column | str, same_strand: bool = True) -> Column:
    """Whether two bases pair; N pairs with nothing."""
    other = _col(b) if same_strand else F.translate(_col(b), BASES, COMPLEMENT)
    return (_col(a) == other) & (_col(a) != "N")


def kmer_hash(kmer: Column | str, k: int) -> Column:
    """Sum of value(base i) * 4**i; -1 if a base is not A, C, G or T."""
    c = _col(kmer)
    # The first base is the least significant digit of a number to base four.
    value = F.conv(F.reverse(F.translate(c, BASES, "0123")), 4, 10).cast("long")
    return F.when((F.length(c) == k) & (F.translate(c, BASES, "") == ""), value).otherwise(F.lit(-1).cast("long"))


def nogap_length(aligned: Column | str) -> Column:
    return F.length(F.translate(_col(aligned), "-", ""))


def without_gaps(aligned: Column | str) -> Column:
    return F.translate(_col(aligned), "-", "")


def slice_between(seq: Column | str, start: Column, end: Column) -> Column:
    """Bases from start up to, not including, end."""
    return _col(seq).substr((start + 1).cast("int"), (end - start).cast("int"))


def octal(n: Column | str) -> Column:
    return F.conv(_col(n).cast("string"), 10, 8)


#: The sixteen symbols of the half-byte alphabet, in order of their codes.
HALF_BYTES = "01234567ACGT-isN"
HEX = "0123456789ABCDEF"


def half_byte_code(symbol: Column | str) -> Column:
    """Code of a symbol; anything unknown has N's."""
    at = F.instr(F.lit(HALF_BYTES), _col(symbol))
    return F.when(at > 0, at - 1).otherwise(15)


def to_half_bytes(script: Column | str) -> Column:
    """Two symbols a byte, the first one high; an odd end is filled with code 1."""
    h = F.translate(F.regexp_replace(_col(script), "[^0-7ACGTNis-]", "N"), HALF_BYTES, HEX)
    return F.unhex(F.when(F.length(h) % 2 == 1, F.concat(h, F.lit("1"))).otherwise(h))


def from_half_bytes(packed: Column | str, length: Column) -> Column:
    return F.translate(F.hex(_col(packed)), HEX, HALF_BYTES).substr(F.lit(1), length.cast("int"))


def be_bytes(n: Column | str, width: int = 8) -> Column:
    """A non-negative integer as big-endian bytes."""
    return F.unhex(F.lpad(F.hex(_col(n)), 2 * width, "0"))


def be_int(packed: Column | str) -> Column:
    return F.conv(F.hex(_col(packed)), 16, 10).cast("long")


def mask(bits: int) -> Column:
    """A number whose lowest bits, up to 63 of them, are set."""
    return F.lit((1 << bits) - 1).cast("long")


def shift_left(n: Column | str, bits: int) -> Column:
    return F.shiftleft(_col(n).cast("long"), bits)


def shift_right(n: Column | str, bits: int) -> Column:
    """Without the sign: zeros come in from the left."""
    return F.shiftrightunsigned(_col(n).cast("long"), bits)
