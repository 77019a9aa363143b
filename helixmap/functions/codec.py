"""Bases as characters and codes.

A, C, G, T and N have codes 0 to 4. Codec ``dna`` reads any byte by its low four bits; codec ``text2bit`` keeps ASCII
letters only and takes two bits of each, so that prose becomes a sequence over four bases.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGTN"
# The base of each low nibble that is not A.
NIBBLES = {3: "C", 7: "G", 4: "T", 5: "T", 14: "N"}
#: The bases of the 4-bit alphabet, by the low four bits of a packed byte; all but single bases read as N.
PACKED = {1: "A", 2: "C", 4: "G", 8: "T"}


def letter_base(letter: str) -> str:
    """The base of a letter under ``text2bit``; A, C, G and T stand for themselves in either case."""
    b = ord(letter)
    return BASES[((b >> 2) ^ (b >> 1)) & 3]


LETTERS = string.ascii_uppercase + string.ascii_lowercase
LETTER_BASES = "".join(letter_base(x) for x in LETTERS)
#: All printable and control ASCII characters, as ``dna`` reads them; other characters are read as A or by their bytes.
ASCII = "".join(map(chr, range(1, 128)))
ASCII_BASES = "".join(NIBBLES.get(ord(x) & 15, "A") for x in ASCII)


def letters_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z]", "")


def encode(text: Column, codec: str = "text2bit") -> Column:
    """The bases of a text, as characters; null stays null.

    ``dna`` maps each character; those beyond ASCII, which no sequence file should hold, read as N.
    """
    if codec == "text2bit":
        return F.translate(letters_of(text), LETTERS, LETTER_BASES)
    return F.translate(F.regexp_replace(text, "[^\\x01-\\x7F]", "N"), ASCII, ASCII_BASES)


def encode_sql(text: str) -> str:
    """``encode`` under text2bit in SQL."""
    return f"translate(regexp_replace({text}, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{LETTER_BASES}')"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def codes_of(bases: str | bytes) -> np.ndarray:
    """Codes of base characters."""
    raw = bases.encode() if isinstance(bases, str) else bases
    table = np.full(256, 4, np.uint8)
    table[list(b"ACGT")] = range(4)
    return table[np.frombuffer(raw, np.uint8)]


def bases_of(codes: np.ndarray) -> str:
    return np.frombuffer(BASES.encode(), np.uint8)[codes].tobytes().decode()


def dna_bases(raw: bytes) -> str:
    """The bases of the bytes of a sequence file."""
    table = np.frombuffer("".join(NIBBLES.get(b & 15, "A") for b in range(256)).encode(), np.uint8)
    return table[np.frombuffer(raw, np.uint8)].tobytes().decode()


def complement_codes(codes: np.ndarray) -> np.ndarray:
    """Codes of the reverse complement; N stays N."""
    return np.where(codes < 4, 3 - codes, 4)[::-1].astype(np.uint8)
