"""Keys of the wide-row store: the letter form of SHA-1, and names that are safe in file systems."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


# Fixed values by a rule: keys of one store must agree. tests/test_functions.py holds listed values against it.
def letter_pair(index: int) -> str:
    """Two letters for a byte: the first counts up, the second marks the round of 26 by every other letter."""
    turn = index // 26
    return LETTERS[index % 26] + (LETTERS[0] if turn == 0 else LETTERS[2 * turn])


def letter_hash(text: str) -> str:
    """40 letters of SHA-1. A digest byte of 1 to 127 stands for itself, one of 128 to 255 for the number
    before it, and 0 for 255: not a bijection, kept as it is since keys must agree."""
    digest = hashlib.sha1(text.encode()).digest()
    return "".join(letter_pair(b if 0 < b < 128 else (b - 1) % 256) for b in digest)


def letter_hash_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else letter_hash(t))

    return hashed(text)


def encode_key(key: str) -> str:
    """ASCII letters, digits and - stay; other characters become _ and their number in hexadecimal."""
    return "".join(c if c.isascii() and (c.isalnum() or c == "-") else f"_{ord(c):x}" for c in key)


def decode_key(name: str) -> str:
    """The inverse for characters from 0x10 to 0xff, two digits after each _."""
    head, *rest = name.split("_")
    return head + "".join(chr(int(x[:2], 16)) + x[2:] for x in rest)


def key_column(text: Column, decode: bool = False) -> Column:
    """encode_key or decode_key of a column."""

    @F.pandas_udf("string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else (decode_key if decode else encode_key)(t))

    return coded(text)
