"""Scalar functions the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What no token has: all of ASCII but digits and small letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def random_weight(src: Column | str, dst: Column | str, seed: int = 1, most: int = 128) -> Column:
    """A whole number from 1 to ``most``, the same for the same edge and seed.

    Whole-number arithmetic only, so that SQL elsewhere can state it: a mix of the ends,
    then two steps of a multiplicative generator modulo 2^31 - 1.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (src, dst))
    mixed = F.pmod(a.cast("long") * 7919 + b.cast("long") * 104729 + F.lit(seed * 1299709).cast("long"), F.lit(2147483647))
    for _ in range(2):
        mixed = (mixed * 48271 + 12345) % 2147483647
    return (F.floor(mixed / 1024).cast("long") % most + 1).cast("long")


def pieces(text: Column | str) -> Column:
    """tokens() with empty entries where a text begins or ends with none."""
    return F.split(F.lower(text), NOT_WORD)


def tokens(text: Column | str) -> Column:
    """Runs of digits, a-z and characters past ASCII after lower-casing, as an array
    without empty entries."""
    return F.filter(pieces(text), lambda x: x != "")


def string_hash(text: Column | str, multiplier: int = 31, both_ways: bool = False) -> Column:
    """A 64-bit hash of a string; with both_ways one that a string and its reversal share a part of."""
    c = F.col(text) if isinstance(text, str) else text
    one = F.xxhash64(c, F.lit(multiplier))
    return one.bitwiseXOR(F.xxhash64(F.reverse(c), F.lit(multiplier))) if both_ways else one


def bucket_id(id_col: Column | str, buckets: int, height: int) -> Column:
    """A reversible permutation of 0 to buckets * height - 1 that deals neighbours to
    different buckets; see bucket_id_back()."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return (c % buckets) * height + F.floor(c / buckets).cast("long")


def bucket_id_back(dealt: Column | str, buckets: int, height: int) -> Column:
    c = F.col(dealt) if isinstance(dealt, str) else dealt
    return (c % height) * buckets + F.floor(c / height).cast("long")
