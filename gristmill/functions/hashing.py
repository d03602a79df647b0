"""Stable hashes: the first 64 bits of SHA-256 over parts joined by the unit separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def _part(p) -> Column:
    return p.cast("string") if isinstance(p, Column) else F.lit(str(p))


def stable_hex(*parts) -> Column:
    """Sixteen hex digits; their order is that of the unsigned number they spell."""
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *map(_part, parts)), 256), 1, 16)


def stable_int(*parts) -> Column:
    return F.conv(stable_hex(*parts), 16, 10).cast("decimal(20,0)")


def stable_choice(n: int, *parts) -> Column:
    """One of 0..n-1."""
    return (stable_int(*parts) % n).cast("int")


def uniform(*parts) -> Column:
    """In [0, 1): the first 13 hex digits, so that the quotient is exact."""
    return F.conv(F.substring(stable_hex(*parts), 1, 13), 16, 10).cast("double") / float(1 << 52)


def paired_seed(seed: int, key: Column) -> Column:
    """32 bits from a base seed and a pairing key."""
    return F.conv(F.substring(F.sha2(F.concat_ws(SEPARATOR, F.lit(str(seed)), key), 256), 1, 8), 16, 10).cast("long")


def sample_hash(file: Column, instruction: Column, box: Column) -> Column:
    """Twenty hex digits of a sample's file, instruction and box as a list."""
    from gristmill.functions.geometry import box_list

    return F.substring(F.sha2(F.concat_ws(SEPARATOR, file, instruction, box_list(box)), 256), 1, 20)


def cache_key(digest: Column, box: Column) -> Column:
    """A digest and a box to three places."""
    return F.concat(digest, F.lit(":"), F.array_join(F.transform(box, lambda v: F.format_string("%.3f", v.cast("double"))), ","))


def utc_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
