"""Seeded choice from content, never from ``rand()``: the same rows give the same answer on a retry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_key(seed: int | str, *cols: Column | str) -> Column:
    """md5 over ``seed:col:col...``; its order is a fixed pseudo-random permutation."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(key: Column, digits: int = 2) -> Column:
    """The leading hex digits as text: orders as the key does and spreads rows evenly."""
    return F.substring(key, 1, digits)


def hash_digits(rows: int, per_bucket: int = 4096) -> int:
    """How many leading hex digits cut a group of ``rows`` into buckets of about ``per_bucket`` rows; 1 to 15."""
    digits = 1
    while digits < 15 and rows > per_bucket * 16**digits:
        digits += 1
    return digits


def uniform_int(key: Column, n: Column | int) -> Column:
    """A whole number in ``[0, n)`` from the first 15 hex digits of ``key``."""
    return F.pmod(F.conv(F.substring(key, 1, 15), 16, 10).cast("long"), (n if isinstance(n, Column) else F.lit(n)).cast("long"))


def spread(cols: list[str], pieces: int) -> Column:
    """Salt from row content, so that a re-run task deals every row to the same piece."""
    return F.pmod(F.xxhash64(*cols), F.lit(pieces)).cast("int")
