"""Joins whose key may hold a large share of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slidegrid.functions.hashing import spread
from slidegrid.session import hot_rows, salt_count


def copies_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salt_on: list[str] | None = None) -> DataFrame:
    """Join of many rows per key against a few numbers per key (tile statistics onto pixels).

    ``big`` is dealt into salted pieces by row content and ``small`` repeated once per piece, so a hot
    key is worked on by that many tasks. For a ``small`` of almost the size of ``big`` use
    ``spread_join``.
    """
    salts = salt_count(big.sparkSession)
    dealt = big.withColumn("__salt", spread(_content(big, on, salt_on), salts))
    pieces = small.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return dealt.join(pieces, [*on, "__salt"], how).drop("__salt")


def spread_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salt_on: list[str] | None = None) -> DataFrame:
    """Join where some keys of ``big`` may be very frequent and ``small`` has one row per key.

    Keys of more than ``spark.slidegrid.hotRows`` rows (a million) are found by one combined count over
    the key columns. Only those are salted on the big side and repeated on the small side; every other
    row joins as usual. The broadcast list of hot keys is at most (rows of ``big``) / hotRows long.
    """
    spark = big.sparkSession
    pieces = 8 * salt_count(spark)
    hot = (
        big.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows(spark))
        .select(*on, F.lit(True).alias("__hot"))
    )
    dealt = big.join(F.broadcast(hot), on, "left").withColumn(
        "__salt", F.when(F.col("__hot"), spread(_content(big, on, salt_on), pieces)).otherwise(0)
    )
    copies = small.join(F.broadcast(hot), on, "left").withColumn(
        "__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0))))
    )
    return dealt.drop("__hot").join(copies.drop("__hot"), [*on, "__salt"], how).drop("__salt")


def _content(big: DataFrame, on: list[str], salt_on: list[str] | None) -> list[str]:
    return salt_on or [c for c in big.columns if c not in on] or on
