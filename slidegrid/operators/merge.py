"""Joins between whole tables: merges, restrictions, overlays, reconciliation, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def merge_tables(tables: dict[str, DataFrame], key: str, order: dict[str, list[str]]) -> DataFrame:
    """Full outer merge of any number of tables, with an ``in_<table>`` flag each.

    Instead of a chain of outer joins the tables are stacked and grouped once, so the key is shuffled
    one time and duplicates of a key collapse on the map side. Per table the first row of a key by
    ``order`` wins; columns appear as ``<table>_<column>``.
    """
    slots = {}
    stacked = []
    for name, df in tables.items():
        rest = [c for c in df.columns if c != key]
        ordered = [*order[name], *[c for c in rest if c not in order[name]]]
        slots[name] = rest
        stacked.append(df.where(F.col(key).isNotNull()).select(key, F.struct(*ordered).alias(f"__{name}")))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    grouped = union.groupBy(key).agg(*[F.min(f"__{n}").alias(f"__{n}") for n in tables])
    return grouped.select(
        key,
        *[F.col(f"__{n}").isNotNull().alias(f"in_{n}") for n in tables],
        *[F.col(f"__{n}.{c}").alias(f"{n}_{c}") for n, cols in slots.items() for c in cols],
    )


def restrict(df: DataFrame, keys: DataFrame, on: list[str], keep: bool = True) -> DataFrame:
    """Rows whose key is (or is not) among ``keys``."""
    return df.join(keys.select(*on).distinct(), on, "left_semi" if keep else "left_anti")


def align(features: DataFrame, labels: DataFrame, on: str = "slide") -> tuple[DataFrame, DataFrame]:
    """(feature rows with their label, labelled slides without features)."""
    return features.join(labels, on), labels.join(features.select(on).distinct(), on, "left_anti")


def overlay(base: DataFrame, fresh: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Base rows refreshed by non-null fresh values; ``has_fresh`` tells which rows were found."""
    new = fresh.select(key, *[F.col(c).alias(f"__{c}") for c in cols], F.lit(True).alias("__seen"))
    joined = base.join(new, key, "left")
    return joined.withColumns(
        {
            **{c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in cols},
            "has_fresh": F.coalesce(F.col("__seen"), F.lit(False)),
        }
    ).drop(*[f"__{c}" for c in cols], "__seen")


def reconcile(
    remote: DataFrame, local: DataFrame, root: str, size_check: bool = True, verify: bool = False, force: bool = False
) -> DataFrame:
    """State of each wanted file: remote (file_id, file_name, md5, size) against local (path, length[, md5]).

    A local copy lies flat as ``<root>/<name>`` or nested as ``<root>/<id>/<name>``; the flat one is
    preferred and files elsewhere are no copies. With ``verify`` a copy without a digest, or one whose
    wanted digest is unknown, is ``not verifiable`` rather than present.
    """
    tail = F.regexp_extract("path", r"([^/]+)$", 1)
    parent = F.regexp_extract("path", r"^(.*?)/*[^/]+$", 1)
    home = root.rstrip("/")
    carry = ["length", *(["md5"] if verify else [])]
    have = local.select(tail.alias("file_name"), parent.alias("__parent"), *[F.col(c).alias(f"local_{c}") for c in carry])
    names = [f"local_{c}" for c in carry]
    nested = F.col("__parent") == F.concat(F.lit(home + "/"), F.col("file_id"))
    mine = remote.select("file_id", "file_name").distinct().join(have, "file_name").where((F.col("__parent") == home) | nested)
    joined = remote.join(mine, ["file_id", "file_name"], "left")
    one = joined.groupBy(*remote.columns).agg(
        F.min_by(F.struct(*names), F.when(nested, 1).otherwise(0)).alias("__l")
    ).select(*remote.columns, *[F.col(f"__l.{n}").alias(n) for n in names])
    length = F.col("local_length")
    known = F.coalesce(F.col("size"), F.lit(0)) > 0
    reason = F.when(F.lit(force), "forced").when(length.isNull(), "missing").when(length == 0, "empty file")
    if size_check:
        reason = reason.when(known & (length < F.col("size")), "partial").when(
            known & (length != F.col("size")), "size mismatch"
        )
    if verify:
        reason = reason.when(F.col("local_md5") != F.col("md5"), "md5 mismatch").when(
            F.col("local_md5").isNull() | F.nullif(F.col("md5"), F.lit("")).isNull(), "not verifiable"
        )
    return one.withColumn("reason", reason.otherwise("present"))


def stale_bags(cached: DataFrame, current: DataFrame, by: str = "slide") -> DataFrame:
    """Slides whose cached coordinates differ from the current ones, or have none cached.

    Exact and order-aware through ``tile_idx``: both tables are stacked with opposite signs and must
    cancel row by row. No slide is gathered anywhere.
    """
    cols = [by, "tile_idx", "x", "y"]
    both = cached.select(*cols, F.lit(-1).alias("__w")).unionByName(current.select(*cols, F.lit(1).alias("__w")))
    cells = both.groupBy(*cols).agg(F.sum("__w").alias("__net"), F.max("__w").alias("__top"))
    return cells.groupBy(by).agg(
        F.max(F.col("__net") != 0).alias("__diff"), F.max(F.col("__top") == 1).alias("__now")
    ).where(F.col("__diff") & F.col("__now")).select(by)


def count_ratio(ours: DataFrame, theirs: DataFrame, by: str = "slide") -> DataFrame:
    """Kept tiles per slide on both sides and their ratio."""
    a = ours.groupBy(by).agg(F.count("*").alias("n_ours"))
    b = theirs.groupBy(by).agg(F.count("*").alias("n_theirs"))
    return a.join(b, by).withColumn("ratio", F.col("n_ours") / F.col("n_theirs"))


def zero_tile_slides(slides: DataFrame, tiles: DataFrame, by: str = "slide") -> tuple[DataFrame, DataFrame]:
    """(slides with tiles, skipped slides with the reason)."""
    have = tiles.select(by).distinct()
    return slides.join(have, by, "left_semi"), slides.join(have, by, "left_anti").withColumn("reason", F.lit("no tiles kept"))


def union_keys(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), frames).distinct()


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def missing_keys(expected: DataFrame, present: DataFrame) -> DataFrame:
    return expected.subtract(present)
