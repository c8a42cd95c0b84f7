"""Name and token resolution, list slices, file filters."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window, functions as F

from slidegrid.operators.ordered import dense_positions, index_bucket
from slidegrid.operators.prefixes import prefix_join
from slidegrid.operators.skew import spread_join
from slidegrid.session import cut_lineage

TIERS = ["name", "stem", "sample", "patient", "prefix"]


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def resolve_tokens(tokens: DataFrame, index: DataFrame, barcode_prefix: str = "TCGA-") -> tuple[DataFrame, DataFrame]:
    """Resolve (pos, token) against (file_name, sample, patient): (matches, unresolved).

    The first tier with a match wins for a token: exact name, stem, sample, patient, then any-case
    prefix. A file is reported once, for the earliest token that names it. The first four tiers are one equi-join; the
    prefix tier is a sweep over tokens and stems in sorted order (``prefix_join``).
    """
    wanted = tokens.where(F.trim("token") != "").groupBy(F.trim("token").alias("token")).agg(F.min("pos").alias("pos"))
    asked = wanted.select("token", "pos", F.explode(F.array(*[F.lit(t) for t in range(4)])).alias("tier"), F.col("token").alias("key"))
    files = index.groupBy("file_name").agg(F.min(F.struct("sample", "patient")).alias("i")).select("file_name", "i.*")
    stem = file_stem(F.col("file_name"))
    names = [F.col("file_name"), stem, F.col("sample"), F.col("patient")]
    offered = files.select(
        "file_name", F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), name.alias("key")) for t, name in enumerate(names)])).alias("k")
    ).select("file_name", "k.tier", "k.key").where(F.nullif(F.col("key"), F.lit("")).isNotNull())
    exact = spread_join(offered, asked, ["tier", "key"], salt_on=["file_name"]).select("token", "pos", "tier", "file_name")
    barcodes = wanted.where(F.upper("token").startswith(barcode_prefix.upper())).withColumn("__prefix", F.upper("token"))
    begun = prefix_join(files.select("file_name", F.upper(stem).alias("__stem")), "__stem", barcodes, "__prefix")
    # Read three times below, so it is kept: its size is that of the matches.
    hits = cut_lineage(exact.unionByName(begun.select("token", "pos", F.lit(4).alias("tier"), "file_name")))
    best = hits.groupBy("token").agg(F.min("tier").alias("tier"))
    matches = (
        spread_join(hits, best, ["token", "tier"], salt_on=["file_name"])
        .groupBy("file_name")
        .agg(F.min(F.struct("pos", "tier", "token")).alias("m"))
        .select("file_name", "m.pos", "m.tier", "m.token")
    )
    return matches, wanted.join(best, "token", "left_anti").select("token", "pos")


def ordered_union(lists: list[DataFrame]) -> DataFrame:
    """Lists of (pos, token) one after another, duplicates keeping their first place."""
    stacked = None
    for i, one in enumerate(lists):
        part = one.select(F.lit(i).alias("list_no"), F.col("pos").cast("long").alias("pos"), "token")
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy("token").agg(F.min(F.struct("list_no", "pos")).alias("at")).select(
        "token", "at.list_no", "at.pos"
    )


def parse_range(spec: str | None, start: int | None = None, end: int | None = None, count: int | None = None):
    """(first, last or None) of a 1-based inclusive slice: ``a:b``, ``a-b``, or start with end or count."""
    first, last = 1, None
    if spec:
        left, _, right = spec.strip().partition(":" if ":" in spec else "-")
        first = int(left) if left.strip() else 1
        last = int(right) if right.strip() else None
    first = start if start is not None else first
    last = end if end is not None else last
    if count is not None:
        last = first + count - 1
    return max(first, 1), last


def range_slice(df: DataFrame, pos: str, spec: str | None = None, **kw: int) -> DataFrame:
    """Rows of a 1-based inclusive range over consecutive positions ``pos`` (0-based), clamped."""
    first, last = parse_range(spec, **kw)
    if last is not None and last < first:
        last = first
    rank = F.col(pos) + 1
    return df.where((rank >= first) if last is None else rank.between(first, last))


def first_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows: each task keeps ``n``, then the winners meet."""
    return df.orderBy(*order).limit(n)


def every_nth(df: DataFrame, index: str, n: int) -> DataFrame:
    return df.where(F.col(index) % n == 0)


def number_rows(df: DataFrame, index: str, chunk: int | None = None, by: list[str] = ()) -> DataFrame:
    """Consecutive ``seq`` in order of a unique whole-number ``index``; ``batch`` counts chunks."""
    out = dense_positions(df, list(by), [index], index_bucket(F.col(index)), "seq")
    return out if chunk is None else out.withColumn("batch", F.floor(F.col("seq") / chunk).cast("long"))


def glob_filter(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Case-sensitive shell pattern on a name column."""
    regex = "^" + _glob_regex(pattern) + "$"
    return df.where(F.rlike(F.col(col), F.lit(regex)))


def _glob_regex(pattern: str) -> str:
    return fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z")


def state_filter(df: DataFrame, state: str = "state", wanted: str = "released") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): a blank state counts as released."""
    bad = F.coalesce((F.trim(state) != "") & (F.col(state) != wanted), F.lit(False))
    return df.where(~bad), df.where(bad)


def match_substring(df: DataFrame, col: str, text: str, choice: int | None = None) -> DataFrame:
    """Rows whose name contains ``text`` in name order; ``choice`` picks one (0-based)."""
    hits = df.where(F.contains(F.col(col), F.lit(text)))
    if choice is None:
        return hits
    first = hits.orderBy(col).limit(choice + 1)
    return first.withColumn("__r", F.row_number().over(Window.orderBy(col))).where(F.col("__r") == choice + 1).drop("__r")


def resolve_columns(columns: list[str], wanted: dict[str, list[str]]) -> dict[str, str | None]:
    """Header names by any-case equality or by ``.name`` / ``_name`` ending; exact spelling first."""
    found: dict[str, str | None] = {}
    for out, names in wanted.items():
        found[out] = None
        for name in names:
            exact = [c for c in columns if c == name]
            loose = [
                c for c in columns if c.lower() == name.lower() or c.lower().endswith((f".{name.lower()}", f"_{name.lower()}"))
            ]
            if exact or loose:
                found[out] = (exact or loose)[0]
                break
    return found
