"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source has a target number of words: its share by weight, at most ``most`` times its size, the excess reshared by weight.
Its documents stand in a seeded order, which is cut into blocks of about ``block_words`` words; a document belongs to the block
it begins in. A seeded permutation (a Feistel network) puts the blocks of each pass over the source in an order of drawing; the
number of blocks drawn before the target is met is the source's quota. The last block drawn gives only the documents that bring
the words nearest to the target.

The output shards are the leaves of a binary tree. Each node splits its quotas between its halves by one multivariate
hypergeometric draw seeded by the node, so every shard gets an exact number of blocks of each source, as if all blocks had been
dealt from one shuffled deck. A leaf finds its quotas by walking down from the root and takes the next so many drawn blocks of
each source: blocks of different shards are disjoint, and shards need no common state. A document is taken as often as a shard
holds its block. The documents of a shard are shuffled within it.

Sources come in groups of ``GROUP_SOURCES``. A node first splits the totals of the groups, then each group's share among its
sources; a task works on the sources of one group and a stretch of shards. What reaches a task as a whole is one number per
group and those of one group's sources.

Sizes are sums over all documents. Prefix sums go by buckets of the seeded order, so a source with most rows is spread over
them. Blocks grow beyond ``block_words`` where a mix would have more than ``MOST_BLOCKS`` of them; targets hold at any size.

Null texts have size 0. Documents of size 0 are taken no times; everything else is taken zero to ``most`` times. A null source
is a source of its own, last in order. Repeated rows are separate rows. Order and draws depend on seed and content alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from slidegrid.llm.words import whole_text, word_count
from slidegrid.operators.ordered import BUCKET, dense_positions, running_totals, split_points, value_bucket
from slidegrid.operators.skew import copies_join
from slidegrid.session import cut_lineage, prefix_buckets, scratch_folder

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
BLOCK_WORDS, SHARD_BLOCKS = 20_000, 50
#: Blocks of a mix; numpy draws from fewer than 10^9.
MOST_BLOCKS = 100_000_000
#: Sources whose quotas a task splits together, shards it splits them over, and blocks it numbers.
GROUP_SOURCES, TASK_SHARDS, TASK_BLOCKS = 4096, 512, 1 << 16
ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written to the shared folder with a row number: what reads it twice sees the same rows."""
    folder = f"{scratch_folder(docs.sparkSession)}/rows"
    docs.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, number, source_size, target) of every source in ``sized`` (source, size).

    Sources in the order of their code points, null last, weigh ``weights`` in turn. Targets are min(most * size, level *
    weight); the level is where they sum to ``share`` of all words. In the order of most * size / weight a source is full if
    the level at its own ratio would not yet use all words; prefix sums tell that for all at once.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    ranged = cut_lineage(sums.repartitionByRange(prefix_buckets(spark), order).withColumn(BUCKET, F.spark_partition_id()))
    placed = dense_positions(ranged, [], [order], F.col(BUCKET), out="number")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    table = cut_lineage(placed.withColumn("weight", turn).withColumn("cap", F.col("source_size").cast("double") * most).withColumn("ratio", F.col("cap") / F.col("weight")))
    budget = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    upto = running_totals(
        value_bucket(table, "ratio", split_points(table, "ratio")), [], ["ratio", "number"], {"caps": F.col("cap"), "weights": F.col("weight")}, with_total=True
    )
    full = F.col("caps") + F.col("ratio") * (F.col("total_weights") - F.col("weights")) <= budget
    row = upto.agg(
        F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("used"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        F.coalesce(F.max("ratio"), F.lit(0.0)).alias("top"),
    ).first()
    level = (budget - row["used"]) / row["open"] if row["open"] else row["top"]
    return table.select("source", "number", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _place(seed: int, *content: Column) -> Column:
    return F.xxhash64(F.lit(seed), *content)


def permuted(ranks: np.ndarray, n: int, key: int) -> np.ndarray:
    """A seeded permutation of 0..n-1 at ``ranks``: a Feistel network over the next power of four, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = np.random.Generator(np.random.Philox(key=key)).integers(0, 1 << 63, 6, dtype=np.uint64)
    out = ranks.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in rounds:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(32)) & mask
        out[todo] = left << np.uint64(half) | right
        todo = out >= n
    return out.astype(np.int64)


def _node_key(seed: int, low: int, high: int) -> int:
    return ((seed * 0x9E3779B97F4A7C15 + low) * 0xBF58476D1CE4E5B9 + high) % (1 << 127)


def shard_quotas(quotas: np.ndarray, shards: int, first: int, last: int, seed: int, groups: np.ndarray | None = None, group: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For shards ``first`` to ``last`` (not included): (shard, blocks before it of each source, its blocks of each source).

    ``quotas`` are those of the sources of one group, ``groups`` the sums of all groups.
    """
    groups = np.array([quotas.sum()]) if groups is None else groups
    blocks = int(groups.sum())
    upto = lambda shard: blocks * shard // shards
    stack = [(0, shards, groups, quotas, np.zeros_like(quotas))]
    while stack:
        low, high, sums, here, before = stack.pop()
        if high <= first or low >= last:
            continue
        if high - low == 1:
            yield low, before, here
            continue
        middle = (low + high) // 2
        left = _drawn(sums, upto(middle) - upto(low), _node_key(seed, low, high))
        own = _drawn(here, int(left[group]), _node_key(seed + 1 + group, low, high))
        stack.append((middle, high, sums - left, here - own, before + own))
        stack.append((low, middle, left, own, before))


def _drawn(quotas: np.ndarray, n: int, key: int) -> np.ndarray:
    rng = np.random.Generator(np.random.Philox(key=key))
    return rng.multivariate_hypergeometric(quotas, n, method="marginals") if n else np.zeros_like(quotas)


def _in_order(sources: DataFrame, most: int, seed: int) -> DataFrame:
    """(number, at, block, pass): the blocks of every source (number, blocks) in the order of drawing, ``most`` passes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, n, first in zip(*(batch.column(c).to_pylist() for c in ("number", "blocks", "first")), strict=True):
                at = np.arange(first, min(first + TASK_BLOCKS, most * n))
                block = np.empty_like(at)
                for k in range(first // n, int(at[-1]) // n + 1):
                    own = at // n == k
                    block[own] = permuted(at[own] - k * n, n, _node_key(seed, number, -1 - k))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), pa.array(at), pa.array(block), pa.array(at // n)], names=["number", "at", "block", "pass"])

    cut = sources.select("number", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") * most - 1, F.lit(TASK_BLOCKS).cast("long"))).alias("first"))
    return cut.repartition(prefix_buckets(sources.sparkSession), "number", "first").mapInArrow(run, "number long, at long, block long, pass long")


def _dealt(quotas: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """(number, at, shard) of every block drawn: leaves of the splitting tree take the next blocks of each source (number, quota)."""
    grouped = quotas.withColumn("group", F.floor(F.col("number") / GROUP_SOURCES))
    sums = grouped.groupBy("group").agg(F.sum("quota").alias("n")).collect()
    totals = np.zeros(1 + max((r["group"] for r in sums), default=0), dtype=np.int64)
    for r in sums:
        totals[r["group"]] = r["n"]
    shards = max(1, math.ceil(int(totals.sum()) / shard_blocks))

    def leaves(table: pa.Table) -> pa.Table:
        group, first = table["group"][0].as_py(), table["first"][0].as_py()
        numbers, own = table["number"].to_numpy(), table["quota"].to_numpy()
        order = np.argsort(numbers)
        numbers, own = numbers[order], own[order]
        out: list[list[np.ndarray]] = [[], [], []]
        for shard, before, here in shard_quotas(own, shards, first, min(first + TASK_SHARDS, shards), seed, totals, group):
            for i in np.flatnonzero(here).tolist():
                at = np.arange(before[i], before[i] + here[i])
                for column, values in zip(out, (np.full(len(at), numbers[i]), at, np.full(len(at), shard)), strict=True):
                    column.append(values)
        return pa.table({c: pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for c, v in zip(("number", "at", "shard"), out, strict=True)})

    stretches = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"), F.lit(TASK_SHARDS).cast("long")))
    return grouped.withColumn("first", stretches).groupBy("group", "first").applyInArrow(leaves, "number long, at long, shard long")


def plan(rows: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, **shares) -> DataFrame:
    """The plan of a mix of ``rows`` (row, source, size, place): each row with source_size, target, and one shard per copy.

    ``rows`` must give the same rows whenever it is read (a checkpoint or written table). ``place`` is a seeded hash of
    the row's content; it orders the rows of a source. Adds block, source_size, target, shard_1 ... shard_most (null: not taken).
    """
    most = shares.get("most", MOST)
    sources = source_targets(rows.select("source", "size"), **shares)
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    width = max(block_words, math.ceil(words * most / MOST_BLOCKS))
    sources = cut_lineage(sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / width)).cast("long")))
    bits = min(20, (rows.count() // 50_000).bit_length() + 8)  # hundreds of buckets, so a source with most rows spreads evenly
    named = lambda df: df.withColumn("__key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    known = copies_join(named(rows), named(sources).drop("source"), ["__key"], salt_on=["row"]).drop("__key")
    in_order = known.withColumn(BUCKET, F.shiftright(F.col("place"), 64 - bits))
    upto = running_totals(in_order, ["number"], ["place", "row"], {"__start": F.col("size")}).drop(BUCKET).withColumn("__start", F.col("__start") - F.col("size"))
    begun = F.least(F.floor(F.col("__start") / width), F.col("blocks") - 1)
    placed = cut_lineage(upto.withColumn("block", F.when(F.col("size") > 0, begun)).drop("blocks"))

    sizes = placed.where("block IS NOT NULL").groupBy("number", "block").agg(F.sum("size").alias("words"), F.min("__start").alias("__first"))
    ranked = _in_order(sources.select("number", "blocks"), most, seed).join(sizes, ["number", "block"], "left").withColumn("words", F.coalesce("words", F.lit(0)))
    summed = running_totals(ranked.withColumn(BUCKET, F.floor(F.col("at") / TASK_BLOCKS)), ["number"], ["at"], {"__upto": F.col("words")}).drop(BUCKET)
    drawn = cut_lineage(
        copies_join(summed, sources.select("number", "target"), ["number"], salt_on=["at"]).withColumn("room", F.col("target") - (F.col("__upto") - F.col("words"))).where("room > 0")
        .select("number", "at", "block", "pass", "room", "__first")
    )
    quotas = drawn.groupBy("number").agg(F.count("*").alias("quota"))
    held = drawn.where("__first IS NOT NULL").join(_dealt(quotas, shard_blocks, seed), ["number", "at"])
    wide = held.groupBy("number", "block").agg(F.first("__first").alias("__first"), *[
        F.max(F.when(F.col("pass") == k, F.col(c))).alias(f"__{c}_{k + 1}") for k in range(most) for c in ("shard", "room")
    ])
    taken = placed.join(wide, ["number", "block"], "left")
    middle = F.col("__start") - F.col("__first") + F.col("size") / 2
    return taken.select(*rows.columns, "block", "source_size", "target", *[
        F.when(middle <= F.col(f"__room_{k + 1}"), F.col(f"__shard_{k + 1}")).alias(f"shard_{k + 1}") for k in range(most)
    ])


def copies(most: int = MOST) -> Column:
    return sum((F.col(f"shard_{k}").isNotNull().cast("int") for k in range(1, most + 1)), F.lit(0))


def mix_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **shares) -> DataFrame:
    """One row per document: key, size, source_size, target, taken, copies and the shard of each copy."""
    most = shares.get("most", MOST)
    rows = cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(source).alias("source"),
        word_count(whole_text(text)).alias("size"), _place(seed, F.col(key), F.col(text)).alias("place"),
    ))
    planned = plan(rows, seed, **shares)
    shards = F.array_compact(F.array(*[F.col(f"shard_{k}") for k in range(1, most + 1)]))
    return planned.select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * copies(most)).alias("taken"), copies(most).alias("copies"), shards.alias("shards")
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, with_place: bool = True, **shares) -> DataFrame:
    """The mix itself: every copy taken of every row, in shards, shuffled within each.

    A partition holds whole shards, one after another, each in its shuffled order: written files are the shards.
    With ``with_place`` the columns shard and place_in_shard follow those of ``docs`` and must be new.
    """
    if with_place and {"shard", "place_in_shard"} & set(docs.columns):
        raise ValueError("columns shard or place_in_shard exist")
    most = shares.get("most", MOST)
    rows = numbered(docs)
    narrow = cut_lineage(rows.select(
        F.col(ROW).alias("row"), F.col(source).alias("source"), word_count(whole_text(text)).alias("size"), _place(seed, F.col(key), F.col(text)).alias("place")
    ))
    planned = plan(narrow, seed, **shares)
    each = planned.select("row", F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"shard_{k}").isNotNull(), F.struct(F.col(f"shard_{k}").alias("shard"), _place(seed + k, F.col("place"), F.col(f"shard_{k}")).alias("at"))) for k in range(1, most + 1)
    ]))).alias("copy")).select(F.col("row").alias("__copy_of"), F.col("copy.shard").alias("__shard"), F.col("copy.at").alias("__at"))
    if not with_place:
        copied = rows.join(each, F.col(ROW) == F.col("__copy_of")).repartition("__shard").sortWithinPartitions("__shard", "__at", "__copy_of")
        return copied.select(*docs.columns)
    order = Window.partitionBy("__shard").orderBy("__at", "__copy_of")
    told = each.withColumn("__place", F.row_number().over(order) - 1)
    return rows.join(told, F.col(ROW) == F.col("__copy_of")).select(*docs.columns, F.col("__shard").alias("shard"), F.col("__place").cast("long").alias("place_in_shard"))
