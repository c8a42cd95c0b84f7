"""Joins of keys with their prefixes, by sorted ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from slidegrid.session import cut_lineage


def prefix_join(keys: DataFrame, key: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Every pair of a row of ``keys`` and a row of ``prefixes`` whose ``prefix`` starts the row's ``key``.

    A prefix is the interval of all strings that start with it, and intervals nest. Both tables are sorted together in
    range partitions, prefixes before equal keys; a sweep keeps the stack of open intervals, so a key meets its
    prefixes without being compared with any other. Intervals that begin in an earlier partition are found from each
    partition's first string: its own prefixes, at most one per character, are looked up once per partition. Frequent keys are
    spread over partitions by row content. Null keys and null or empty prefixes match nothing; equal rows match one by one.
    """
    left, right = [c for c in keys.columns], [c for c in prefixes.columns]
    clash = set(left) & set(right)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    row, mine = F.struct(*[F.col(c) for c in left]), F.struct(*[F.col(c) for c in right])
    asked = prefixes.where(F.col(prefix) != "")
    stacked = asked.select(F.col(prefix).cast("string").alias("k"), F.lit(0).alias("kind"), mine.alias("p"), F.xxhash64(*right).alias("salt")).unionByName(
        keys.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.lit(1).alias("kind"), row.alias("r"), F.xxhash64(*left).alias("salt")),
        allowMissingColumns=True,
    )
    ordered = stacked.repartitionByRange("k", "kind", "salt").sortWithinPartitions("k", "kind", "salt").select("k", "kind", "p", "r")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, first, stack = TaskContext.get().partitionId(), None, []
        for batch in batches:
            found, shared, whole = [], [], batch.column("p").to_pylist()
            for i, (k, kind) in enumerate(zip(batch.column("k").to_pylist(), batch.column("kind").to_pylist())):
                first = k if first is None else first
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((k, whole[i]))
                found.append([p for _, p in stack] if kind == 1 else None)
                shared.append(_shared(first, k))
            n = batch.num_rows
            columns = [batch.column("k"), batch.column("p"), batch.column("r"), pa.array(found, pa.list_(batch.column("p").type)),
                       pa.array([here] * n, pa.int32()), pa.array(shared, pa.int32()), pa.array([first] * n, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "p", "r", "found", "part", "shared", "first"])

    schema = f"k string, p {kinds['p']}, r {kinds['r']}, found array<{kinds['p']}>, part int, shared int, first string"
    swept = cut_lineage(ordered.mapInArrow(sweep, schema))
    opened = swept.where("p IS NOT NULL").select("k", "p", F.col("part").alias("from"))
    starts = swept.groupBy("part").agg(F.first("first").alias("first"))
    heads = starts.select("part", F.explode(F.sequence(F.lit(1), F.greatest(F.length("first"), F.lit(1)))).alias("n"), "first")
    carried = heads.select("part", "n", F.expr("substring(first, 1, n)").alias("k")).join(opened, "k").where(F.col("from") < F.col("part")).select("part", "n", "p")
    rows = swept.where("r IS NOT NULL")
    pairs = rows.select("r", F.explode("found").alias("p")).unionByName(
        rows.select("part", "shared", "r").join(carried, "part").where(F.col("n") <= F.col("shared")).select("r", "p"))
    return pairs.select("r.*", "p.*")


def _shared(a: str, b: str) -> int:
    """How many leading characters two strings share."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    return next(i for i in range(most) if a[i] != b[i])
