"""Prefix tries of conversations: union-find over the LCP edges of sorted neighbours.

A conversation is a sequence of turns (role, text); every turn is known by 16 bytes of a SHA-256 digest, so a sequence is a byte
string whose order and common prefixes are those of the sequence. Sorted strings are cut into blocks. In a block, neighbours are
linked by edges that carry the number of turns they share, and the edges are taken in descending depth: a union-find merges the two
components of an edge, and the merge is the trie node at that depth (a branching one, or the end of the shorter sequence). The
stretch between two merges is a chain of nodes with the same members.

Prefixes of a block's first and last sequence may go on in the neighbouring blocks. They stay open: the block is contracted to
these two spines, which carry what hangs off them (members, children, leaves, saved tokens) by depth; every other node is final.
Spines are sequences again, so the same step sorts and merges them across boundaries, level by level, until one block holds them all.
A level leaves at most two sequences per block of thousands. Nothing but these bounded blocks is gathered; copies of one conversation
are spread over blocks by conv_id, and a node whose members end there in several blocks gets its digest from runs of ids that each
block has joined and one task reads in order.

Rows with a null conv_id take no part. Turns are ordered by turn, null first, equal turns by their digest; repeated rows are
repeated turns. Null role and text count as empty. No conversation gives no node, not even a root. Other columns are ignored. The
digests of one conversation (16 bytes a turn) must fit a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from slidegrid.session import scratch_folder

#: Sequences, and turns, of one block.
BLOCK, BLOCK_TURNS = 20_000, 1 << 20
#: Ids in one joined run.
RUN_IDS = 4096
DIGEST = 16
NOTHING = hashlib.sha256(b"").hexdigest()

PART = T.StructType([T.StructField(c, T.LongType()) for c in ("depth", "members", "first", "children", "leaves", "saved")])
#: Rows of kind "node" (final but for parent_ref and ends), "spine" and "ends" share one table.
FOREST = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("ref", T.BinaryType()), T.StructField("parent_ref", T.BinaryType()),
    T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("parent_conv_id", T.LongType()),
    T.StructField("n_convs", T.LongType()), T.StructField("n_children", T.LongType()), T.StructField("n_leaves", T.LongType()),
    T.StructField("saved_tokens", T.LongType()), T.StructField("ends", T.StringType()),
    T.StructField("path", T.BinaryType()), T.StructField("chars", T.ArrayType(T.LongType())), T.StructField("parts", T.ArrayType(PART)),
])
_PART = pa.struct([(f.name, pa.int64()) for f in PART])
_ARROW = pa.schema([
    ("kind", pa.string()), ("ref", pa.binary()), ("parent_ref", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
    ("path", pa.binary()), ("chars", pa.list_(pa.int64())), ("parts", pa.list_(_PART)),
])


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, path (16 bytes a turn), chars (code points a turn) of every conversation; texts are read, not shuffled."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    named = F.concat(F.length(said[0]).cast("string"), F.lit(":"), said[0], said[1])
    digest = F.substring(F.unhex(F.sha2(named, 256)), 1, DIGEST)
    one = F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.length(said[1]).cast("long").alias("chars"))
    listed = turns.where(F.col(conv).isNotNull()).groupBy(F.col(conv).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return listed.select("conv_id", _joined(F.col("t.digest")).alias("path"), F.col("t.chars").alias("chars"))


def _joined(digests: Column) -> Column:
    """The digests of an array as one byte string."""
    return F.unhex(F.array_join(F.transform(digests, lambda d: F.hex(d)), ""))


def rebuild(own: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Sequences whose first h turns are those of conversation c - c % block; h is crc32(decimal c) % most."""
    c = F.col("conv_id")
    heads = own.where(c % block == 0).select(
        c.alias("base"), F.substring("path", 1, DIGEST * (most - 1)).alias("head"), F.slice("chars", 1, most - 1).alias("head_chars")
    )
    h = (F.crc32(c.cast("string")) % most).cast("int")
    both = own.withColumn("base", c - c % block).join(heads, "base", "left").withColumn("h", h)
    head, chars = F.coalesce("head", F.unhex(F.lit(""))), F.coalesce("head_chars", F.array().cast("array<bigint>"))
    rest = F.greatest(F.octet_length("path") - DIGEST * F.col("h"), F.lit(0))
    return both.select(
        "conv_id",
        F.concat(F.substring(head, F.lit(1), F.col("h") * DIGEST), F.substring(F.col("path"), F.col("h") * DIGEST + 1, rest)).alias("path"),
        F.concat(F.slice(chars, F.lit(1), F.col("h")), F.slice(F.col("chars"), F.col("h") + 1, F.greatest(F.size("chars") - F.col("h"), F.lit(0)))).alias("chars"),
    )


class _Sums:
    """What is known of the node at the top of a component, without its children inside the component's open spine."""

    __slots__ = ("members", "first", "children", "leaves", "saved")

    def __init__(self, members=0, first=None, children=0, leaves=0, saved=0):
        self.members, self.first, self.children, self.leaves, self.saved = members, first, children, leaves, saved

    def add(self, other: "_Sums") -> None:
        self.members += other.members
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        if other.first is not None and (self.first is None or other.first < self.first):
            self.first = other.first


class _Component:
    """Sequences that share the prefix of ``depth`` turns of sequence ``of``."""

    __slots__ = ("of", "depth", "sums", "later", "ends", "waiting", "left", "right")

    def __init__(self, of: int, depth: int, sums: _Sums, later: dict[int, _Sums], ends: list[int] | None, left: bool, right: bool):
        self.of, self.depth, self.sums, self.later, self.ends, self.left, self.right = of, depth, sums, later, ends, left, right
        self.waiting: list[int] = []  # final children, whose parent is this component's top node

    @property
    def open(self) -> bool:
        return self.left or self.right


class _Forest:
    """One block: distinct sequences in order, their parts by depth, and (at the first level) the ids that end with them."""

    def __init__(self, paths: list[bytes], chars: list[list[int]], parts: list[dict[int, _Sums]], ends: list[list[int] | None], final: bool):
        self.paths, self.chars, self.final = paths, chars, final
        self.rows: list[dict] = []
        self.spines: tuple[list[tuple[int, _Sums]], list[tuple[int, _Sums]]] = ([], [])
        self.known: dict[int, list[bytes]] = {}
        last = len(paths) - 1
        self.components: list[_Component] = []
        for i, path in enumerate(paths):
            depth = len(path) // DIGEST
            later = parts[i]
            self.components.append(_Component(i, depth, later.pop(depth, None) or _Sums(), later, ends[i], not final and i == 0, not final and i == last))
        self.above = list(range(len(paths)))
        self.named = final or any(e is None for e in ends)

    def run(self) -> list[dict]:
        edges = sorted((-_shared(a, b), i) for i, (a, b) in enumerate(zip(self.paths, self.paths[1:])))
        for depth, i in edges:
            self._merge(self._find(i), self._find(i + 1), -depth)
        whole = self.components[self._find(0)]
        self._raise(whole, -1)
        if not self.final:
            self._spine(0, self.spines[0])
            if len(self.paths) > 1:
                self._spine(len(self.paths) - 1, self.spines[1])
        return self.rows

    def _find(self, i: int) -> int:
        above = self.above
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def _merge(self, a: int, b: int, depth: int) -> None:
        left, right = self.components[a], self.components[b]
        self._raise(left, depth)
        self._raise(right, depth)
        if len(left.later) + len(left.waiting) < len(right.later) + len(right.waiting):
            a, b, left, right = b, a, right, left
        left.sums.add(right.sums)
        left.left, left.right = left.left or right.left, left.right or right.right
        if left.ends is None:
            left.ends = right.ends
        left.waiting += right.waiting
        for at, sums in right.later.items():
            if at in left.later:
                left.later[at].add(sums)
            else:
                left.later[at] = sums
        self.above[b] = a
        self.components[b] = None

    def _raise(self, c: _Component, to: int) -> None:
        """Finish the nodes from the component's depth down to ``to``, which becomes its new top."""
        while c.depth > to:
            below = self._open(c) if c.open else self._close(c)
            c.depth -= 1
            c.sums, c.ends = below, None
            if c.depth in c.later:
                c.sums.add(c.later.pop(c.depth))

    def _close(self, c: _Component) -> _Sums:
        s = c.sums
        leaves = s.leaves if s.children else 1
        saved = s.saved + ((s.members - 1) * self.chars[c.of][c.depth - 1] if c.depth else 0)
        for child in c.waiting:
            self.rows[child]["parent_conv_id"] = s.first
        row = {"kind": "node", "conv_id": s.first, "depth": c.depth, "n_convs": s.members, "n_children": s.children, "n_leaves": leaves, "saved_tokens": saved}
        if self.named:
            row["ref"] = self._refs(c.of)[c.depth]
        elif c.ends:
            row["ends"] = _digest([",".join(map(str, c.ends))])
        self.rows.append(row)
        c.waiting = [len(self.rows) - 1]
        return _Sums(s.members, s.first, 1, leaves, saved)

    def _open(self, c: _Component) -> _Sums:
        ref = self._refs(c.of)[c.depth]
        for child in c.waiting:
            self.rows[child]["parent_ref"] = ref
        c.waiting = []
        for k in range(0, len(c.ends or []), RUN_IDS):
            run = c.ends[k:k + RUN_IDS]
            self.rows.append({"kind": "ends", "ref": ref, "conv_id": run[0], "ends": ",".join(map(str, run))})
        if c.sums.first is not None:
            self.spines[0 if c.left else 1].append((c.depth, c.sums))
        return _Sums()

    def _refs(self, i: int) -> list[bytes]:
        """Names of all prefixes of a sequence."""
        if i not in self.known:
            path, h = self.paths[i], hashlib.sha256()
            refs = [h.digest()[:DIGEST]]
            for k in range(0, len(path), DIGEST):
                h.update(path[k:k + DIGEST])
                refs.append(h.digest()[:DIGEST])
            self.known[i] = refs
        return self.known[i]

    def _spine(self, i: int, parts: list[tuple[int, _Sums]]) -> None:
        listed = [{"depth": d, **{k: getattr(s, k) for k in _Sums.__slots__}} for d, s in parts]
        self.rows.append({"kind": "spine", "path": self.paths[i], "chars": self.chars[i], "parts": listed})


def _shared(a: bytes, b: bytes) -> int:
    """How many leading turns two sequences share."""
    most = min(len(a), len(b)) // DIGEST
    step, at = 1, 0
    while at < most and step:  # gallop, then close in: long copies differ late
        size = min(step, most - at)
        if a[at * DIGEST:(at + size) * DIGEST] == b[at * DIGEST:(at + size) * DIGEST]:
            at += size
            step = size * 2
        else:
            step = size // 2
    return at


def _digest(runs: Iterable[str]) -> str:
    h = hashlib.sha256()
    for k, run in enumerate(runs):
        h.update((("," if k else "") + run).encode())
    return h.hexdigest()


def _blocks(batches: Iterator[pa.RecordBatch], first: bool, final: bool, size: int) -> Iterator[tuple[list, list, list, list]]:
    """Distinct sequences of a sorted stream, ``size`` rows a block; a final stream is one block."""
    paths, chars, parts, ends, rows, turns = [], [], [], [], 0, 0
    for batch in batches:
        ids = batch.column("conv_id").to_pylist() if first else [None] * batch.num_rows
        found = batch.column("parts").to_pylist() if not first else [None] * batch.num_rows
        for path, sizes, cid, given in zip(batch.column("path").to_pylist(), batch.column("chars").to_pylist(), ids, found):
            if not final and (rows >= size or turns >= BLOCK_TURNS):
                yield paths, chars, parts, ends
                paths, chars, parts, ends, rows, turns = [], [], [], [], 0, 0
            rows += 1
            if not paths or paths[-1] != path:
                turns += len(sizes)
                paths.append(path)
                chars.append(sizes)
                parts.append({})
                ends.append([] if first else None)
            if first:
                ends[-1].append(cid)
                given = [{"depth": len(sizes), "members": 1, "first": cid, "children": 0, "leaves": 0, "saved": 0}]
            for p in given:
                depth = p.pop("depth")
                parts[-1].setdefault(depth, _Sums()).add(_Sums(**p))
    if paths:
        yield paths, chars, parts, ends


def _level(rows: DataFrame, first: bool, final: bool, size: int) -> DataFrame:
    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, first, final, size):
            made = _Forest(*block, final).run()
            for k in range(0, len(made), 10_000):
                yield pa.RecordBatch.from_pylist(made[k:k + 10_000], schema=_ARROW)

    return rows.mapInArrow(forests, FOREST)


def build(sequences: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of
    ``sequences`` (conv_id, path, chars)."""
    spark, folder = sequences.sparkSession, scratch_folder(sequences.sparkSession)
    ordered = sequences.select("conv_id", "path", "chars").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    _level(ordered, True, False, block).write.parquet(f"{folder}/0")
    levels = [spark.read.parquet(f"{folder}/0")]
    while n := (spines := levels[-1].where("kind = 'spine'").select("path", "chars", "parts")).count():
        final = n <= block
        parts = 1 if final else max(1, n // (4 * block))
        merged = spines.repartition(1) if final else spines.repartitionByRange(parts, "path")
        at = f"{folder}/{len(levels)}"
        _level(merged.sortWithinPartitions("path"), False, final, block).write.parquet(at)
        levels.append(spark.read.parquet(at))
        if final:
            break
    early, late = (part.where("kind = 'node'").drop("kind", "path", "chars", "parts") for part in (levels[0], _stacked(levels[1:] or [levels[0].limit(0)])))
    ended = _joined_ends(levels[0].where("kind = 'ends'").select("ref", "conv_id", "ends"))
    late = late.join(ended, "ref", "left").withColumn("ends", F.col("__ends")).drop("__ends")  # few: nodes on the borders of blocks
    nodes = early.unionByName(late)
    parents = late.select(F.col("ref").alias("parent_ref"), F.col("conv_id").alias("__parent"))
    below = nodes.where("parent_ref IS NOT NULL").join(parents, "parent_ref", "left").withColumn("parent_conv_id", F.col("__parent")).drop("__parent")
    return nodes.where("parent_ref IS NULL").unionByName(below).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )


def _stacked(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _joined_ends(runs: DataFrame) -> DataFrame:
    """ref, __ends: SHA-256 of the ids of a node that ends in several blocks; its runs are read in order, never held together."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            done = []
            for ref, run in zip(batch.column("ref").to_pylist(), batch.column("ends").to_pylist()):
                if ref != now:
                    if now is not None:
                        done.append((now, h.hexdigest()))
                    now, h = ref, hashlib.sha256(run.encode())
                else:
                    h.update(b"," + run.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["ref", "__ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["ref", "__ends"])

    return runs.repartition("ref").sortWithinPartitions("ref", "conv_id").mapInArrow(digests, "ref binary, __ends string")


def prefix_trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of conversations as they are."""
    return build(sequences(turns), block)


def rebuilt_trie(turns: DataFrame, every: int = 100, most: int = 6, block: int = BLOCK) -> DataFrame:
    """The trie of conversations whose first turns come from the first conversation of their hundred."""
    spark = turns.sparkSession
    at = f"{scratch_folder(spark)}/sequences"
    sequences(turns).write.parquet(at)  # read twice, and far smaller than the texts
    return build(rebuild(spark.read.parquet(at), every, most), block)
