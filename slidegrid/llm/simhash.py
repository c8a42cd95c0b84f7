"""SimHash near-duplicates through anchor points of a covering code.

A fingerprint has 64 bits. Bits 0-22 and 23-45 are each covered by the codewords of a perfect code of length 23 (every value
lies within 3 bits of exactly one codeword); the last 18 bits are covered by one point. The anchors are the pairs of codewords.
Each fingerprint has one home anchor. It is replicated to every anchor within the covering radius plus the threshold: if x and
y differ in d1 + d2 + d3 <= t bits (by block), then y lies within radius + d1 and radius + d2 of the two halves of x's home,
so x and y meet at x's home. Comparing the homes of an anchor with all fingerprints there therefore finds every link.

Only distinct fingerprints are compared. What leaves an anchor is a spanning forest of its links, never all pairs. Anchors
where many fingerprints are at home are dealt into pieces by fingerprint. Components come from repeated contraction of the
links, with a reliable checkpoint in each round.

Null and empty texts have no words: their fingerprint is 0, linked like any other. Repeated rows each get their row. Memory of
a task is bounded by a chunk of text and by the fingerprints at home in one piece of an anchor.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from slidegrid.session import cut_lineage

BITS, SHINGLE, THRESHOLD = 64, 3, 2
#: Generator polynomial of the perfect code of length 23, and its length and covering radius; fixed values.
POLYNOMIAL, LENGTH, RADIUS = 0b101011100011, 23, 3
#: First bits of the blocks that the code covers.
BLOCKS = (0, 23)
CHUNK_BYTES = 4 << 20
CHUNK_PAIRS = 2 << 20

# ------------------------------------------------------------------------------------------------ fingerprints

_LANES = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], dtype=np.uint64)
_PIECE = 255  # shingles whose bits are summed in byte-wide lanes


def _text_parts(data: bytes) -> Iterator[bytes]:
    """The text in parts of bounded size, cut where a word ends."""
    start = 0
    while len(data) - start > CHUNK_BYTES:
        stop = start + CHUNK_BYTES
        rest = data[stop:stop + CHUNK_BYTES]
        step = next((i for i, b in enumerate(rest) if b in b" \t\n\x0b\x0c\r"), len(rest))
        stop += step
        while stop < len(data) and data[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        yield data[start:stop]
        start = stop
    yield data[start:]


def shingle_hashes(data: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of all shingles (``shingle`` words) of a text, in arrays of bounded size. ``bytes.lower`` and ``bytes.split`` know ASCII only."""
    before: list[bytes] = []
    seen = 0
    for part in _text_parts(data):
        fresh = part.lower().split()
        words = before + fresh
        seen += len(fresh)
        if len(words) >= shingle:
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            stops = np.cumsum(sizes + 1) - 1
            starts = stops - sizes
            hashed = xxhash.xxh64_intdigest
            yield np.array(
                [hashed(joined[a:b], 42) for a, b in zip(starts[: len(words) + 1 - shingle].tolist(), stops[shingle - 1:].tolist(), strict=True)],
                dtype=np.uint64,
            )
        before = words[max(0, len(words) + 1 - shingle):]
    if 0 < seen < shingle:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(before), 42)], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    at = np.arange(0, len(hashes), _PIECE)
    return np.concatenate([
        np.add.reduceat(_LANES[octets[:, j]], at).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64) for j in range(8)
    ])


def fingerprint(data: bytes | None) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half of the shingle hashes; 0 without words."""
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(data or b""):
        counts += bit_counts(hashes)
        n += len(hashes)
    return majority(counts, n)


def majority(counts: np.ndarray, n: int) -> int:
    """The 64 bits that over half of ``n`` hashes have set, as a signed number."""
    bits = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text as a long in column ``out``, which must be new."""
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def fingerprinted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            found = pa.array([fingerprint(x.as_py()) for x in texts], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out])

    return docs.mapInArrow(fingerprinted, schema)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ------------------------------------------------------------------------------------------------ anchors


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Remainder of each value, read as a polynomial of degree 22, by the generator polynomial."""
    rest = values.astype(np.int64)
    for bit in range(LENGTH - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (POLYNOMIAL << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=4)
def _patterns(threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For excess 0..threshold: the error patterns grouped by syndrome, as (flat patterns, offsets of each syndrome)."""
    out = []
    for excess in range(threshold + 1):
        weights = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
        flat = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(LENGTH), w)], dtype=np.int64)
        syndrome = _syndromes(flat)
        order = np.argsort(syndrome, kind="stable")
        out.append((flat[order], np.searchsorted(syndrome[order], np.arange(2049))))
    return out


def _spread(which: np.ndarray, values: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codewords reached from ``values`` by one excess class: (repeated ``which``, codewords)."""
    flat, offsets = table
    syndrome = _syndromes(values)
    first, n = offsets[syndrome], offsets[syndrome + 1] - offsets[syndrome]
    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(which, n), np.repeat(values, n) ^ flat[at]


def anchors_of(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every anchor within covering radius plus threshold of each fingerprint: (position, anchor, is home)."""
    tables, mask = _patterns(threshold), (1 << LENGTH) - 1
    bits = fps.view(np.uint64)
    parts = [(bits >> np.uint64(b)).astype(np.int64) & mask for b in BLOCKS]
    places, anchors, homes = [], [], []
    for first in range(threshold + 1):
        at, low = _spread(np.arange(len(fps)), parts[0], tables[first])
        for second in range(threshold + 1 - first):
            nested, high = _spread(np.arange(len(at)), parts[1][at], tables[second])
            places.append(at[nested])
            anchors.append(high << LENGTH | low[nested])
            homes.append(np.full(len(nested), first + second == 0))
    return np.concatenate(places), np.concatenate(anchors), np.concatenate(homes)


# ------------------------------------------------------------------------------------------------ links


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: (node, smallest node of its tree) without the roots."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    u, v = ends[: len(left)], ends[len(left):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def _group_links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, old: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of rows sorted by (key, homes first): each new row meets the homes of its key; in chunks of pairs."""
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(fp)]))
    n_homes = np.add.reduceat(home.astype(np.int64), starts)
    rows = np.flatnonzero(~old & (n_homes[group] > 0))
    n = n_homes[group[rows]]
    upto = np.cumsum(n)
    begin = 0
    while begin < len(rows):
        stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + CHUNK_PAIRS, side="right")))
        some, k = rows[begin:stop], n[begin:stop]
        at = np.repeat(starts[group[some]] - np.cumsum(k) + k, k) + np.arange(k.sum())
        left, right = np.repeat(fp[some], k), fp[at]
        near = (np.bitwise_count((left ^ right).view(np.uint64)) <= threshold) & (left != right)
        yield left[near], right[near]
        begin = stop


def links(fps: DataFrame, threshold: int = THRESHOLD, at_home: int = 4096) -> DataFrame:
    """Links (u, v), u > v, whose components are those of all pairs of ``fps`` at ``threshold`` or fewer differing bits.

    ``fps`` has one column ``fp`` of distinct longs. Anchors with more than ``at_home`` (or 1/10,000 of all) fingerprints at
    home are dealt into pieces; there are at most 10,000 of them, and only their numbers reach the driver.
    """
    homes = fps.mapInArrow(_home_anchors, "anchor long")
    counts = homes.groupBy("anchor").count()
    limit = max(at_home, fps.count() // 10_000)
    hot = {r["anchor"]: -(-r["count"] // limit) for r in counts.where(F.col("count") > limit).collect()}
    busy = np.array(sorted(hot), dtype=np.int64)
    pieces = np.array([hot[a] for a in busy.tolist()], dtype=np.int64)

    def replicated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy()
            for i in range(0, len(all_fps), 1 << 13):
                fp = all_fps[i:i + (1 << 13)]
                place, anchor, home = anchors_of(fp, threshold)
                value, salt = fp[place], np.zeros(len(place), dtype=np.int64)
                if len(busy):
                    slot = np.minimum(np.searchsorted(busy, anchor), len(busy) - 1)
                    n = np.where(busy[slot] == anchor, pieces[slot], 1)
                    own = (value.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                    at = np.repeat(np.arange(len(n)), n)
                    salt = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    home = home[at] & (salt == own[at])
                    anchor, value = anchor[at], value[at]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(salt), pa.array(~home), pa.array(value)], names=["anchor", "salt", "guest", "fp"])

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            home = ~batch.column(2).to_numpy(zero_copy_only=False)
            fp = batch.column(3).to_numpy()
            old = np.zeros(len(fp), dtype=bool)
            if len(kept) and (fresh[0] == key).all():  # the batch goes on with an anchor: its homes so far come first
                fresh = np.concatenate([np.tile(key, (len(kept), 1)), fresh])
                home, fp = np.r_[np.ones(len(kept), dtype=bool), home], np.r_[kept, fp]
                old = np.r_[np.ones(len(kept), dtype=bool), old]
            for left, right in _group_links(fresh, fp, home, old, threshold):
                if len(left):
                    u, v = _forest(left, right)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            key = fresh[-1]
            kept = fp[home & (fresh == key).all(axis=1)]

    dealt = fps.mapInArrow(replicated, "anchor long, salt long, guest boolean, fp long")
    sorted_rows = dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "guest")
    return sorted_rows.mapInArrow(compared, "u long, v long")


def _home_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(anchors_of(batch.column(0).to_numpy(), 0)[1])], names=["anchor"])


# ------------------------------------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every end of the links (u, v): the same root exactly for connected ends.

    Each round hooks every node to its smallest neighbour, shortens the paths so made, and goes on with the links between
    different roots. Roots only decrease, so it ends; a path of n nodes takes about log8(n) rounds.
    """
    live = cut_lineage(edges.distinct())
    found: DataFrame | None = None
    while not live.isEmpty():
        ends = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = ends.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("up"))
        for _ in range(3):
            above = up.select(F.col("u").alias("up"), F.col("up").alias("top"))
            up = cut_lineage(up.join(above, "up").select("u", F.col("top").alias("up")))
        left = live.join(up, "u").select(F.col("up").alias("a"), F.col("v").alias("u"))
        both = left.join(up, "u").select(F.greatest("a", "up").alias("u"), F.least("a", "up").alias("v"))
        live = cut_lineage(both.where("u != v").distinct())
        if found is None:
            found = up.select(F.col("u").alias("fp"), F.col("up").alias("root"))
        else:
            step = up.select(F.col("u").alias("root"), F.col("up").alias("next"))
            found = cut_lineage(found.join(step, "root", "left").select("fp", F.coalesce("next", "root").alias("root")))
    return found if found is not None else live.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def classes(printed: DataFrame, fp: str = "fingerprint", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """(fp, root, first) of every distinct fingerprint: its component, and the component's smallest key."""
    firsts = printed.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("first"))
    roots = components(links(firsts.select("fp"), threshold))
    rooted = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "root", "first")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: ``key``, fingerprint (long), component_id (smallest key of its component)."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    printed = cut_lineage(with_fingerprint(narrow, "text", "fp").select("key", "fp"))
    found = classes(printed, "fp", "key", threshold)
    return printed.join(found, "fp").select(F.col("key").alias(key), F.col("fp").alias("fingerprint"), F.col("first").alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest key stays.

    Rows with that key but other content are told apart by a hash of all columns; whole rows that repeat stay once.
    """
    mark = F.xxhash64(*docs.columns)
    narrow = docs.select(F.col(key).alias("key"), mark.alias("mark"), F.col(text).alias("text"))
    printed = cut_lineage(with_fingerprint(narrow, "text", "fp").select("key", "mark", "fp"))
    rows = printed.groupBy("fp", "key", "mark").agg(F.count("*").alias("n"))
    rooted = rows.join(classes(printed, "fp", "key", threshold).select("fp", "root"), "fp")
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark", "n")).alias("best"))
    chosen = cut_lineage(best.select(F.col("best.key").alias("__key"), F.col("best.mark").alias("__mark"), F.col("best.n").alias("__n")))
    own = docs.withColumn("__own", mark)
    kept = own.join(chosen, (F.col("__own") == F.col("__mark")) & F.col(key).eqNullSafe(F.col("__key")))
    once = kept.where("__n = 1").select(*docs.columns)
    return once.unionByName(kept.where("__n > 1").dropDuplicates(["__own", "__key"]).select(*docs.columns))
