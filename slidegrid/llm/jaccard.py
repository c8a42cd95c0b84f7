"""Near copies by exact Jaccard similarity of word shingles.

Texts are compared as sets of their shingles of ``SHINGLE`` words (lower case, as in ``simhash``; a shorter text is one shingle).
Candidates come from two sides, and the shingles of both texts decide. Each distinct set has a fingerprint (the majority of its
shingle hashes); fingerprints that differ in few bits meet at the anchors of the covering code (``simhash.links``). Sets of
similarity 0.8 may lie farther apart than any anchor reaches, so each set also has ``BANDS`` keys, each made of ``ROWS`` of its
minimum hashes. Two sets of similarity s share no key with probability (1 - s^ROWS)^BANDS: 1.3e-7 at 0.8, less above.

Sets of one fingerprint are compared with the smallest of them, linked fingerprints by their smallest sets, and of the sets that
share a key every one with the smallest. What is connected by then needs no more comparing;
keys whose sets are still apart are dealt into blocks of bounded size, and every block meets every block of its key inside a task:
the shingles that both hold are counted for all their pairs at once, and what leaves the task is a spanning forest of the pairs that reach the
similarity. No pair is a row, and the components are those of all candidate pairs.

Texts without words are the empty set, equal to each other. Repeated rows are one set. Memory of a task is a few times two texts, or
two blocks of shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from slidegrid.llm import simhash
from slidegrid.llm.simhash import _forest, components, shingle_hashes
from slidegrid.operators.skew import spread_join
from slidegrid.session import cut_lineage, scratch_folder

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 5
#: Bytes of shingle hashes, and sets, of one block of a key; shingles that are counted at a time.
BLOCK_BYTES, BLOCK_SETS, _COLUMNS = 2 << 20, 512, 2048
#: Shingles hashed together, and rows of a batch whose results are held together.
_PART, BATCH = 512, 512


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=5)).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each of ``BANDS * ROWS`` hash functions over distinct shingle hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for begin in range(0, len(hashes), _PART):
        mixed = (hashes[None, begin:begin + _PART] ^ hashes[None, begin:begin + _PART] >> np.uint64(31)) * _multipliers()
        least = np.minimum(least, mixed.min(axis=1))
    return least


def sketch(data: bytes | None, shingle: int = SHINGLE) -> tuple[int, int | None, list[int]]:
    """A number for the text's set of shingles, its fingerprint and its band keys; neither of these without words."""
    parts = [np.unique(h) for h in shingle_hashes(data or b"", shingle)]
    hashes = np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)
    number = xxhash.xxh64_intdigest(hashes.tobytes(), 1)
    if not len(hashes):
        return number - (1 << 63), None, []
    printed = simhash.majority(simhash.bit_counts(hashes), len(hashes))
    bands = least_hashes(hashes).reshape(BANDS, ROWS)
    return number - (1 << 63), printed, [xxhash.xxh64_intdigest(bands[b].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def shingles(text: str, shingle: int = SHINGLE) -> set[bytes]:
    words = text.encode().lower().split()
    return {b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def similarity(left: set[bytes], right: set[bytes]) -> float:
    both = len(left & right)
    return both / (len(left) + len(right) - both) if left or right else 1.0


def with_sketch(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` without ``text``, with the number of the shingle set, its fingerprint and its band keys."""
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField("set", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH):
                batch = whole.slice(begin, BATCH)
                texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
                found = [sketch(x.as_py(), shingle) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(batch.schema.get_field_index(c)) for c in rest], *[pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))]],
                    names=schema.names,
                )

    return docs.mapInArrow(sketched, schema)


def verified(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """The ``pairs`` (u, v) of sets whose texts (set, text) have similarity ``least`` or more."""

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, text, own = [], None, set()
            for a, b in zip(batch.column(2), batch.column(3), strict=True):  # one pair of texts at a time
                a, b = a.as_py(), b.as_py()
                if b != text:
                    text, own = b, shingles(b, shingle)
                good.append(similarity(shingles(a, shingle), own) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good))

    left = spread_join(pairs, texts.select(F.col("set").alias("u"), F.col("text").alias("a")), ["u"])
    both = spread_join(left, texts.select(F.col("set").alias("v"), F.col("text").alias("b")), ["v"], salt_on=["u"])
    return both.select("u", "v", "a", "b").mapInArrow(near, "u long, v long")


def with_hashes(texts: DataFrame, shingle: int) -> DataFrame:
    """set, hashes (sorted distinct shingle hashes as bytes), size in bytes, of (set, text)."""
    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH):
                batch = whole.slice(begin, BATCH)
                found = [np.unique(np.concatenate(list(shingle_hashes(x.as_py() or b"", shingle)) or [np.zeros(0, dtype=np.uint64)])).tobytes() for x in batch.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["set", "hashes"])

    return texts.select("set", "text").mapInArrow(hashed, "set long, hashes binary").withColumn("size", F.octet_length("hashes"))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of ``left`` shares with each of ``right``: products of membership tables, some columns at a time."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), dtype=np.float32)  # counts of shared shingles are whole numbers far below 2^24
    places = [[np.searchsorted(both, h[np.isin(h, both, assume_unique=True)]) for h in side] for side in (left, right)]
    for begin in range(0, len(both), _COLUMNS):
        tables = []
        for side in places:
            table = np.zeros((len(side), min(_COLUMNS, len(both) - begin)), dtype=np.float32)
            for i, at in enumerate(side):
                at = at[np.searchsorted(at, begin):np.searchsorted(at, begin + _COLUMNS)]
                table[i, at - begin] = 1.0
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out.astype(np.int64)


def block_links(live: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """Links (u, v) between the roots of sets of similarity ``least`` or more that share a key (``live``: key, set, root)."""
    hashed = cut_lineage(with_hashes(texts.join(live.select("set").distinct(), "set", "left_semi"), shingle))
    rows = cut_lineage(live.join(hashed.select("set", "size"), "set"))
    blocks = rows.groupBy("key").agg(F.greatest(F.ceil(F.sum("size") / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    dealt = spread_join(rows.drop("size"), blocks, ["key"], salt_on=["set"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")

    def compared(table: pa.Table) -> pa.Table:
        roots, mine = (table.column(c).to_numpy() for c in ("root", "mine"))
        hashes = [np.frombuffer(h, dtype=np.uint64) for h in table.column("hashes").to_pylist()]
        first = mine == table.column("low")[0].as_py()
        second = mine == table.column("high")[0].as_py()
        if not first.any() or not second.any() or (roots == roots[0]).all():
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        a, b = np.flatnonzero(first), np.flatnonzero(second)
        sizes = np.array([len(h) for h in hashes], dtype=np.int64)
        shared = shared_counts([hashes[i] for i in a], [hashes[i] for i in b])
        near = shared >= least * (sizes[a][:, None] + sizes[b][None, :] - shared)
        i, j = np.nonzero(near & (roots[a][:, None] != roots[b][None, :]))
        u, v = _forest(np.maximum(roots[a[i]], roots[b[j]]), np.minimum(roots[a[i]], roots[b[j]])) if len(i) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    met = dealt.select("set", "key", low, high, "mine", "root").join(hashed.select("set", "hashes"), "set")
    return met.drop("set").groupBy("key", "low", "high").applyInArrow(compared, "u long, v long")


def anchored(sets: DataFrame) -> DataFrame:
    """Candidate pairs (u, v), u > v, of ``sets`` (set, fp): those of one fingerprint, and those whose fingerprints are linked at an anchor."""
    printed = cut_lineage(sets.where("fp IS NOT NULL").select("set", "fp"))
    heads = cut_lineage(printed.groupBy("fp").agg(F.min("set").alias("head")))
    alike = spread_join(printed, heads, ["fp"], salt_on=["set"]).where("set != head").select(F.col("set").alias("u"), F.col("head").alias("v"))
    near = simhash.links(heads.select("fp")).distinct()
    for end in "uv":
        near = near.join(heads.select(F.col("fp").alias(end), F.col("head").alias(f"set_{end}")), end)
    return alike.unionByName(near.select(F.greatest("set_u", "set_v").alias("u"), F.least("set_u", "set_v").alias("v")))


def links(sets: DataFrame, texts_of, least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Links (u, v) whose components are those of all candidate pairs of ``sets`` (set, fp, keys; distinct sets)."""
    found, _, more = first_links(sets, texts_of, least, shingle)
    return found if more is None else found.unionByName(more)


def first_links(sets: DataFrame, texts_of, least: float, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Verified links (u, v) of ``links``, their components (set, root), and the links between these that blocks add, if any key needs blocks.

    ``texts_of`` gives the texts (set, text) of a frame of sets; it is asked once, for the sets that meet at an anchor or share a key.
    """
    near = cut_lineage(anchored(sets))
    rows = sets.select("set", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    live = cut_lineage(rows.join(shared, "key").select("key", "set"))
    if live.isEmpty() and near.isEmpty():
        spark = live.sparkSession
        return spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], "set long, root long"), None
    texts = texts_of(live.select("set").unionByName(near.select(F.explode(F.array("u", "v")).alias("set"))).distinct())
    heads = live.groupBy("key").agg(F.min("set").alias("head"))
    met = spread_join(live, heads, ["key"], salt_on=["set"]).where("set != head").select(F.greatest("set", "head").alias("u"), F.least("set", "head").alias("v"))
    found = cut_lineage(verified(near.unionByName(met).distinct(), texts, least, shingle))
    roots = components(found).select(F.col("fp").alias("set"), "root")
    rooted = live.join(roots.withColumnRenamed("root", "__root"), "set", "left").select("key", "set", F.coalesce("__root", "set").alias("root"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    live = cut_lineage(rooted.join(apart, "key"))
    return found, roots, None if live.isEmpty() else cut_lineage(block_links(live, texts, least, shingle))


def with_root(sets: DataFrame, texts_of, least: float, shingle: int) -> DataFrame:
    """``sets`` with the root of each one's component; the components of the first links are found once, and what blocks add joins them."""
    _, roots, more = first_links(sets.select("set", "fp", "keys"), texts_of, least, shingle)
    rooted = sets.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    if more is None:
        return rooted
    tops = components(more).select(F.col("fp").alias("root"), F.col("root").alias("__top"))
    return rooted.join(tops, "root", "left").withColumn("root", F.coalesce("__top", "root")).drop("__top")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest key stays.

    Rows with that key but other content are told apart by a hash of all columns; whole rows that repeat stay once.
    """
    # Maps cannot be hashed; their text form can.
    mark = F.xxhash64(*[F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields])
    narrow = docs.select(F.col(key).alias("key"), mark.alias("mark"), F.col(text).alias("text"))
    printed = cut_lineage(with_sketch(narrow, "text", shingle))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("best")
    sets = cut_lineage(printed.groupBy("set").agg(first, F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    own = docs.withColumn("__own", mark)

    def texts_of(some: DataFrame) -> DataFrame:
        """One text of each of the sets, written once."""
        folder = f"{scratch_folder(docs.sparkSession)}/texts"
        carriers = sets.join(some, "set").select(F.col("set").alias("__set"), F.col("best.mark").alias("__mark"), F.col("best.key").alias("__key"))
        held = own.join(carriers, (F.col("__own") == F.col("__mark")) & F.col(key).eqNullSafe(F.col("__key")))
        held.select(F.col("__set").alias("set"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["set"]).write.parquet(folder)
        return docs.sparkSession.read.parquet(folder)

    rooted = with_root(sets, texts_of, least, shingle)
    chosen = cut_lineage(rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.key").alias("__key"), F.col("best.mark").alias("__mark")))
    counts = printed.groupBy("key", "mark").agg(F.count("*").alias("__n")).select(F.col("key").alias("__k"), F.col("mark").alias("__m"), "__n")
    told = cut_lineage(chosen.join(counts, F.col("__k").eqNullSafe(F.col("__key")) & (F.col("__m") == F.col("__mark"))).select("__key", "__mark", "__n"))
    kept = own.join(told, (F.col("__own") == F.col("__mark")) & F.col(key).eqNullSafe(F.col("__key")))
    names = [f"`{c}`" for c in docs.columns]
    once = kept.where("__n = 1").select(*names)
    return once.unionByName(kept.where("__n > 1").dropDuplicates(["__own", "__key"]).select(*names))
