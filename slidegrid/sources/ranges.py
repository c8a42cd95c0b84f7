"""Files of any size, read by many tasks: each takes a byte range, and no task holds a file.

Spark lists the files; ranges are rows, dealt over tasks like any others, so the driver holds none of them. A retried task reads
the same range again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from slidegrid import schemas
from slidegrid.session import cut_lineage

#: Bytes of a range, and bytes first read at a place within it.
PIECE, LOOK = 32 << 20, 1 << 16

BLANK = re.compile(r"(?:[ \t\r\n]|\xef\xbb\xbf)*")
AGAIN = re.compile(r"\}[ \t\r\n]*(?=\{)")
CLOSED = re.compile(r"\}[ \t\r\n]*\Z")
#: An error this near to the end of what was read may come from the cut alone.
MARGIN = 16

Reader = Callable[[int, int], bytes]


def reachable(path: str):
    """The file system of a path as Spark writes it, and the path on it."""
    from urllib.parse import quote

    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(quote(path, safe="/:@"))


def file_ranges(spark: SparkSession, path: str, piece: int = PIECE, glob: str | None = None) -> DataFrame:
    """(path, length, k, begin, end): the byte ranges of the files at ``path`` that are not empty; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = (files.option("pathGlobFilter", glob) if glob else files).load(path).select("path", "length").where("length > 0")
    cut = listed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / piece))))
    return cut.withColumns({"begin": F.col("k") * piece, "end": F.least((F.col("k") + 1) * piece, F.col("length"))})


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def _pieces(path: str) -> Reader:
    system, name = reachable(path)
    file = system.open_input_file(name)
    return lambda at, n: file.read_at(n, at)


def _next_opening(read: Reader, size: int, at: int, look: int) -> int:
    """Where, after ``at``, an object opens behind one that closes; ``size`` if nowhere."""
    while True:
        text = read(at, look).decode("latin-1")
        found = AGAIN.search(text)
        if found:
            return at + found.end()
        if at + len(text) >= size:
            return size
        closed = CLOSED.search(text)
        if closed and closed.start() == 0:
            look *= 2
        else:
            at += closed.start() if closed else len(text)


def values_between(read: Reader, size: int, at: int, end: int, look: int = LOOK) -> Iterator[tuple[int, int, bool]]:
    """(begin, stop, broken) of the JSON values that begin from ``at`` and before ``end``, one after another; last (exit, exit, False).

    ``at`` must be a place where reading stands. The exit is where it stands next, at or after ``end``. After a broken value
    reading goes on where an object closes and another opens. Text is read as bytes: JSON's own signs are ASCII.
    """
    decode, base, text = json.JSONDecoder().raw_decode, at, ""
    while True:
        here = BLANK.match(text, at - base).end()
        at, ended = base + here, base + len(text) >= size
        if not ended and len(text) - here < 3:  # used up, or a mark of three bytes may be cut
            base, text = at, read(at, look).decode("latin-1")
            continue
        if at >= min(size, end):
            yield at, at, False
            return
        try:
            stop = decode(text, here)[1]
            sure, broken = stop < len(text), False
        except json.JSONDecodeError as error:
            sure, broken = error.pos < len(text) - MARGIN and not error.msg.startswith("Unterminated string"), True
        except RecursionError:
            sure, broken = True, True
        if not sure and not ended:
            base, text = at, read(at, max(look, 2 * (len(text) - here))).decode("latin-1")
            continue
        stop = _next_opening(read, size, at, look) if broken else base + stop
        yield at, stop, broken
        if stop > base + len(text):
            base, text = stop, ""
        at = stop


def _standing(read: Reader, size: int, begin: int) -> int:
    """A guess where reading stands at or after ``begin``: the next object that opens behind one that closes."""
    return 0 if begin == 0 else max(begin, _next_opening(read, size, max(0, begin - 64), LOOK))


def _entries(ranges: DataFrame, look: int) -> DataFrame:
    """(path, length, k, end, entry): where reading stands when it comes to each range of a file of several ranges.

    Every range is read from a guessed place first. A range whose guess is not where the ranges before it end is read again
    from there, until all agree: the fixed point is what one reader from the file's start would see, whatever the guesses.
    """

    def run(batches):
        for pdf in batches:
            entries, exits = [], []
            for path, size, begin, end, entry, enters, left in zip(*(pdf[c] for c in ("path", "length", "begin", "end", "entry", "enters", "exit")), strict=True):
                if entry != enters or enters < 0:
                    read = _pieces(path)
                    entry = enters if enters >= 0 else _standing(read, size, begin)
                    left = entry
                    if entry < end:
                        for left, _, _ in values_between(read, size, entry, end, look):
                            pass
                entries.append(entry)
                exits.append(left)
            yield pdf.assign(entry=entries, exit=exits)[["path", "length", "k", "begin", "end", "entry", "exit"]]

    shape = "path string, length long, k long, begin long, end long, entry long, exit long"
    guess = ranges.withColumns({"entry": F.lit(-1).cast("long"), "enters": F.lit(-1).cast("long"), "exit": F.lit(-1).cast("long")})
    known = cut_lineage(_dealt(guess, "path", "k").mapInPandas(run, shape))
    before = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        met = known.withColumn("enters", F.coalesce(F.max("exit").over(before), F.lit(0)))
        if met.where("enters <> entry").isEmpty():
            return known.select("path", "length", "k", "end", "entry")
        known = cut_lineage(_dealt(met, "path", "k").mapInPandas(run, shape))


def _whole_characters(text: bytes, n: int) -> int:
    """At most ``n``, and no cut inside a character unless characters are broken themselves."""
    cut = n
    while cut < len(text) and cut > max(1, n - 3) and text[cut] & 0xC0 == 0x80:
        cut -= 1
    return n if cut < len(text) and text[cut] & 0xC0 == 0x80 else cut


def json_values(spark: SparkSession, path: str, piece: int = PIECE, look: int = LOOK, part: int = 16 << 20) -> DataFrame:
    """(path, place, json, broken): every value of files of JSON written one after another, with its offset in bytes.

    Broken stretches are rows too, in parts of at most ``part`` bytes. The rows do not depend on ``piece``.
    """
    ranges = file_ranges(spark, path, piece)
    several = F.col("length") > piece
    alone = ranges.where(~several).select("path", "length", "k", "end", F.lit(0).cast("long").alias("entry"))
    starts = alone.unionByName(_entries(ranges.where(several), look).where("entry < end")) if not ranges.where(several).isEmpty() else alone

    def run(batches):
        import pandas as pd

        def rows(path, found):
            return pd.DataFrame({"path": path, "place": [r[0] for r in found], "json": [r[1] for r in found], "broken": [r[2] for r in found]})

        for pdf in batches:
            for name, size, end, entry in zip(pdf["path"], pdf["length"], pdf["end"], pdf["entry"], strict=True):
                read, found, held = _pieces(name), [], 0
                for begin, stop, broken in values_between(read, size, entry, end, look):
                    while begin < stop:
                        most = min(part, stop - begin) if broken else stop - begin
                        text = read(begin, most + 1)
                        n = _whole_characters(text, most)
                        found.append((begin, text[:n].decode("utf-8", "replace"), broken))
                        held, begin = held + n, begin + n
                        if held > 4 << 20 or len(found) == 4096:
                            yield rows(name, found)
                            found, held = [], 0
                if found:
                    yield rows(name, found)

    return _dealt(starts, "path", "k").mapInPandas(run, "path string, place long, json string, broken boolean")


def _npy_shape(path: str) -> tuple[int, int, str, bool, int, str | None]:
    """(rows, columns, dtype, by column, offset of the numbers, what is wrong) of a NumPy file."""
    from numpy.lib import format as npy

    system, name = reachable(path)
    try:
        with system.open_input_file(name) as file:
            version = npy.read_magic(file)
            shape, by_column, dtype = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(file)
            offset, size = file.tell(), file.size()
    except ValueError as error:
        return 0, 0, "", False, 0, f"no header: {error}"
    if len(shape) != 2 or shape[1] < 3 or dtype.kind not in "fiu":
        return 0, 0, "", False, 0, f"no table of numbers with level, x and y: {shape} {dtype}"
    if size < offset + shape[0] * shape[1] * dtype.itemsize:
        return 0, 0, "", False, 0, f"{size} bytes, fewer than its header says"
    return shape[0], shape[1], dtype.str, by_column, offset, None


def npy_files(spark: SparkSession, root: str, glob: str = "*.npy") -> DataFrame:
    """(path, rows, columns, dtype, by_column, offset, wrong) of every NumPy file, out of its header alone."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            told = pd.DataFrame([_npy_shape(p) for p in pdf["path"]], columns=["rows", "columns", "dtype", "by_column", "offset", "wrong"])
            yield pd.concat([pdf[["path"]].reset_index(drop=True), told], axis=1)

    files = file_ranges(spark, root, glob=glob).where("k = 0").select("path")
    return _dealt(files, "path").mapInPandas(run, "path string, rows long, columns long, dtype string, by_column boolean, offset long, wrong string")


def npy_features(spark: SparkSession, root: str, glob: str = "*.npy", piece: int = PIECE) -> DataFrame:
    """Tile features out of NumPy files; a task reads the rows of one range of a file. Files that ``npy_files`` finds wrong give none."""
    import numpy as np

    width = F.col("columns") * F.regexp_extract("dtype", r"(\d+)$", 1).cast("long")
    each = F.greatest(F.lit(1), F.floor(piece / width))
    whole = npy_files(spark, root, glob).where("wrong IS NULL AND rows > 0").withColumn("each", each)
    ranges = whole.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.col("each"))))

    def block(read, r, at, n):
        dtype = np.dtype(r.dtype)
        if not r.by_column:
            return np.frombuffer(read(r.offset + at * r.columns * dtype.itemsize, n * r.columns * dtype.itemsize), dtype).reshape(n, r.columns)
        return np.stack([np.frombuffer(read(r.offset + (c * r.rows + at) * dtype.itemsize, n * dtype.itemsize), dtype) for c in range(r.columns)], axis=1)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                read, parts = _pieces(r.path), r.path.rstrip("/").split("/")
                slide = parts[-2] if parts[-1] == "features.npy" else parts[-1].removesuffix(".npy")
                stop = min(r.first + r.each, r.rows)
                for at in range(r.first, stop, 4096):
                    cut = block(read, r, at, min(4096, stop - at))
                    yield pd.DataFrame({
                        "slide": slide, "tile_idx": np.arange(at, at + len(cut), dtype=np.int32), "level": cut[:, 0].astype(np.int32),
                        "x": cut[:, 1].astype(np.int32), "y": cut[:, 2].astype(np.int32), "emb": list(cut[:, 3:].astype(np.float32)),
                    })

    return _dealt(ranges, "path", "first").mapInPandas(run, schemas.EMBEDDINGS)
