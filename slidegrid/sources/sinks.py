"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slidegrid.sources.ranges import reachable

NESTED = ("array", "struct", "map")
SMALL_ROWS = 100_000


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that only hold plain values."""
    return df.select(*[F.to_json(c).alias(c) if kind.startswith(NESTED) else F.col(c) for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    flat(df).write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, order: list[str], mode: str = "overwrite") -> None:
    """A single JSON array, only for reports of at most ``SMALL_ROWS`` rows; larger frames are refused."""
    n = df.limit(SMALL_ROWS + 1).count()
    if n > SMALL_ROWS:
        raise ValueError("too many rows for one JSON array; write JSON lines instead")
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("__r"))))
    df.agg(F.to_json(F.transform(rows, lambda r: r["__r"])).alias("value")).write.mode(mode).text(path)


def write_status_lists(df: DataFrame, path: str, name: str = "slide", status: str = "status", mode: str = "overwrite") -> None:
    """One folder of plain lines per status, sorted within each file."""
    lines = df.select(F.col(status), F.col(name).cast("string").alias("value"))
    lines.repartitionByRange(status, "value").sortWithinPartitions("value").write.mode(mode).partitionBy(status).text(path)


def write_lists(df: DataFrame, path: str, folder: str, value: str) -> None:
    """One file of lines per folder value (``folder=value/part-0``), in order of ``value``.

    For many small lists: tasks write each file through the file system of the shared folder, without the steps that Spark's committer
    takes per file. Lines are written as they come, so a list may have any length; a repeated task writes the same files again.
    """

    def write(batches):
        system, base = reachable(path)
        out, now = None, None
        for batch in batches:
            names, lines = (c.to_pylist() for c in batch.columns)
            ends = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
            for begin, stop in zip([0, *ends], [*ends, len(names)]):
                if begin == stop:
                    continue
                if out is None or names[begin] != now:
                    if out is not None:
                        out.close()
                    now = names[begin]
                    system.create_dir(f"{base}/{folder}={now}")
                    out = system.open_output_stream(f"{base}/{folder}={now}/part-0")
                out.write("".join(f"{line or ''}\n" for line in lines[begin:stop]).encode())
            yield batch.slice(0, 0)
        if out is not None:
            out.close()

    name = F.coalesce(F.col(folder).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("name")
    dealt = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, folder).sortWithinPartitions(folder, value)
    dealt.select(name, F.col(value).cast("string").alias("line")).mapInArrow(write, "name string, line string").write.format("noop").mode("overwrite").save()


def download_manifest(remote: DataFrame) -> DataFrame:
    """Columns id, filename, md5, size, state."""
    return remote.select(
        F.col("file_id").alias("id"), F.col("file_name").alias("filename"), F.coalesce("md5", F.lit("")).alias("md5"),
        F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("state", F.lit("released")).alias("state"),
    )


def write_manifest(remote: DataFrame, path: str, mode: str = "overwrite") -> None:
    download_manifest(remote).write.mode(mode).option("header", True).option("sep", "\t").csv(path)


def write_tiles(tiles: DataFrame, path: str, mode: str = "overwrite", files_per_slide: int = 1) -> None:
    """Parquet partitioned by slide, so that reading one slide touches one folder.

    Rows are dealt by slide and a block of tiles, which keeps a huge slide from being written by one task.
    """
    piece = F.pmod(F.xxhash64("tile_idx"), F.lit(files_per_slide))
    tiles.repartition("slide", piece).sortWithinPartitions("slide", "tile_idx").write.mode(mode).partitionBy("slide").parquet(path)


def write_patches(patches: DataFrame, path: str, mode: str = "overwrite", files_per_slide: int = 8) -> None:
    """Raw and normalised pixels of a patch side by side under one id, a few files per slide."""
    need = {"slide", "patch_id", "raw", "normalized"}
    if not need <= set(patches.columns):
        raise ValueError(f"missing columns {sorted(need - set(patches.columns))}")
    piece = F.pmod(F.xxhash64("patch_id"), F.lit(files_per_slide))
    patches.repartition("slide", piece).write.mode(mode).partitionBy("slide").parquet(path)


def write_record(record: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row nested frame as one JSON object."""
    record.select(F.to_json(F.struct(*record.columns)).alias("value")).coalesce(1).write.mode(mode).text(path)


def slide_summary(wide: DataFrame) -> DataFrame:
    """Per-slide nested summary record next to its flat cohort columns."""
    return wide.select(
        "slide", "patient", "sample", "status",
        F.struct(
            F.struct("status", "status_any", "hotspot", "n_variants").alias("genotype"),
            F.struct("expression", "cna").alias("molecular"),
        ).alias("summary"),
    )
