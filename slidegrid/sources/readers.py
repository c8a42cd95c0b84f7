"""Readers. Paths may be on any file system Spark knows; all schemas are declared."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slidegrid import schemas
from slidegrid.operators.ordered import read_positions
from slidegrid.operators.resolve import resolve_columns
from slidegrid.sources.ranges import json_values, npy_features, npy_files

# File name endings of the per-slide folders.
KINDS = {
    "variants": "*_{gene}_mutation.json",
    "all_variants": "*_mutations.json",
    "expression": "*_expression.json",
    "cna": "*_CNA.json",
    "patient_clinical": "*_patient_clinical.json",
    "sample_clinical": "*_sample_clinical.json",
    "summary": "*_summary.json",
}
KIND_SCHEMAS = {
    "variants": schemas.VARIANT,
    "all_variants": schemas.VARIANT,
    "expression": schemas.MEASURE,
    "cna": schemas.MEASURE,
    "patient_clinical": schemas.ATTRIBUTE,
    "sample_clinical": schemas.ATTRIBUTE,
    "summary": schemas.SUMMARY,
}
# List columns understood by the token reader, in order of preference.
TOKEN_COLUMNS = [
    "file_name", "filename", "file", "sample_id", "sampleid", "sample", "patient_id", "patientid", "submitter_id",
]


#: Files of a listing that a task hands on together.
LISTED = 10_000


def folder_of(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def as_uri(path: str) -> str:
    """The path with scheme and authority; a path without one is local."""
    return path if "://" in path else "file://" + path.removeprefix("file:")


def file_inventory(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, name, folder, length, modificationTime) of every file below ``root``; contents stay unread.

    Spark's own file sources leave out empty files, which matter here (an interrupted download), so the
    listing runs as tasks over the first-level folders.
    """
    import fnmatch

    from pyarrow import fs

    where = as_uri(root)
    system, base = fs.FileSystem.from_uri(where)
    top = system.get_file_info(fs.FileSelector(base, recursive=False))
    todo = [(i.path, i.type == fs.FileType.Directory) for i in top]

    def run(batches):
        import pandas as pd

        reach, _ = fs.FileSystem.from_uri(where)
        def frame(files):
            return pd.DataFrame(
                {
                    "path": pd.Series([f.path for f in files], dtype="object"),
                    "length": [f.size for f in files],
                    "modificationTime": pd.to_datetime([(f.mtime_ns or 0) // 1000 for f in files], unit="us", utc=True),
                }
            )

        files = []
        for pdf in batches:
            for path, is_dir in zip(pdf["path"], pdf["is_dir"]):
                found = reach.get_file_info(fs.FileSelector(path, recursive=True) if is_dir else [path])
                files += [f for f in found if f.type == fs.FileType.File and (glob is None or fnmatch.fnmatch(f.base_name, glob))]
                if len(files) >= LISTED:
                    yield frame(files)
                    files = []
        if files:
            yield frame(files)

    pieces = max(1, min(len(todo), 4 * spark.sparkContext.defaultParallelism))
    starts = spark.createDataFrame(todo, "path string, is_dir boolean").repartition(pieces)
    listed = starts.mapInPandas(run, "path string, length long, modificationTime timestamp")
    return listed.withColumns({"name": F.regexp_extract("path", r"([^/]+)$", 1), "folder": folder_of(F.col("path"))})


def file_digests(spark: SparkSession, root: str, glob: str | None = None, chunk: int = 8 << 20) -> DataFrame:
    """(path, length, md5) of every file below ``root``; tasks read files of any size in chunks."""
    import hashlib

    from pyarrow import fs

    where = as_uri(root)

    def run(batches):
        reach, _ = fs.FileSystem.from_uri(where)
        for pdf in batches:
            sums = []
            for path in pdf["path"]:
                digest = hashlib.md5(usedforsecurity=False)
                with reach.open_input_stream(path) as stream:
                    while part := stream.read(chunk):
                        digest.update(part)
                sums.append(digest.hexdigest())
            yield pdf.assign(md5=sums)

    files = file_inventory(spark, root, glob).select("path", "length")
    dealt = files.repartition(4 * spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInPandas(run, "path string, length long, md5 string")


def read_entity_json(spark: SparkSession, root: str, kind: str, gene: str, schema: str | None = None, folders: str = "TCGA*"):
    """(records, quarantine) of one kind of per-slide JSON file.

    A record carries ``folder`` and ``pos`` (its place in the file). Files may hold an array or one
    object. What cannot be parsed lands in ``quarantine`` with its path instead of failing the job. A
    file with an empty array gives no records; ``file_inventory`` still lists it.
    """
    schema = schema or KIND_SCHEMAS[kind]
    pattern = KINDS[kind].format(gene=gene)
    texts = spark.read.text(f"{root}/{folders}/{pattern}", wholetext=True).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("path")
    )
    body = F.trim("text")
    as_array = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    parsed = texts.withColumn("rows", F.from_json(as_array, f"array<struct<{_struct(schema)}>>", {"mode": "PERMISSIVE"}))
    bad = F.col("rows").isNull() | (
        (F.size("rows") > 0) & F.forall("rows", lambda r: F.to_json(r) == F.lit("{}")) & ~F.rlike(body, F.lit(r"^\[?\s*\{\s*\}"))
    )
    good = parsed.where(~bad).select(folder_of(F.col("path")).alias("folder"), F.posexplode("rows").alias("pos", "r"))
    return good.select("folder", "pos", "r.*"), parsed.where(bad).select("path", "text")


def _struct(ddl: str) -> str:
    """``a INT, b STRUCT<...>`` to the ``a: INT, b: STRUCT<...>`` spelling used inside a struct type."""
    out, depth = [], 0
    for part in ddl.split(","):
        if depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
        else:
            out[-1] += "," + part
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def read_study(spark: SparkSession, path: str) -> DataFrame:
    """Study description; the sample count falls back to 411 when absent."""
    return spark.read.schema(schemas.STUDY).option("multiLine", True).json(path).withColumn(
        "allSampleCount", F.coalesce("allSampleCount", F.lit(411))
    )


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Delimited file with a header, quoted fields and line breaks inside quotes."""
    return (
        spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True)
        .option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
    )


def read_text_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Delimited file with whatever header it has, every column as text (no type is guessed)."""
    return spark.read.option("header", True).option("inferSchema", False).option("sep", sep).csv(path)


def read_slide_index(spark: SparkSession, path: str, barcode_prefix: str = "TCGA-") -> DataFrame:
    """Slide list with flexible headers; a patient that is no barcode is blanked."""
    raw = read_text_table(spark, path)
    at = resolve_columns(
        raw.columns,
        {
            "file_name": ["file_name", "filename", "file"],
            "file_id": ["file_id", "id", "uuid"],
            "patient": ["submitter_id", "patient_id", "case_id"],
        },
    )
    pick = lambda out: F.trim(F.col(f"`{at[out]}`")) if at[out] else F.lit(None).cast("string")
    patient = F.when(F.upper(pick("patient")).startswith(barcode_prefix), pick("patient"))
    return raw.select(
        pick("file_name").alias("file_name"), F.coalesce(pick("file_id"), F.lit("")).alias("file_id"), patient.alias("patient"),
        F.concat(patient, F.lit("-01")).alias("sample"),
    ).where(F.nullif(F.col("file_name"), F.lit("")).isNotNull())


def split_tokens(text: Column) -> Column:
    """Words separated by blanks, commas or semicolons, without quotes at the ends of the line."""
    clean = F.regexp_replace(F.trim(text), r'^"+|"+$', "")
    return F.filter(F.split(clean, r"[\s,;]+"), lambda w: w != "")


def read_tokens(spark: SparkSession, path: str, is_folder: bool = False) -> DataFrame:
    """(pos, token) of a list in file order.

    ``is_folder`` lists the ``.svs`` files of a folder. Otherwise the first line decides: tabs or commas
    make it a table, read by a known column when the header has one; everything else is split into
    words.
    """
    if is_folder:
        names = file_inventory(spark, path).where(F.lower("name").endswith(".svs")).select(F.col("name").alias("token"))
        return read_positions(names.orderBy("token"))
    head = spark.read.text(path).limit(1).collect()
    first = head[0][0] if head else ""
    sep = "\t" if "\t" in first else "," if "," in first else None
    if sep:
        header = [h.strip() for h in first.split(sep)]
        known = resolve_columns(header, {"token": TOKEN_COLUMNS})["token"]
        if known is not None:
            rows = spark.read.option("header", True).option("sep", sep).csv(path)
            column = rows.columns[header.index(known)]
            tokens = rows.select(F.trim(F.col(f"`{column}`")).alias("token")).where(F.col("token") != "")
            return read_positions(tokens)
    words = spark.read.text(path).select(F.explode(split_tokens(F.col("value"))).alias("token"))
    return read_positions(words).select("pos", "token")


def split_objects(text: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(values, broken) of JSON values written one after another, on one line or many, each with its offset.

    After a broken value reading goes on at the next place where an object closes and another one opens; what lies between is broken.
    """
    import json

    decoder, found, broken, at = json.JSONDecoder(), [], [], 0
    while True:
        while at < len(text) and (text[at].isspace() or text[at] == "\ufeff"):
            at += 1
        if at == len(text):
            return found, broken
        try:
            _, stop = decoder.raw_decode(text, at)
            found.append((at, text[at:stop]))
        except ValueError:
            again = re.compile(r"\}\s*(?=\{)").search(text, at)
            stop = again.end() if again else len(text)
            broken.append((at, text[at:stop]))
        at = stop


def read_concatenated_json(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Objects written one after another without an enclosing array, one row per ``key``.

    Of several objects with one key the first counts, in the order of (path, place in the file). What cannot be read is left to
    ``concatenated_quarantine``; objects after it are read.
    """
    objects = json_values(spark, path).where("NOT broken").select(F.struct("path", "place").alias("pos"), "json")
    parsed = objects.select("pos", F.from_json("json", schema).alias("o")).select("pos", "o.*")
    flat = parsed.select("pos", "data.*") if "data" in parsed.columns else parsed
    rest = [c for c in flat.columns if c != key]
    return flat.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), "pos").alias("r")).select(key, "r.*").drop("pos")


def concatenated_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, text): the stretches of such files that are no JSON, with their offset in bytes."""
    return json_values(spark, path).where("broken").select("path", "place", F.col("json").alias("text"))


def read_npy_features(spark: SparkSession, root: str, glob: str = "*.npy") -> DataFrame:
    """(slide, tile_idx, level, x, y, emb) from NumPy files of number rows [level, x, y, embedding...], in any byte order and layout.

    The slide is the folder's name when the file is called ``features.npy``, else the file's own. Files without a proper header
    or shorter than it says are left to ``npy_quarantine``.
    """
    return npy_features(spark, root, glob)


def npy_quarantine(spark: SparkSession, root: str, glob: str = "*.npy") -> DataFrame:
    """(path, reason) of the NumPy files that cannot be read; empty files are not listed."""
    return npy_files(spark, root, glob).where("wrong IS NOT NULL").select("path", F.col("wrong").alias("reason"))


def model_keys(df: DataFrame, path: str) -> DataFrame:
    """(repeat, fold) out of checkpoint paths ``split_<repeat>/model_<fold>_...``; flat paths are repeat 0."""
    repeat = F.nullif(F.regexp_extract(path, r"split_([0-9]+)/", 1), F.lit("")).cast("int")
    fold = F.nullif(F.regexp_extract(path, r"model_([0-9]+)", 1), F.lit("")).cast("int")
    return df.withColumns({"repeat": F.coalesce(repeat, F.lit(0)), "fold": fold})
