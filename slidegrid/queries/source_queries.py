"""Writers and readers: a table is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidegrid.queries.registry import SLIDES_CTE, query, slides
from slidegrid.session import scratch_folder, table
from slidegrid.sources import ranges, readers, sinks


@query("csv_round_trip", "SNK1 SRC5", """SELECT item_id, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars, '["' || item_id || '","x"]' AS tags FROM benchmark
UNION ALL SELECT 1000000 + doc_id, md5(trim(text)), CAST(length(trim(text)) AS INTEGER), '["' || doc_id || '","x"]' FROM documents WHERE length(trim(text)) > 0""")
def csv_round_trip(spark, d):
    """Texts with quotes, commas and line breaks, and a nested column."""
    path = scratch_folder(spark)
    texts = table(spark, d, "benchmark").select("item_id", "text", F.col("item_id").cast("string").alias("k")).unionByName(
        table(spark, d, "documents").select((F.col("doc_id") + 1_000_000).alias("item_id"), F.trim("text").alias("text"), F.col("doc_id").cast("string").alias("k"))
        .where(F.length("text") > 0)
    )
    sinks.write_csv(texts.select("item_id", "text", F.array("k", F.lit("x")).alias("tags")), path)
    back = readers.read_table(spark, path, "item_id LONG, text STRING, tags STRING")
    return back.select("item_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), "tags")


@query("json_round_trip", "SNK2", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def json_round_trip(spark, d):
    path = scratch_folder(spark)
    sinks.write_json(table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), "role", "text"), path)
    back = spark.read.schema("key STRUCT<conv_id: LONG, turn: LONG>, role STRING, text STRING").json(path)
    return back.select("key.conv_id", "key.turn", "role", F.md5("text").alias("text_md5"))


@query("status_lists", "SNK3", "SELECT o_orderstatus AS status, 'slide_' || o_orderkey AS slide FROM orders")
def status_lists(spark, d):
    path = scratch_folder(spark)
    named = table(spark, d, "orders").select(F.concat(F.lit("slide_"), F.col("o_orderkey").cast("string")).alias("slide"), F.col("o_orderstatus").alias("status"))
    sinks.write_status_lists(named, path)
    return spark.read.schema("value STRING, status STRING").text(path).select("status", F.col("value").alias("slide"))


@query("tile_store", "SNK5", "SELECT event_type AS slide, event_id AS tile_idx, event_id % 64 AS x, event_id // 64 AS y FROM events WHERE event_type IN ('click', 'view')")
def tile_store(spark, d):
    """Written partitioned by slide; reading two slides prunes the other folders."""
    path = scratch_folder(spark)
    k = F.col("event_id")
    sinks.write_tiles(
        table(spark, d, "events").select(F.col("event_type").alias("slide"), k.alias("tile_idx"), (k % 64).alias("x"), F.floor(k / 64).alias("y")), path, files_per_slide=4
    )
    stored = spark.read.schema("tile_idx LONG, x LONG, y LONG, slide STRING").parquet(path)
    return stored.where(F.col("slide").isin("click", "view")).select("slide", "tile_idx", "x", "y")


@query("concatenated_objects", "SRC8", "SELECT CAST(o_custkey AS VARCHAR) AS file_id, arg_min(o_orderstatus, o_orderkey) AS state, min(o_orderkey) AS file_size FROM orders GROUP BY 1")
def concatenated_objects(spark, d):
    """One object per order, identified by its customer: the first object of a customer counts."""
    path = scratch_folder(spark)
    o = table(spark, d, "orders").select(
        F.struct(F.col("o_custkey").cast("string").alias("file_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderkey").alias("file_size")).alias("data"), "o_custkey", "o_orderkey"
    )
    text = F.concat(F.lit('{\n  "data": '), F.to_json("data"), F.lit("\n}"))
    # All objects of a customer go to one file, in order.
    o.repartition("o_custkey").sortWithinPartitions("o_orderkey").select(text.alias("value")).write.text(path)
    return readers.read_concatenated_json(spark, path, "data STRUCT<file_id: STRING, state: STRING, file_size: LONG>", "file_id").select("file_id", "state", "file_size")


@query("slide_index", "SRC7", f"""WITH {SLIDES_CTE} SELECT slide AS file_name, 'u' || c_custkey AS file_id, CASE WHEN upper(slide) LIKE 'TCGA-%' THEN substr(slide, 1, 12) END AS patient,
 CASE WHEN upper(slide) LIKE 'TCGA-%' THEN substr(slide, 1, 12) || '-01' END AS sample FROM slides""")
def slide_index(spark, d):
    path = scratch_folder(spark)
    raw = slides(spark, d).select(
        F.col("slide").alias("File_Name"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("file_id"), F.substring("slide", 1, 12).alias("cases.0.submitter_id")
    )
    raw.write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_slide_index(spark, path)


#: Rows of one file of measures, by expectation.
ENTITY_ROWS = 10_000


def entity_parts(orders):
    """``orders`` with ``part``: each folder's rows are dealt by key into as many parts as its row count needs."""
    counts = orders.groupBy("folder").agg(F.ceil(F.count("*") / ENTITY_ROWS).alias("parts"))
    return orders.join(F.broadcast(counts), "folder").withColumn("part", F.pmod(F.xxhash64("o_orderkey"), "parts"))


def _entity_folders(spark, d, path, spoiled=None):
    """JSON arrays of measures in folders; the files of folders that ``spoiled`` names (a column over folder) are cut short."""
    rows = F.struct(
        F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("sampleId"), F.lit("x").alias("patientId"),
        F.col("o_custkey").cast("int").alias("entrezGeneId"), F.col("o_totalprice").alias("value"),
    )
    orders = table(spark, d, "orders").withColumn("folder", F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string")))
    made = entity_parts(orders).groupBy("folder", "part").agg(F.to_json(F.collect_list(rows)).alias("value"))
    if spoiled is not None:
        made = made.withColumn("value", F.when(spoiled, F.expr("substring(value, 1, length(value) - 9)")).otherwise(F.col("value")))

    def write(batches):
        """One file per folder and part, through the file system of the shared folder."""
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(readers.as_uri(path))
        for pdf in batches:
            for folder, part, value in zip(pdf["folder"], pdf["part"], pdf["value"]):
                system.create_dir(f"{base}/{folder}")
                with system.open_output_stream(f"{base}/{folder}/{folder}-{part}_expression.json") as out:
                    out.write(value.encode())
            yield pdf[["folder"]]

    made.mapInPandas(write, "folder string").write.format("noop").mode("overwrite").save()


@query("entity_files", "SRC1", """SELECT 's' || (o_custkey % 50) AS folder, 'p' || o_orderkey AS sampleId, CAST(o_custkey AS INTEGER) AS entrezGeneId, o_totalprice AS value FROM orders""")
def entity_files(spark, d):
    """JSON arrays of measures in folders, read back with the declared schema; no file holds much more than ``ENTITY_ROWS`` rows."""
    path = scratch_folder(spark)
    _entity_folders(spark, d, path)
    good, _ = readers.read_entity_json(spark, path, "expression", "FGFR3", folders="s*")
    return good.select("folder", "sampleId", "entrezGeneId", "value")


@query("quarantined_files", "SRC2", """SELECT 's' || (o_custkey % 50) AS folder, CASE WHEN o_custkey % 50 % 7 = 3 THEN 'quarantine' ELSE 'read' END AS state,
 CASE WHEN o_custkey % 50 % 7 <> 3 THEN count(*) END AS n, CASE WHEN o_custkey % 50 % 7 <> 3 THEN round(sum(o_totalprice), 2) END AS total FROM orders GROUP BY o_custkey % 50""")
def quarantined_files(spark, d):
    """Files of every seventh folder are cut short: their rows go to quarantine with the text, all others are read."""
    path = scratch_folder(spark)
    number = F.substring("folder", 2, 2).cast("int")
    _entity_folders(spark, d, path, number % 7 == 3)
    good, bad = readers.read_entity_json(spark, path, "expression", "FGFR3", folders="s*")
    none = F.lit(None)
    read = good.groupBy("folder").agg(F.lit("read").alias("state"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return read.unionByName(bad.where(F.length("text") > 0).select(
        readers.folder_of(F.col("path")).alias("folder"), F.lit("quarantine").alias("state"), none.cast("long").alias("n"), none.cast("double").alias("total")).distinct())


@query("broken_objects", "SRC8", """SELECT CAST(o_orderkey AS VARCHAR) AS file_id, CASE WHEN o_orderkey % 5 = 2 THEN 'broken' ELSE o_orderstatus END AS state FROM orders""")
def broken_objects(spark, d):
    """One object per order, every fifth of them cut short: the others are read, and the broken stretches kept."""
    path = scratch_folder(spark)
    key = F.col("o_orderkey").cast("string")
    whole = F.to_json(F.struct(F.struct(key.alias("file_id"), F.col("o_orderstatus").alias("state")).alias("data")))
    cut = F.concat(F.lit('{"data":{"file_id":"'), key, F.lit('",}}'))
    table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 == 2, cut).otherwise(whole).alias("value")).write.text(path)
    good = readers.read_concatenated_json(spark, path, "data STRUCT<file_id: STRING, state: STRING>", "file_id")
    bad = readers.concatenated_quarantine(spark, path).select(F.regexp_extract("text", '"file_id":"([0-9]+)"', 1).alias("file_id"), F.lit("broken").alias("state"))
    return good.select("file_id", "state").unionByName(bad)


@query("npy_features", "SRC10", """SELECT vec_id, CAST(label AS INTEGER) AS level, CAST(len(embedding) AS INTEGER) AS dims, CAST(embedding[1] AS DOUBLE) AS first_part,
 CAST(embedding[len(embedding)] AS DOUBLE) AS last_part FROM embeddings WHERE len(embedding) > 0""")
def npy_feature_files(spark, d):
    """Embeddings written as NumPy files, one for the vectors of a width in an Arrow batch; every third also has a twin that is cut short and must go to quarantine."""
    path, k = scratch_folder(spark), F.col("vec_id")
    rows = table(spark, d, "embeddings").where(F.size("embedding") > 0).select(
        F.concat(F.array(F.col("label").cast("float"), F.floor(k / 4096).cast("float"), F.pmod(k, F.lit(4096)).cast("float")), "embedding").alias("numbers")
    )

    def write(batches):
        import io

        import numpy as np
        from pyspark import TaskContext

        system, base = ranges.reachable(path)
        for b, pdf in enumerate(batches):
            for width, own in pdf["numbers"].groupby(pdf["numbers"].map(len)):
                held = io.BytesIO()
                np.save(held, np.array(own.tolist(), dtype=np.float32))
                name = f"p{TaskContext.get().partitionId()}-{b}-{width}"
                system.create_dir(f"{base}/whole")
                with system.open_output_stream(f"{base}/whole/{name}.npy") as out:
                    out.write(held.getvalue())
                if b % 3 == 0:
                    with system.open_output_stream(f"{base}/whole/{name}-cut.npy") as out:
                        out.write(held.getvalue()[:-1])
            yield pdf[[]].assign(done=True)

    rows.mapInPandas(write, "done boolean").write.format("noop").mode("overwrite").save()
    part = lambda at: F.element_at("emb", at).cast("double")
    return readers.read_npy_features(spark, path).select(
        (F.col("x").cast("long") * 4096 + F.col("y")).alias("vec_id"), "level", F.size("emb").alias("dims"), part(1).alias("first_part"), part(-1).alias("last_part")
    )


@query("token_files", "SRC6", "SELECT DISTINCT 'slide_' || o_orderkey || '.svs' AS token FROM orders")
def token_files(spark, d):
    path = scratch_folder(spark)
    table(spark, d, "orders").select(F.concat(F.lit("slide_"), F.col("o_orderkey").cast("string"), F.lit(".svs")).alias("value")).write.text(path)
    return readers.read_tokens(spark, path).select("token").distinct()


@query("manifest_round_trip", "SNK4", """SELECT 'f' || o_orderkey AS id, 'slide_' || o_orderkey || '.svs' AS filename, md5(CAST(o_orderkey AS VARCHAR)) AS md5, CAST(floor(o_totalprice) AS BIGINT) AS size, 'released' AS state FROM orders""")
def manifest_round_trip(spark, d):
    path, k = scratch_folder(spark), F.col("o_orderkey").cast("string")
    remote = table(spark, d, "orders").select(
        F.concat(F.lit("f"), k).alias("file_id"), F.concat(F.lit("slide_"), k, F.lit(".svs")).alias("file_name"), F.md5(k).alias("md5"),
        F.floor("o_totalprice").cast("long").alias("size"), F.lit(None).cast("string").alias("state"),
    )
    sinks.write_manifest(remote, path)
    return spark.read.option("header", True).option("sep", "\t").schema("id STRING, filename STRING, md5 STRING, size LONG, state STRING").csv(path)


@query("patch_store", "SNK6", """SELECT event_type AS slide, event_id AS patch_id, [CAST(event_id % 256 AS INTEGER), 1] AS raw, [CAST(event_id % 16 AS INTEGER), 2] AS normalized FROM events""")
def patch_store(spark, d):
    path, k = scratch_folder(spark), F.col("event_id")
    sinks.write_patches(table(spark, d, "events").select(
        F.col("event_type").alias("slide"), k.alias("patch_id"), F.array((k % 256).cast("int"), F.lit(1)).alias("raw"), F.array((k % 16).cast("int"), F.lit(2)).alias("normalized"),
    ), path)
    return spark.read.schema("patch_id LONG, raw ARRAY<INT>, normalized ARRAY<INT>, slide STRING").parquet(path).select("slide", "patch_id", "raw", "normalized")


@query("record_round_trip", "SNK7 SRC4", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(411 AS INTEGER) AS samples FROM orders")
def record_round_trip(spark, d):
    path = scratch_folder(spark)
    record = table(spark, d, "orders").agg(F.struct(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).alias("orders"))
    sinks.write_record(record, path)
    study = readers.read_study(spark, path).select("allSampleCount")
    back = spark.read.schema("orders STRUCT<n: LONG, total: DOUBLE>").json(path).select("orders.*")
    return back.withColumn("samples", study.scalar())


@query("file_listing", "SRC9", """SELECT 'g=' || (o_custkey // 10) AS folder, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS length,
 md5(string_agg(CAST(o_orderkey AS VARCHAR) || chr(10), '' ORDER BY o_orderkey)) AS md5 FROM orders GROUP BY o_custkey // 10""")
def file_listing(spark, d):
    """Orders written as one list per ten customers; the files are listed and hashed by tasks."""
    path = scratch_folder(spark)
    lines = table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 10).alias("g"), "o_orderkey")
    sinks.write_lists(lines, path, "g", "o_orderkey")
    found = readers.file_digests(spark, path, "part-*")
    return found.select(readers.folder_of(F.col("path")).alias("folder"), "length", "md5")


@query("table_files", "SRC9")
def table_files(spark, d):
    """Names and sizes of the given tables' files, listed by tasks without reading them."""
    return readers.file_inventory(spark, d, "*.parquet").select("name", "length")
