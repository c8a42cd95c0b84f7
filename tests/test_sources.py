"""Readers and writers on small files, and the incremental run."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidegrid import schemas
from slidegrid.operators import labels as lb
from slidegrid.sources import readers, sinks
from slidegrid.streaming.incremental import process_new_tiles

GENE = "FGFR3"


@pytest.fixture
def entity_root(tmp_path):
    def put(folder, name, text):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)

    record = {"sampleId": "TCGA-AA-0001-01", "proteinChange": "S249C", "tumorAltCount": 3, "tumorRefCount": 1, "gene": {"hugoGeneSymbol": GENE}}
    put("TCGA-AA-0001-01Z", f"cb_{GENE}_mutation.json", json.dumps([record, {**record, "proteinChange": "Q674*"}], indent=1))
    put("TCGA-BB-0002-01Z", f"cb_{GENE}_mutation.json", "[]")
    put("TCGA-CC-0003-01Z", f"cb_{GENE}_mutation.json", "{not json")
    put("TCGA-DD-0004-01Z", "cb_expression.json", json.dumps({"sampleId": "d", "value": 12.5}))
    put("other", f"cb_{GENE}_mutation.json", "[]")
    return tmp_path


def test_entity_json_with_quarantine_and_known_empty(spark, entity_root):
    good, bad = readers.read_entity_json(spark, str(entity_root), "variants", GENE)
    assert [(r["folder"], r["pos"], r["proteinChange"], r["gene"]["hugoGeneSymbol"]) for r in good.orderBy("pos").collect()] == [
        ("TCGA-AA-0001-01Z", 0, "S249C", GENE), ("TCGA-AA-0001-01Z", 1, "Q674*", GENE)
    ]
    assert ["TCGA-CC" in r["path"] for r in bad.collect()] == [True]
    expr, _ = readers.read_entity_json(spark, str(entity_root), "expression", GENE)
    assert [(r["folder"], r["value"]) for r in expr.collect()] == [("TCGA-DD-0004-01Z", 12.5)]
    files = readers.file_inventory(spark, str(entity_root), f"*_{GENE}_mutation.json").select("folder")
    parsed = good.select("folder", F.array("proteinChange").alias("variants")).unionByName(
        files.join(good, "folder", "left_anti").where("folder like 'TCGA-BB%'").select("folder", F.array().cast("array<string>").alias("variants"))
    )
    got = {r["folder"][:7]: r["label"] for r in lb.known_empty(files, parsed, "folder").collect()}
    assert got == {"TCGA-AA": 1, "TCGA-BB": 0, "TCGA-CC": None, "other": None}


def test_inventory_digests_and_study(spark, tmp_path):
    (tmp_path / "id1").mkdir()
    (tmp_path / "id1" / "a.svs").write_bytes(b"abc")
    (tmp_path / "b.svs.partial").write_bytes(b"")
    got = {r["name"]: (r["folder"], r["length"]) for r in readers.file_inventory(spark, str(tmp_path)).collect()}
    assert got["a.svs"] == ("id1", 3) and got["b.svs.partial"][1] == 0
    digests = {r["length"]: r["md5"] for r in readers.file_digests(spark, str(tmp_path)).collect()}
    assert digests[3] == "900150983cd24fb0d6963f7d28e17f72"
    assert digests[0] == "d41d8cd98f00b204e9800998ecf8427e"
    (tmp_path / "study.json").write_text('{"studyId": "x"}')
    assert readers.read_study(spark, str(tmp_path / "study.json")).first()["allSampleCount"] == 411


@pytest.mark.parametrize(
    "text,want",
    [
        ("a.svs b.svs\n\"c.svs; d\"\n", ["a.svs", "b.svs", "c.svs", "d"]),
        ("id\tcases.0.sample_id\n1\tS-1\n2\t\n3\tS-3\n", ["S-1", "S-3"]),
        ("x,y\nz,w\n", ["x", "y", "z", "w"]),
    ],
)
def test_token_lists(spark, tmp_path, text, want):
    (tmp_path / "list.txt").write_text(text)
    got = readers.read_tokens(spark, str(tmp_path / "list.txt")).orderBy("pos").collect()
    assert [r["token"] for r in got] == want


def test_token_folder_and_slide_index(spark, tmp_path):
    folder = tmp_path / "slides"
    folder.mkdir()
    for n in ("b.svs", "a.SVS", "c.txt"):
        (folder / n).write_text("")
    assert [r["token"] for r in readers.read_tokens(spark, str(folder), is_folder=True).orderBy("pos").collect()] == ["a.SVS", "b.svs"]
    (tmp_path / "index.tsv").write_text("file_id\tFile_Name\tcases.0.submitter_id\nu1\tx.svs\tTCGA-AA-0001\nu2\ty.svs\t1234\n\t\t\n")
    got = {r["file_name"]: (r["file_id"], r["patient"], r["sample"]) for r in readers.read_slide_index(spark, str(tmp_path / "index.tsv")).collect()}
    assert got == {"x.svs": ("u1", "TCGA-AA-0001", "TCGA-AA-0001-01"), "y.svs": ("u2", None, None)}


def test_concatenated_json(spark, tmp_path):
    one = {"data": {"file_id": "f1", "file_name": "n", "cases": [{"submitter_id": "c", "diagnoses": [{"age_at_diagnosis": 3}]}]}}
    two = {"data": {"file_id": "f2", "file_name": "m}{m"}}
    (tmp_path / "c.txt").write_text("\n".join(json.dumps(o, indent=2) for o in (one, two, one)))
    got = readers.read_concatenated_json(spark, str(tmp_path / "c.txt"), schemas.CASES, "file_id").orderBy("file_id").collect()
    assert [(r["file_id"], r["file_name"]) for r in got] == [("f1", "n"), ("f2", "m}{m")]
    assert got[0]["cases"][0]["diagnoses"][0]["age_at_diagnosis"] == 3


def test_npy_features(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    np.save(tmp_path / "s1" / "features.npy", np.arange(12, dtype=np.float32).reshape(2, 6))
    np.save(tmp_path / "s2.npy", np.ones((1, 5), np.float32))
    got = readers.read_npy_features(spark, str(tmp_path)).orderBy("slide", "tile_idx").collect()
    assert [(r["slide"], r["tile_idx"], r["level"], r["x"]) for r in got] == [("s1", 0, 0, 1), ("s1", 1, 6, 7), ("s2", 0, 1, 1)]
    assert got[1]["emb"] == [9.0, 10.0, 11.0]


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", "MUT", 'a "quoted"\nline', [1, 2]), ("s2", "WT", None, [])], "slide string, status string, note string, tiles array<int>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = readers.read_table(spark, str(tmp_path / "csv"), "slide string, status string, note string, tiles string").orderBy("slide").collect()
    assert back[0]["note"] == 'a "quoted"\nline' and json.loads(back[0]["tiles"]) == [1, 2]
    sinks.write_json_array(df, str(tmp_path / "arr"), ["slide"])
    assert [r["slide"] for r in json.loads(spark.read.text(str(tmp_path / "arr")).first()[0])] == ["s1", "s2"]
    sinks.write_json(df, str(tmp_path / "js"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "js")).count() == 2
    sinks.write_status_lists(df, str(tmp_path / "lists"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "lists" / "status=MUT")).collect()] == ["s1"]
    sinks.write_record(df.select(F.struct("slide", "tiles").alias("r")).limit(1), str(tmp_path / "rec"))
    assert json.loads(spark.read.text(str(tmp_path / "rec")).first()[0])["r"]["tiles"] == [1, 2]
    remote = spark.createDataFrame([("i", "n.svs", "m", 7, None)], schemas.REMOTE_FILE)
    sinks.write_manifest(remote, str(tmp_path / "man"))
    assert readers.read_text_table(spark, str(tmp_path / "man")).columns == ["id", "filename", "md5", "size", "state"]


def test_tiles_and_patches(spark, tmp_path):
    tiles = spark.createDataFrame([("a", i, i, 0) for i in range(6)] + [("b", 0, 0, 0)], schemas.TILES)
    sinks.write_tiles(tiles, str(tmp_path / "t"), files_per_slide=2)
    assert spark.read.parquet(str(tmp_path / "t")).where("slide = 'a'").count() == 6
    patches = tiles.select("slide", F.col("tile_idx").alias("patch_id"), F.lit(b"x").alias("raw"), F.lit(b"y").alias("normalized"))
    sinks.write_patches(patches, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 7
    with pytest.raises(ValueError, match="normalized"):
        sinks.write_patches(patches.drop("normalized"), str(tmp_path / "q"))


def test_incremental_run_takes_new_files_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    make = lambda lo: spark.createDataFrame([("a", i, i, 0) for i in range(lo, lo + 4)], schemas.TILES)
    step = lambda df: df.where("tile_idx % 2 = 0")
    make(0).write.parquet(src)
    process_new_tiles(spark, src, schemas.TILES, out, ck, step)
    make(4).write.mode("append").parquet(src)
    process_new_tiles(spark, src, schemas.TILES, out, ck, step)
    assert sorted(r["tile_idx"] for r in spark.read.parquet(out).collect()) == [0, 2, 4, 6]


def test_objects_on_one_line_and_in_two_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": "f1", "v": 1}{"k": "f2", "v": "}{"} {"k": "f1", "v": 3}')
    (tmp_path / "b.json").write_text('{"k": "f2", "v": 9}\n{"k": "f3",\n "v": 4}\n')
    got = readers.read_concatenated_json(spark, str(tmp_path), "k STRING, v STRING", "k")
    assert {r["k"]: r["v"] for r in got.collect()} == {"f1": "1", "f2": "}{", "f3": "4"}


def test_long_lines_keep_distinct_positions(spark, tmp_path):
    (tmp_path / "list.txt").write_text(" ".join(f"w{i}" for i in range(100_005)) + "\nlast one")
    got = [r["pos"] for r in readers.read_tokens(spark, str(tmp_path / "list.txt")).collect()]
    assert sorted(got) == list(range(100_007))


def test_checkpoints_need_a_shared_folder(spark):
    from types import SimpleNamespace

    from slidegrid import session

    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_entity_files_bound_rows_per_file(spark, tmp_path, monkeypatch):
    """A hot customer's rows are dealt into several files, and all come back."""
    from slidegrid.queries import source_queries

    monkeypatch.setattr(source_queries, "ENTITY_ROWS", 100)
    spark.range(2000).selectExpr("id AS o_orderkey", "IF(id % 3 = 0, 7L, id) AS o_custkey", "CAST(id AS DOUBLE) AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    folders = spark.read.parquet(f"{tmp_path}/orders.parquet").selectExpr("*", "concat('s', o_custkey % 50) AS folder")
    assert max(r["count"] for r in source_queries.entity_parts(folders).groupBy("folder", "part").count().collect()) < 200
    got = source_queries.entity_files(spark, str(tmp_path)).collect()
    assert sorted((r["folder"], r["sampleId"]) for r in got) == sorted((r["folder"], f"p{r['o_orderkey']}") for r in folders.collect())


def test_reading_goes_on_after_a_broken_object():
    found, broken = readers.split_objects('\ufeff{"a":1} {"b":{"c":2}}{"d":,}{"e":"}{"}\n[3] {"f"')
    assert [t for _, t in found] == ['{"a":1}', '{"b":{"c":2}}', '{"e":"}{"}', "[3]"] and [t for _, t in broken] == ['{"d":,}', '{"f"']
    assert all(isinstance(p, int) for p, _ in found + broken) and broken[0][0] == 22
    assert readers.split_objects(" ") == ([], []) and readers.split_objects("no")[1] == [(0, "no")]


def test_lists_are_written_whole_and_in_order(spark, tmp_path):
    """Lists that go on over several Arrow batches, a list without a name, and a line without a value."""
    from pyspark.sql import functions as F

    from slidegrid.sources import readers, sinks

    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.lit(3000) - F.col("id")).alias("v")).unionByName(spark.createDataFrame([(None, 5), (7, None)], "g long, v long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        sinks.write_lists(rows, str(tmp_path / "lists"), "g", "v")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {f"g={g}": "".join(f"{v}\n" for v in sorted(3000 - i for i in range(3000) if i % 3 == g)) for g in range(3)} | {"g=__HIVE_DEFAULT_PARTITION__": "5\n", "g=7": "\n"}
    assert {p.parent.name: p.read_text() for p in (tmp_path / "lists").glob("*/part-*")} == want
    listed = {r["folder"]: r["length"] for r in readers.file_inventory(spark, str(tmp_path / "lists"), "part-*").collect()}
    assert listed == {k: len(v) for k, v in want.items()}
