"""Barcodes, status, stages, labels, token resolution, merges."""

import pytest
from pyspark.sql import functions as F

from slidegrid.functions import barcode, scalars, status as st
from slidegrid.operators import cohort, labels as lb, merge, resolve

UUID = "0A1B2C3D"


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_barcodes(spark):
    names = [f"TCGA-2F-A9KQ-01Z-00-DX1.{UUID}.svs", "TCGA-2F-A9KQ-11A-01-TSA.svs", "TCGA-ab-A9KQ-01Z-00.svs", "TCGA-2F-A9KQ", "slide_7.SVS"]
    assert column(spark, names, barcode.patient_id) == ["TCGA-2F-A9KQ", "TCGA-2F-A9KQ", None, None, None]
    assert column(spark, names, barcode.sample_id)[:2] == ["TCGA-2F-A9KQ-01", "TCGA-2F-A9KQ-11"]
    assert column(spark, names, barcode.patient_or_stem) == ["TCGA-2F-A9KQ", "TCGA-2F-A9KQ", "TCGA-ab-A9KQ", "TCGA-2F-A9KQ", "slide_7"]
    df = spark.createDataFrame([(n,) for n in names], "slide string")
    ok, bad = barcode.parse_barcode(df, "slide")
    assert {r["slide"]: r["sample"] for r in ok.collect()}["TCGA-2F-A9KQ"] == "TCGA-2F-A9KQ-01"
    assert [r["slide"] for r in bad.collect()] == ["slide_7.SVS"]


def test_status_and_stage(spark):
    assert column(spark, ["mut", " Wild type", "", None, "maybe"], st.status_label) == [1, 0, 0, 0, None]
    stages = ["STAGE IV", "Stage IIIA", "stage 2", None, "free text"]
    assert column(spark, stages, st.stage_group) == ["Stage IV", "Stage III", "Stage II", None, "Free Text"]
    assert column(spark, ["Stage IV"], lambda c: st.stage_group(c, compat=True)) == ["Stage I"]
    assert column(spark, ["STAGE iii", " x "], st.stage_label) == ["Stage iii", "x"]
    assert column(spark, ["S249C", "Q674*", "G372C"], st.canonical_hotspot) == ["S249C", "Q674*", "G370C/G372C"]


def test_scalars(spark):
    assert column(spark, [5.0, 1536.0, 3.5 * 1024**3], scalars.human_bytes, "double") == ["5B", "1.5KB", "3.5GB"]
    assert column(spark, ["7.0", " 2.5", "", "x"], scalars.num_text) == ["7", "2.5", None, None]
    assert column(spark, ["NA", "nan", " ok "], scalars.na_to_null) == [None, None, "ok"]
    assert column(spark, [224.5, 225.5], lambda c: scalars.footprint(1, 1.0, 1 / c), "double") == [224, 226]


VARIANTS = "s string, variants array<struct<proteinChange:string,tumorAltCount:int,tumorRefCount:int>>"


def test_variant_classes_agree_between_array_and_long_form(spark):
    rows = [
        ("act", [("S249C", 3, 1)]), ("non", [("Q674*", 5, 5)]), ("both", [("Q674*", 1, 1), ("Y373C", 0, 0)]), ("none", []), ("nofile", None),
    ]
    got = {r["s"]: r for r in st.classify_variants(spark.createDataFrame(rows, VARIANTS)).collect()}
    assert [got[k]["status"] for k in ("act", "non", "both", "none", "nofile")] == ["MUT", "WT", "MUT", "WT", None]
    assert [got[k]["status_any"] for k in ("act", "non", "none", "nofile")] == ["MUT_any", "MUT_any", "WT_any", None]
    assert got["act"]["vaf"] == 0.75 and got["both"]["vaf"] is None
    assert got["both"]["hotspot"] == "Y373C/Y375C" and got["non"]["hotspot"] == "Q674*"
    long = spark.createDataFrame(
        [(s, i, *v) for s, vs in rows for i, v in enumerate(vs or [])], "sample string, pos int, proteinChange string, tumorAltCount int, tumorRefCount int"
    )
    for r in cohort.classify_records(long, "sample").collect():
        assert (r["hotspot"], r["vaf"], r["n_activating"]) == (got[r["sample"]]["hotspot"], got[r["sample"]]["vaf"], got[r["sample"]]["n_activating"])


def test_assemble_keeps_unknown_apart_from_wild_type(spark, hot):
    slides = spark.createDataFrame([("a1", "a", "p"), ("a2", "a", "p"), ("b1", "b", "q"), ("c1", "c", "r")], "slide string, sample string, patient string")
    variants = spark.createDataFrame([("a", 0, "S249C", 1, 1)], "sample string, pos int, proteinChange string, tumorAltCount int, tumorRefCount int")
    known = spark.createDataFrame([("a",), ("b",)], "sample string")
    measure = spark.createDataFrame([("a", 1, 5.0), ("a", 0, 7.0)], "sample string, pos int, value double")
    load = spark.createDataFrame([("b", 12)], "sample string, total_mutation_count long")
    clinical = spark.createDataFrame([("p", "Stage I")], "patient string, stage string")
    got = {r["slide"]: r for r in cohort.assemble_slides(slides, known, variants, measure, measure, load, clinical).collect()}
    assert [got[s]["status"] for s in ("a1", "a2", "b1", "c1")] == ["MUT", "MUT", "WT", None]
    assert got["a1"]["expression"] == 7.0 and got["b1"]["total_mutation_count"] == 12 and got["a2"]["stage"] == "Stage I"


def test_label_tiers(spark, hot):
    slides = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s3", "b"), ("s4", "c")], "slide string, sample string")
    strict = spark.createDataFrame([("s1", 0)], "slide string, label int")
    coarse = spark.createDataFrame([("s1", 1), ("s3", 1)], "slide string, label int")
    sample = spark.createDataFrame([("a", 1)], "sample string, label int")
    ok, missing, over = lb.resolve_labels(
        slides, [lb.Source("strict", strict, "slide")], [lb.Source("coarse", coarse, "slide"), lb.Source("sample", sample, "sample")]
    )
    assert {r["slide"]: (r["label"], r["source"]) for r in ok.collect()} == {"s1": (0, "strict"), "s2": (1, "sample"), "s3": (1, "coarse")}
    assert [tuple(r) for r in over.collect()] == [("s1", 1, 0)]
    with pytest.raises(ValueError, match="s4"):
        lb.require_labels(missing)
    lb.require_labels(missing, skip_unlabeled=True)


def test_tokens(spark, hot):
    index = spark.createDataFrame(
        [("TCGA-AA-0001-01Z-00-DX1.u.svs", "TCGA-AA-0001", "TCGA-AA-0001-01"), ("TCGA-AA-0001-01Z-00-DX2.u.svs", "TCGA-AA-0001", "TCGA-AA-0001-01"), ("TCGA-BB-0002-01Z-00-DX1.u.svs", "TCGA-BB-0002", "TCGA-BB-0002-01")],
        "file_name string, patient string, sample string",
    )
    tokens = spark.createDataFrame(
        [(0, "tcga-bb-0002-01z"), (1, "TCGA-AA-0001"), (2, "TCGA-AA-0001-01Z-00-DX1.u"), (3, "nope"), (4, "TCGA-ZZ")], "pos int, token string"
    )
    found, missing = resolve.resolve_tokens(tokens, index)
    got = {r["file_name"][5:7] + r["file_name"][20:23]: (r["pos"], resolve.TIERS[r["tier"]]) for r in found.collect()}
    assert got == {"BBDX1": (0, "prefix"), "AADX1": (1, "patient"), "AADX2": (1, "patient")}
    assert sorted(r["token"] for r in missing.collect()) == ["TCGA-ZZ", "nope"]


def test_ranges_and_columns(spark):
    assert resolve.parse_range("3:7") == (3, 7) and resolve.parse_range("-5") == (1, 5) and resolve.parse_range("4") == (4, None)
    assert resolve.parse_range(None, start=2, count=3) == (2, 4)
    df = spark.range(10).withColumnRenamed("id", "pos")
    assert [r[0] for r in resolve.range_slice(df, "pos", "9:40").orderBy("pos").collect()] == [8, 9]
    assert [r[0] for r in resolve.range_slice(df, "pos", "4:2").collect()] == [3]
    found = resolve.resolve_columns(["cases.0.submitter_id", "File_Name"], {"p": ["submitter_id"], "f": ["file_name"], "z": ["size"]})
    assert found == {"p": "cases.0.submitter_id", "f": "File_Name", "z": None}


def test_merge_and_reconcile(spark):
    a = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "patient string, v int")
    b = spark.createDataFrame([("q", "x"), ("r", "y")], "patient string, w string")
    got = {r["patient"]: (r["in_a"], r["in_b"], r["a_v"], r["b_w"]) for r in merge.merge_tables({"a": a, "b": b}, "patient", {"a": ["v"], "b": ["w"]}).collect()}
    assert got == {"p": (True, False, 1, None), "q": (True, True, 3, "x"), "r": (False, True, None, "y")}
    remote = spark.createDataFrame([("1", "a.svs", "m", 10), ("2", "b.svs", "m", 10), ("3", "c.svs", "m", 10)], "file_id string, file_name string, md5 string, size long")
    local = spark.createDataFrame([("/d/1/a.svs", 4), ("/d/a.svs", 10), ("/d/2/b.svs", 4), ("/d/other/b.svs", 10), ("/d/other/c.svs", 10)], "path string, length long")
    assert {r["file_name"]: r["reason"] for r in merge.reconcile(remote, local, "/d").collect()} == {"a.svs": "present", "b.svs": "partial", "c.svs": "missing"}
    assert {r["reason"] for r in merge.reconcile(remote, local, "/d/", force=True).collect()} == {"forced"}
    unread = local.withColumn("md5", F.when(F.col("length") == 10, "m").cast("string"))
    assert merge.reconcile(remote, unread.where("path = '/d/a.svs'"), "/d", verify=True).where("file_id = '1'").first()["reason"] == "present"
    assert merge.reconcile(remote, unread.where("path = '/d/a.svs'").withColumn("md5", F.lit(None).cast("string")), "/d", verify=True).where("file_id = '1'").first()["reason"] == "not verifiable"


def test_reports_fill_zeros(spark):
    s = spark.createDataFrame([("a", "MUT", "STAGE IV"), ("b", "WT", "Stage IIIA"), ("c", "WT", None)], "sample string, status string, stage string")
    got = [(r["n"], r["n_mut"], r["pct_mut"]) for r in cohort.by_stage(s).orderBy("pos").collect()]
    assert got == [(0, 0, 0.0), (0, 0, 0.0), (1, 0, 0.0), (1, 1, 100.0)]
    assert cohort.cohort_counts(s.withColumnRenamed("sample", "patient"), None).first()["patient_share"] == pytest.approx(3 / 411)
    assert cohort.correlation(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first()["r"] is None


def test_grid_cells_are_made_by_many_tasks(spark):
    """A small table of slides in one partition is dealt before it becomes cells; the cells are those of the slides one by one."""
    from slidegrid.operators import grid

    slides = spark.createDataFrame([(i, 100 + 37 * i, 90 + 11 * i) for i in range(40)], "slide int, width int, height int").coalesce(1)
    for edges in (True, False):
        cells = grid.tile_grid(slides, 32, edges)
        assert cells.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
        up = lambda a: -(-a // 32) if edges else a // 32
        want = {(i, x, y) for i in range(40) for x in range(up(100 + 37 * i)) for y in range(up(90 + 11 * i))}
        assert {(r.slide, r.tx, r.ty) for r in cells.collect()} == want
    assert grid.overlap_grid(slides, 64, 16).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
