"""Label resolution, name resolution, merges, reconciliation, list handling, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidegrid.operators import cohort, labels as lb, merge, resolve
from slidegrid.operators.ordered import first_per
from slidegrid.queries.registry import SLIDES_CTE, query, slides
from slidegrid.queries.scalar_queries import CLASSIFIED_CTE, ALIAS_SQL, variants
from slidegrid.sources import readers, sinks
from slidegrid.session import table

# ---- labels: slides are documents, a sample is a source; strict labels are ``toxic`` --------------

_LABEL_CTES = """s AS (SELECT doc_id AS slide, source AS sample, lang AS patient FROM documents),
strict0 AS (SELECT doc_id AS slide, toxic AS label FROM labels WHERE doc_id % 2 = 0),
coarse0 AS (SELECT doc_id AS slide, quality AS label FROM labels WHERE doc_id % 3 <> 0),
coarse1 AS (SELECT d.source AS sample, arg_min(l.quality, l.doc_id) AS label FROM labels l JOIN documents d USING (doc_id) WHERE l.doc_id % 5 = 0 GROUP BY 1),
w AS (SELECT s.slide, s.sample, strict0.label AS st, coalesce(coarse0.label, coarse1.label) AS co,
 CASE WHEN strict0.label IS NOT NULL THEN 'strict table' WHEN coarse0.label IS NOT NULL THEN 'summary' WHEN coarse1.label IS NOT NULL THEN 'sample-level fallback' END AS source
 FROM s LEFT JOIN strict0 USING (slide) LEFT JOIN coarse0 USING (slide) LEFT JOIN coarse1 ON s.sample = coarse1.sample)"""


def _resolved(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("slide"), F.col("source").alias("sample"), F.col("lang").alias("patient"))
    given = table(spark, d, "labels").withColumnRenamed("doc_id", "slide")
    strict = given.where("slide % 2 = 0").select("slide", F.col("toxic").alias("label"))
    coarse = given.where("slide % 3 <> 0").select("slide", F.col("quality").alias("label"))
    by_sample = given.where("slide % 5 = 0").join(docs, "slide").select("sample", "slide", F.col("quality").alias("label"))
    return lb.resolve_labels(
        docs,
        [lb.Source("strict table", strict, "slide")],
        [lb.Source("summary", coarse, "slide"), lb.Source("sample-level fallback", by_sample, "sample", order="slide")],
    )


@query("label_resolution", "JN1", f"""WITH {_LABEL_CTES}
SELECT slide, sample, CAST(coalesce(st, co) AS INTEGER) AS label, CASE WHEN coalesce(st, co) = 1 THEN 'MUTANT' ELSE 'WILD-TYPE' END AS status, source
FROM w WHERE coalesce(st, co) IS NOT NULL""")
def label_resolution(spark, d):
    return _resolved(spark, d)[0].select("slide", "sample", "label", "status", "source")


@query("label_overrides", "JN2", f"WITH {_LABEL_CTES} SELECT slide, CAST(co AS INTEGER) AS coarse_label, CAST(st AS INTEGER) AS strict_label FROM w WHERE st <> co")
def label_overrides(spark, d):
    return _resolved(spark, d)[2]


@query("label_unresolved", "JN3", f"WITH {_LABEL_CTES} SELECT slide, sample FROM w WHERE coalesce(st, co) IS NULL")
def label_unresolved(spark, d):
    return _resolved(spark, d)[1].select("slide", "sample")


@query("known_empty_files", "SRC3", """WITH i AS (SELECT o_orderkey AS slide FROM orders), v AS (SELECT l_orderkey AS slide, count(*) FILTER (l_quantity > 25) AS n FROM lineitem WHERE l_tax < 0.04 GROUP BY 1)
SELECT i.slide, CASE WHEN n > 0 THEN 1 WHEN n = 0 THEN 0 END AS label FROM i LEFT JOIN v ON i.slide = v.slide""")
def known_empty_files(spark, d):
    parsed = table(spark, d, "lineitem").where("l_tax < 0.04").select(
        F.col("l_orderkey").alias("slide"), F.filter(F.array("l_quantity"), lambda q: q > 25).alias("variants")
    )
    return lb.known_empty(table(spark, d, "orders").select(F.col("o_orderkey").alias("slide")), parsed, "slide")


@query("label_counts", "AG14", """SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS n_pos, count(*) FILTER (toxic = 0) AS n_neg,
 CASE WHEN least(count(*) FILTER (toxic = 1), count(*) FILTER (toxic = 0)) < 2 THEN 'cannot cross-validate'
 WHEN least(count(*) FILTER (toxic = 1), count(*) FILTER (toxic = 0)) < 5 THEN 'fewer than five folds' ELSE 'none' END AS warning FROM labels""")
def label_counts(spark, d):
    return cohort.label_summary(table(spark, d, "labels").select(F.col("toxic").alias("label")))


# ---- tokens against the slide index --------------------------------------------------------------

_INDEX_CTES = f"""{SLIDES_CTE},
idx AS (SELECT slide AS file_name, regexp_replace(slide, '\\.[^.]*$', '') AS stem,
 CASE WHEN upper(slide) LIKE 'TCGA-%' THEN substr(slide, 1, 12) END AS patient,
 CASE WHEN upper(slide) LIKE 'TCGA-%' THEN substr(slide, 1, 12) || '-01' END AS sample FROM slides),
raw AS (SELECT c_custkey AS pos, CASE c_custkey % 7 WHEN 0 THEN slide WHEN 1 THEN regexp_replace(slide, '\\.[^.]*$', '') WHEN 2 THEN substr(slide, 1, 12)
 WHEN 3 THEN substr(slide, 1, 12) || '-01' WHEN 4 THEN lower(substr(slide, 1, 9)) WHEN 5 THEN 'nothing ' || c_custkey ELSE ' ' END AS token FROM slides),
tok AS (SELECT trim(token) AS token, min(pos) AS pos FROM raw WHERE trim(token) <> '' GROUP BY 1),
hits AS (SELECT token, pos, 0 AS tier, file_name FROM tok JOIN idx ON token = file_name
 UNION ALL SELECT token, pos, 1, file_name FROM tok JOIN idx ON token = stem
 UNION ALL SELECT token, pos, 2, file_name FROM tok JOIN idx ON token = sample
 UNION ALL SELECT token, pos, 3, file_name FROM tok JOIN idx ON token = patient
 UNION ALL SELECT token, pos, 4, file_name FROM tok JOIN idx ON upper(token) LIKE 'TCGA-%' AND starts_with(upper(stem), upper(token))),
best AS (SELECT token, min(tier) AS tier FROM hits GROUP BY 1)"""


def _tokens_and_index(spark, d):
    s = slides(spark, d)
    barcoded = F.upper("slide").startswith("TCGA-")
    index = s.select(
        F.col("slide").alias("file_name"),
        F.when(barcoded, F.substring("slide", 1, 12)).alias("patient"),
        F.when(barcoded, F.concat(F.substring("slide", 1, 12), F.lit("-01"))).alias("sample"),
    )
    k, short = F.col("c_custkey") % 7, F.substring("slide", 1, 12)
    token = (
        F.when(k == 0, F.col("slide")).when(k == 1, resolve.file_stem(F.col("slide"))).when(k == 2, short)
        .when(k == 3, F.concat(short, F.lit("-01"))).when(k == 4, F.lower(F.substring("slide", 1, 9)))
        .when(k == 5, F.concat(F.lit("nothing "), F.col("c_custkey").cast("string"))).otherwise(" ")
    )
    return s.select(F.col("c_custkey").alias("pos"), token.alias("token")), index


@query("token_resolution", "JN4", f"""WITH {_INDEX_CTES}, m AS (SELECT h.*, row_number() OVER (PARTITION BY file_name ORDER BY h.pos, h.tier, h.token) AS rn FROM hits h JOIN best b ON h.token = b.token AND h.tier = b.tier)
SELECT file_name, pos, tier, token FROM m WHERE rn = 1""")
def token_resolution(spark, d):
    return resolve.resolve_tokens(*_tokens_and_index(spark, d))[0]


@query("token_unresolved", "JN4", f"WITH {_INDEX_CTES} SELECT token, pos FROM tok WHERE token NOT IN (SELECT token FROM best)")
def token_unresolved(spark, d):
    return resolve.resolve_tokens(*_tokens_and_index(spark, d))[1]


@query("token_lists", "SRC6 SO4", """WITH w AS (SELECT 0 AS list_no, item_id AS a, text AS t FROM benchmark UNION ALL SELECT 1, page_id, url FROM pages),
x AS (SELECT list_no, a, list_filter(regexp_split_to_array(trim(t), '[\\s,;]+'), lambda s: s <> '') AS words FROM w),
e AS (SELECT list_no, a, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS p FROM x),
f AS (SELECT token, list_no, a * 4294967296 + p AS pos, row_number() OVER (PARTITION BY token ORDER BY list_no, a, p) AS rn FROM e)
SELECT token, list_no, CAST(pos AS BIGINT) AS pos FROM f WHERE rn = 1""")
def token_lists(spark, d):
    def words(df, key, text):
        split = df.select(F.col(key).alias("k"), F.posexplode(readers.split_tokens(F.col(text))).alias("p", "token"))
        return split.select((F.col("k") * (1 << 32) + F.col("p")).alias("pos"), "token")

    return resolve.ordered_union([words(table(spark, d, "benchmark"), "item_id", "text"), words(table(spark, d, "pages"), "page_id", "url")])


@query("substring_match", "JN16", """SELECT slide FROM (SELECT url AS slide, row_number() OVER (ORDER BY url) AS rn FROM pages WHERE contains(url, 'example')) WHERE rn = 4""")
def substring_match(spark, d):
    return resolve.match_substring(table(spark, d, "pages").select(F.col("url").alias("slide")), "slide", "example", 3)


# ---- merges --------------------------------------------------------------------------------------


@query("patient_merge", "JN5", """WITH a AS (SELECT c_nationkey AS patient, arg_min(c_name, (c_acctbal, c_custkey)) AS review_name FROM customer WHERE c_nationkey < 18 GROUP BY 1),
b AS (SELECT s_nationkey AS patient, arg_min(s_name, s_suppkey) AS mutation_name FROM supplier WHERE s_nationkey > 4 GROUP BY 1),
c AS (SELECT n_nationkey AS patient, n_name AS cohort_name FROM nation WHERE n_nationkey % 2 = 0)
SELECT coalesce(a.patient, b.patient, c.patient) AS patient, a.patient IS NOT NULL AS in_review, b.patient IS NOT NULL AS in_mutations,
 c.patient IS NOT NULL AS in_cohort, review_name, mutation_name AS mutations_name, cohort_name
FROM a FULL JOIN b ON a.patient = b.patient FULL JOIN c ON coalesce(a.patient, b.patient) = c.patient""")
def patient_merge(spark, d):
    tables = {
        "review": table(spark, d, "customer").where("c_nationkey < 18").select(F.col("c_nationkey").alias("patient"), "c_acctbal", "c_custkey", F.col("c_name").alias("name")),
        "mutations": table(spark, d, "supplier").where("s_nationkey > 4").select(F.col("s_nationkey").alias("patient"), "s_suppkey", F.col("s_name").alias("name")),
        "cohort": table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("patient"), F.col("n_name").alias("name")),
    }
    order = {"review": ["c_acctbal", "c_custkey"], "mutations": ["s_suppkey"], "cohort": ["name"]}
    return merge.merge_tables(tables, "patient", order).select(
        "patient", "in_review", "in_mutations", "in_cohort", "review_name", "mutations_name", "cohort_name"
    )


@query("cohort_restriction", "JN6", f"""WITH {SLIDES_CTE}, u AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000 UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
SELECT c_custkey, slide, c_nationkey FROM slides WHERE c_nationkey IN (SELECT k FROM u) AND contains(slide, '-DX')""")
def cohort_restriction(spark, d):
    union = merge.union_keys(
        table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")),
        table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")),
    )
    dx = slides(spark, d).where(F.contains("slide", F.lit("-DX"))).select("c_custkey", "slide", "c_nationkey")
    return merge.restrict(dx, union, ["c_nationkey"])


@query("feature_alignment", "JN7", """SELECT d.doc_id AS slide, n_chars, toxic AS label, 'aligned' AS state FROM documents d JOIN labels l USING (doc_id) WHERE d.n_chars > 1000
UNION ALL SELECT doc_id, NULL, toxic, 'no features' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000)""")
def feature_alignment(spark, d):
    features = table(spark, d, "documents").where("n_chars > 1000").select(F.col("doc_id").alias("slide"), "n_chars")
    given = table(spark, d, "labels").select(F.col("doc_id").alias("slide"), F.col("toxic").alias("label"))
    both, missing = merge.align(features, given)
    return both.withColumn("state", F.lit("aligned")).unionByName(
        missing.withColumns({"n_chars": F.lit(None).cast("long"), "state": F.lit("no features")})
    )


@query("overlay_refresh", "JN8", """WITH f AS (SELECT o_custkey, arg_min(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, o_orderkey) AS st, min(o_totalprice) AS rsem FROM (SELECT * FROM orders WHERE o_totalprice > 200000) GROUP BY 1)
SELECT c_custkey, coalesce(st, c_mktsegment) AS status, round(coalesce(rsem, c_acctbal), 6) AS expression, f.o_custkey IS NOT NULL AS has_fresh FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def overlay_refresh(spark, d):
    base = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("expression"))
    fresh = table(spark, d, "orders").where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min_by("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))).alias("status"),
        F.min("o_totalprice").alias("expression"),
    )
    merged = merge.overlay(base, fresh, "c_custkey", ["status", "expression"])
    return merged.withColumn("expression", F.round("expression", 6))


def assembled(spark, d):
    """Slides are orders, patients customers, variants line items, expression and copy number from parts."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("slide"), F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("patient")
    )
    li = table(spark, d, "lineitem")
    v = variants(spark, d).drop("patient")
    profiled = li.select(F.col("l_orderkey").alias("sample"))
    measured = li.select(
        F.col("l_orderkey").alias("sample"), "l_extendedprice", "l_partkey",
        F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate").alias("pos"),
    )
    expr = measured.select("sample", "pos", F.col("l_extendedprice").alias("value"))
    cna = measured.select("sample", "pos", (F.col("l_partkey") % 5 - 2).cast("int").alias("value"))
    load = li.groupBy(F.col("l_orderkey").alias("sample")).agg(F.count("*").alias("total_mutation_count"))
    clinical = table(spark, d, "customer").select(
        F.col("c_custkey").alias("patient"), F.col("c_mktsegment").alias("stage"), F.col("c_acctbal").alias("age")
    )
    return cohort.assemble_slides(o, profiled, v, expr, cna, load, clinical)


_ASSEMBLED_SQL = f"""WITH {CLASSIFIED_CTE},
e AS (SELECT l_orderkey AS sample, arg_min(l_extendedprice, k) AS expression, CAST(arg_min(l_partkey, k) % 5 - 2 AS INTEGER) AS cna FROM
 (SELECT *, (l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS k FROM lineitem) GROUP BY 1),
b AS (SELECT l_orderkey AS sample, count(*) AS total_mutation_count, count(*) AS np FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey AS slide, o_custkey AS patient, CASE WHEN np > 0 OR c.sample IS NOT NULL THEN coalesce(n_variants, 0) END AS n_variants,
 CASE WHEN np > 0 OR c.sample IS NOT NULL THEN coalesce(n_activating, 0) END AS n_activating, coalesce({ALIAS_SQL('hit_pc')}, any_pc) AS hotspot,
 expression, cna, total_mutation_count, c_mktsegment AS stage FROM orders LEFT JOIN classified c ON c.sample = o_orderkey
 LEFT JOIN e ON e.sample = o_orderkey LEFT JOIN b ON b.sample = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey)
"""


@query("slide_assembly", "JN9", _ASSEMBLED_SQL + """SELECT slide, patient, n_variants, n_activating, CASE WHEN n_activating > 0 THEN 'MUT' WHEN n_activating = 0 THEN 'WT' END AS status,
 CASE WHEN n_variants > 0 THEN 'MUT_any' WHEN n_variants = 0 THEN 'WT_any' END AS status_any, hotspot, round(expression, 6) AS expression, cna, total_mutation_count, stage FROM j""")
def slide_assembly(spark, d):
    return assembled(spark, d).select(
        "slide", "patient", "n_variants", "n_activating", "status", "status_any", "hotspot",
        F.round("expression", 6).alias("expression"), "cna", "total_mutation_count", "stage",
    )


@query("slide_summaries", "SNK8", _ASSEMBLED_SQL + """SELECT slide, patient, CASE WHEN n_activating > 0 THEN 'MUT' WHEN n_activating = 0 THEN 'WT' END AS status, hotspot AS genotype_hotspot, cna AS molecular_cna FROM j""")
def slide_summaries(spark, d):
    flat = sinks.slide_summary(assembled(spark, d))
    return flat.select(
        "slide", "patient", "status", F.col("summary.genotype.hotspot").alias("genotype_hotspot"), F.col("summary.molecular.cna").alias("molecular_cna")
    )


# ---- files ---------------------------------------------------------------------------------------

_FILES = """remote AS (SELECT 'f' || o_orderkey AS file_id, 'slide_' || o_orderkey || '.svs' AS file_name, md5(CAST(o_orderkey AS VARCHAR)) AS md5, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderkey AS k FROM orders),
loc AS (SELECT k, CASE WHEN k % 7 = 3 THEN 0 WHEN k % 7 = 4 THEN size - 5 WHEN k % 7 = 5 THEN size + 1 ELSE size END AS length, CASE WHEN k % 11 = 0 THEN 'other' ELSE md5 END AS lmd5 FROM remote WHERE k % 7 <> 2)"""


@query("file_reconciliation", "JN11", f"""WITH {_FILES} SELECT file_name, CASE WHEN l.k IS NULL THEN 'missing' WHEN length = 0 THEN 'empty file' WHEN length < size AND size > 0 THEN 'partial'
 WHEN length <> size AND size > 0 THEN 'size mismatch' WHEN lmd5 <> md5 THEN 'md5 mismatch' ELSE 'present' END AS reason FROM remote r LEFT JOIN loc l ON r.k = l.k""")
def file_reconciliation(spark, d):
    remote, local = _files(spark, d)
    return merge.reconcile(remote, local, "/data", verify=True).select("file_name", "reason")


def _files(spark, d):
    k = F.col("o_orderkey")
    text = k.cast("string")
    base = table(spark, d, "orders").select(
        F.concat(F.lit("f"), text).alias("file_id"), F.concat(F.lit("slide_"), text, F.lit(".svs")).alias("file_name"),
        F.md5(text).alias("md5"), F.floor("o_totalprice").cast("long").alias("size"), k.alias("k"),
    )
    m = F.col("k") % 7
    length = F.when(m == 3, 0).when(m == 4, F.col("size") - 5).when(m == 5, F.col("size") + 1).otherwise(F.col("size"))
    nested = F.concat(F.lit("/data/"), F.col("file_id"), F.lit("/"), F.col("file_name"))
    flat = F.concat(F.lit("/data/"), F.col("file_name"))
    local = base.where("k % 7 <> 2").select(
        F.when(F.col("k") % 2 == 0, nested).otherwise(flat).alias("path"), length.alias("length"),
        F.when(F.col("k") % 11 == 0, "other").otherwise(F.col("md5")).alias("md5"),
    )
    return base.drop("k"), local


@query("download_manifest", "SNK4", f"WITH {_FILES} SELECT file_id AS id, file_name AS filename, md5, size, 'released' AS state FROM remote")
def download_manifest(spark, d):
    remote, _ = _files(spark, d)
    return sinks.download_manifest(remote.withColumn("state", F.lit(None).cast("string")))


@query("checkpoint_keys", "SRC11", """WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'models/model_' || o_orderkey % 5 || '_30_ep.pt' ELSE 'models/split_' || o_orderkey % 25 || '/model_' || o_orderkey % 5 || '_30_ep.pt' END AS path FROM orders)
SELECT path, coalesce(CAST(nullif(regexp_extract(path, 'split_([0-9]+)/', 1), '') AS INTEGER), 0) AS repeat, CAST(regexp_extract(path, 'model_([0-9]+)', 1) AS INTEGER) AS fold, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def checkpoint_keys(spark, d):
    k = F.col("o_orderkey")
    five = (k % 5).cast("string")
    path = F.when(k % 3 == 0, F.concat(F.lit("models/model_"), five, F.lit("_30_ep.pt"))).otherwise(
        F.concat(F.lit("models/split_"), (k % 25).cast("string"), F.lit("/model_"), five, F.lit("_30_ep.pt"))
    )
    return readers.model_keys(table(spark, d, "orders").select(path.alias("path")), "path").groupBy("path", "repeat", "fold").agg(F.count("*").alias("n"))


# ---- order, limits, sets -------------------------------------------------------------------------


@query("first_slide_per_sample", "WN1", """SELECT o_custkey AS sample, o_orderkey AS folder, o_orderstatus AS status FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def first_slide_per_sample(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("folder"), F.col("o_orderstatus").alias("status"))
    return cohort.per_sample(o)


@query("first_non_null", "WN2", """SELECT user_id, arg_min(event_type, event_id) FILTER ("value" > 100) AS kind, arg_min("value", event_id) FILTER (event_type <> 'view') AS amount FROM events GROUP BY user_id""")
def first_non_null(spark, d):
    e = table(spark, d, "events").select(
        "user_id", "event_id", F.when(F.col("value") > 100, F.col("event_type")).alias("kind"), F.when(F.col("event_type") != "view", F.col("value")).alias("amount")
    )
    return cohort.first_non_null(e, ["user_id"], ["event_id"], ["kind", "amount"])


@query("numbered_batches", "WN10 SL2", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS seq FROM events WHERE event_type = 'click')
SELECT event_id, seq, seq // 50 AS batch FROM r WHERE seq + 1 BETWEEN 101 AND 900""")
def numbered_batches(spark, d):
    kept = table(spark, d, "events").where("event_type = 'click'").select("event_id")
    return resolve.range_slice(resolve.number_rows(kept, "event_id", 50), "seq", "101:900")


@query("sorted_export", "SL1", """SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal > 0 THEN round(c_acctbal, 2) END AS vaf FROM customer""")
def sorted_export(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.round("c_acctbal", 2)).alias("vaf")
    ).orderBy("c_mktsegment", F.asc_nulls_last("vaf"), "c_custkey")


@query("first_entries", "SL3", "SELECT user_id, min(event_id) AS pos FROM events GROUP BY user_id ORDER BY pos LIMIT 25")
def first_entries(spark, d):
    seen = table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("pos"))
    return resolve.first_n(seen, ["pos"], 25)


@query("every_nth_tile", "SL5", "SELECT event_id, user_id FROM events WHERE event_id % 64 = 0")
def every_nth_tile(spark, d):
    return resolve.every_nth(table(spark, d, "events").select("event_id", "user_id"), "event_id", 64)


@query("patient_union", "SO1", "SELECT s_nationkey AS patient FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def patient_union(spark, d):
    return merge.union_keys(
        table(spark, d, "supplier").select(F.col("s_nationkey").alias("patient")),
        table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("patient")),
    )


@query("cohort_intersection", "SO2", "SELECT o_custkey AS patient FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def cohort_intersection(spark, d):
    return merge.common_keys(
        table(spark, d, "orders").select(F.col("o_custkey").alias("patient")),
        table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("patient")),
    )


@query("missing_patients", "SO3", "SELECT c_custkey AS patient FROM customer EXCEPT SELECT o_custkey FROM orders")
def missing_patients(spark, d):
    return merge.missing_keys(
        table(spark, d, "customer").select(F.col("c_custkey").alias("patient")), table(spark, d, "orders").select(F.col("o_custkey").alias("patient"))
    )


@query("nested_records", "TG4", """SELECT conv_id, turn, role, word FROM (SELECT conv_id, turn, role, unnest(CASE WHEN len(string_split(text, ' ')) > 3 THEN string_split(text, ' ') ELSE [NULL] END) AS word FROM conversations)""")
def nested_records(spark, d):
    words = F.split("text", " ")
    nested = F.when(F.size(words) > 3, F.transform(words, lambda w: F.struct(w.alias("word"))))
    return cohort.explode_variants(table(spark, d, "conversations").select("conv_id", "turn", "role", nested.alias("variants")))
