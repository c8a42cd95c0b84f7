"""Cohort statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidegrid.functions import status as st
from slidegrid.operators import cohort, quality
from slidegrid.queries.registry import query, rounded
from slidegrid.queries.scalar_queries import (
    ALIAS_SQL, CHANGE_SQL, HOTSPOT_SET, STAGE_GROUP_SQL, STAGE_SQL, tile_quality, variants,
)
from slidegrid.session import table

# Samples: customers with a status, stage, sex, expression and age drawn from their columns.
_SAMPLES = f"""samples AS (SELECT c_custkey AS sample, c_nationkey AS patient, CASE WHEN c_custkey % 8 = 0 THEN 'MUT' ELSE 'WT' END AS status,
 CASE WHEN c_custkey % 7 < 2 OR c_custkey % 8 = 0 THEN 'MUT_any' ELSE 'WT_any' END AS status_any, {STAGE_SQL} AS stage,
 CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS sex, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS expression,
 CAST(c_custkey % 60 + 30 AS DOUBLE) AS age FROM customer)"""


def samples(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("sample"), F.col("c_nationkey").alias("patient"),
        F.when(k % 8 == 0, "MUT").otherwise("WT").alias("status"),
        F.when((k % 7 < 2) | (k % 8 == 0), "MUT_any").otherwise("WT_any").alias("status_any"),
        F.expr(STAGE_SQL).alias("stage"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("sex"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("expression"),
        (k % 60 + 30).cast("double").alias("age"),
    )


@query("prevalence", "AG1", f"""WITH {_SAMPLES} SELECT count(*) AS n, count(*) FILTER (status = 'MUT') AS n_mut, count(*) FILTER (status = 'WT') AS n_wt,
 count(*) FILTER (status_any = 'MUT_any') AS n_any, count(*) FILTER (status_any = 'MUT_any') - count(*) FILTER (status = 'MUT') AS n_non_activating,
 round(100.0 * count(*) FILTER (status = 'MUT') / count(*), 6) AS pct_mut, round(100.0 * count(*) FILTER (status_any = 'MUT_any') / count(*), 6) AS pct_any,
 count(DISTINCT sample) AS n_samples, count(DISTINCT patient) AS n_patients FROM samples""")
def prevalence(spark, d):
    return rounded(cohort.prevalence(samples(spark, d)), "pct_mut", "pct_any")


@query("cohort_counts", "AG2 SRC4", """SELECT count(*) AS n_records, count(DISTINCT l_suppkey) AS n_patients, round(count(DISTINCT l_suppkey) / 411.0, 6) AS patient_share FROM lineitem""")
def cohort_counts(spark, d):
    return rounded(cohort.cohort_counts(variants(spark, d), None), "patient_share")


@query("hotspot_distribution", "AG3", f"""WITH v AS (SELECT l_tax, {CHANGE_SQL} AS pc FROM lineitem),
n AS (SELECT l_tax, CASE WHEN h IN {tuple(st.TOP_HOTSPOTS)} THEN h ELSE 'Other' END AS hotspot FROM (SELECT l_tax, {ALIAS_SQL('pc')} AS h FROM v)),
c AS (SELECT hotspot, count(*) FILTER (l_tax > 0.06) AS n_local, count(*) AS n_cohort FROM n GROUP BY 1),
s AS (SELECT unnest({st.TOP_HOTSPOTS + ['Other']}) AS hotspot, unnest(range(0, 7)) AS pos)
SELECT CAST(pos AS INTEGER) AS pos, s.hotspot, coalesce(n_local, 0) AS n_local, coalesce(n_cohort, 0) AS n_cohort FROM s LEFT JOIN c ON s.hotspot = c.hotspot""")
def hotspot_distribution(spark, d):
    named = table(spark, d, "lineitem").select("l_tax", st.canonical_hotspot(F.expr(CHANGE_SQL)).alias("hotspot"))
    return cohort.hotspots(named.where("l_tax > 0.06"), named)


@query("status_by_stage", "AG4", f"""WITH {_SAMPLES}, g AS (SELECT status, CASE WHEN s = 'T3 unknown' THEN 'T3 Unknown' ELSE {STAGE_GROUP_SQL} END AS stage FROM (SELECT status, stage AS s FROM samples) WHERE s IS NOT NULL),
c AS (SELECT stage, count(*) AS n, count(*) FILTER (status = 'MUT') AS n_mut FROM g GROUP BY 1), o AS (SELECT unnest({st.STAGES}) AS stage, unnest(range(0, 4)) AS pos)
SELECT CAST(pos AS INTEGER) AS pos, o.stage, coalesce(n, 0) AS n, coalesce(n_mut, 0) AS n_mut, round(coalesce(100.0 * n_mut / n, 0), 6) AS pct_mut FROM o LEFT JOIN c ON o.stage = c.stage""")
def status_by_stage(spark, d):
    return rounded(cohort.by_stage(samples(spark, d)), "pct_mut")


@query("status_by_sex", "AG5", f"""WITH {_SAMPLES} SELECT sex, count(*) AS n, count(*) FILTER (status = 'MUT') AS n_mut, count(*) FILTER (status = 'WT') AS n_wt,
 round(100.0 * count(*) FILTER (status = 'MUT') / count(*), 6) AS pct_mut FROM samples WHERE sex IS NOT NULL GROUP BY sex""")
def status_by_sex(spark, d):
    return rounded(cohort.by_group(samples(spark, d), "sex"), "pct_mut")


@query("group_medians", "AG6", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
 round(quantile_cont(l_extendedprice, 0.5), 6) AS median FROM lineitem GROUP BY 1, 2""")
def group_medians(spark, d):
    out = cohort.group_stats(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return rounded(out, "median").withColumn("mean", F.round("mean", 4))


@query("quantile_cap", "AG7", """WITH q AS (SELECT quantile_cont("value", 0.98) AS cap FROM events) SELECT event_id, round(least("value", cap), 6) AS capped FROM events, q""")
def quantile_cap(spark, d):
    return rounded(cohort.cap_at_quantile(table(spark, d, "events"), "value").select("event_id", "capped"), "capped")


@query("correlation", "AG8", """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY 1""")
def correlation(spark, d):
    return rounded(cohort.correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), "r")


@query("histogram_linear", "AG9", """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT l_returnflag, CAST(least(11, floor((l_extendedprice - lo) / ((hi - lo) / 12))) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1, 2""")
def histogram_linear(spark, d):
    li = table(spark, d, "lineitem")
    return cohort.histogram(li, "l_extendedprice", cohort.linear_edges(li, "l_extendedprice", 12), ["l_returnflag"])


@query("histogram_log", "AG9", """WITH e AS (SELECT log10(greatest(1.0, min(o_totalprice))) AS lo, log10(max(o_totalprice)) AS hi FROM orders)
SELECT CAST(least(18, floor((log10(o_totalprice) - lo) / ((hi - lo) / 19))) AS INTEGER) AS bin, count(*) AS n FROM orders, e WHERE log10(o_totalprice) >= lo GROUP BY 1""")
def histogram_log(spark, d):
    o = table(spark, d, "orders")
    return cohort.histogram(o, "o_totalprice", cohort.log_edges(o, "o_totalprice"))


@query("co_mutated_genes", "AG10", """WITH g AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#1')
SELECT p_brand AS gene, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, gene LIMIT 8""")
def co_mutated_genes(spark, d):
    v = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("sample"), F.col("p_brand").alias("gene")
    )
    return cohort.co_mutated(v, "Brand#1")


@query("value_distribution", "AG11", "SELECT p_size, count(*) AS n FROM part WHERE p_size IS NOT NULL GROUP BY 1")
def value_distribution(spark, d):
    return cohort.value_counts(table(spark, d, "part"), "p_size")


@query("mutation_burden", "AG12", """WITH r AS (SELECT l_orderkey AS s, count(*) AS n FROM lineitem WHERE l_quantity > 20 GROUP BY 1),
c AS (SELECT user_id AS s, arg_min("value", event_id) FILTER (event_type = 'click') AS a, arg_min("value", event_id) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)
SELECT o_orderkey AS sample, coalesce(n, CAST(trunc(coalesce(a, b)) AS BIGINT)) AS total_mutation_count FROM orders LEFT JOIN r ON r.s = o_orderkey LEFT JOIN c ON c.s = o_orderkey""")
def mutation_burden(spark, d):
    clinical = table(spark, d, "events").select(
        F.col("user_id").alias("sample"), F.col("event_id").alias("pos"), F.col("value").cast("string").alias("value"),
        F.when(F.col("event_type") == "click", "MUTATION_COUNT").when(F.col("event_type") == "view", "TMB (NS) - MUTATION COUNT").alias("attribute"),
    )
    records = table(spark, d, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("sample"))
    return cohort.burden(table(spark, d, "orders").select(F.col("o_orderkey").alias("sample")), records, clinical)


@query("run_statistics", "AG13", """WITH t AS (SELECT l_suppkey AS slide, l_quantity * 2 AS tp, l_quantity * 2 >= 30 AS acc, l_linenumber = 7 AS failed FROM lineitem)
SELECT slide, count(*) AS scanned, count(*) FILTER (acc AND NOT failed) AS accepted, count(*) FILTER (NOT acc AND NOT failed) AS rejected, count(*) FILTER (failed) AS failed,
 round(100.0 * count(*) FILTER (acc AND NOT failed) / count(*), 6) AS acceptance_pct, round(avg(tp) FILTER (acc AND NOT failed), 6) AS mean_tissue,
 round(stddev_pop(tp) FILTER (acc AND NOT failed), 6) AS std_tissue FROM t GROUP BY slide""")
def run_statistics(spark, d):
    t = tile_quality(spark, d).select(
        F.col("l_suppkey").alias("slide"), "tissue_percentage", (F.col("tissue_percentage") >= 30).alias("accepted"), (F.col("l_linenumber") == 7).alias("failed")
    )
    return rounded(quality.run_stats(t, ["slide"]), "acceptance_pct", "mean_tissue", "std_tissue")


@query("completeness", "AG15", """WITH j AS (SELECT d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT c AS col_name, p AS n_present, a - p AS n_missing, round((a - p) * 100.0 / a, 6) AS pct_missing FROM
(SELECT 'lang' AS c, count(lang) AS p, count(*) AS a FROM j UNION ALL SELECT 'source', count(source), count(*) FROM j
 UNION ALL SELECT 'quality', count(quality), count(*) FROM j UNION ALL SELECT 'toxic', count(toxic), count(*) FROM j)""")
def completeness(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return rounded(cohort.completeness(joined, ["lang", "source", "quality", "toxic"]), "pct_missing")
