"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidegrid.functions import barcode, color, scalars, status as st, vectors as vx
from slidegrid.operators import cohort, merge, quality, raster, resolve, stain
from slidegrid.queries.registry import SLIDES_CTE, query, r6, rounded, slides
from slidegrid.session import table

STRICT = "^(TCGA-[A-Z0-9]{2}-[A-Z0-9]{4})-([0-9]{2})"
LENIENT = "^(TCGA-[A-Z0-9]+-[A-Z0-9]+)-([0-9]{2})[A-Z]?-.*"


@query("barcode_strict", "PR1", f"""WITH {SLIDES_CTE}
SELECT c_custkey, nullif(regexp_extract(slide, '{STRICT}', 1), '') AS patient,
  nullif(regexp_extract(slide, '{STRICT}', 1), '') || '-' || nullif(regexp_extract(slide, '{STRICT}', 2), '') AS sample
FROM slides""")
def barcode_strict(spark, d):
    return slides(spark, d).select(
        "c_custkey", barcode.patient_id(F.col("slide")).alias("patient"), barcode.sample_id(F.col("slide")).alias("sample")
    )


_LENIENT_SQL = f"""WITH {SLIDES_CTE},
p AS (SELECT c_custkey, slide, string_split(slide, '-') AS parts,
  nullif(regexp_extract(slide, '{LENIENT}', 1), '') AS m, nullif(regexp_extract(slide, '{LENIENT}', 2), '') AS c FROM slides),
o AS (SELECT c_custkey, slide,
  coalesce(m, CASE WHEN len(parts) >= 3 AND parts[1] = 'TCGA' THEN parts[1] || '-' || parts[2] || '-' || parts[3] END) AS patient,
  coalesce(c, CASE WHEN len(parts) >= 3 AND parts[1] = 'TCGA' THEN '01' END) AS sample_code FROM p)
"""


@query("barcode_lenient", "PR2", _LENIENT_SQL + """SELECT c_custkey, patient, sample_code, patient || '-' || sample_code AS sample
FROM o WHERE patient IS NOT NULL""")
def barcode_lenient(spark, d):
    ok, _ = barcode.parse_barcode(slides(spark, d), "slide")
    return ok.select("c_custkey", "patient", "sample_code", "sample")


@query("barcode_rejects", "PR2", _LENIENT_SQL + "SELECT c_custkey, slide FROM o WHERE patient IS NULL")
def barcode_rejects(spark, d):
    _, bad = barcode.parse_barcode(slides(spark, d), "slide")
    return bad.select("c_custkey", "slide")


@query("fold_patient_key", "PR3", f"""WITH {SLIDES_CTE}
SELECT c_custkey, CASE WHEN regexp_matches(slide, '^TCGA-[A-Za-z0-9]{{2}}-[A-Za-z0-9]{{4}}') THEN substr(slide, 1, 12)
  ELSE regexp_replace(slide, '\\.svs$', '', 'i') END AS unit FROM slides""")
def fold_patient_key(spark, d):
    return slides(spark, d).select("c_custkey", barcode.patient_or_stem(F.col("slide")).alias("unit"))


@query("sample_recovery", "PR4", f"""WITH {SLIDES_CTE}
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'V-' || c_custkey END,
  CASE WHEN c_custkey % 4 = 1 THEN nullif(c_mktsegment, 'MACHINERY') WHEN c_custkey % 4 = 2 THEN nullif('', '') END,
  substr(slide, 1, 12) || '-01') AS sample FROM slides""")
def sample_recovery(spark, d):
    k = F.col("c_custkey") % 4
    variant = F.when(k == 0, F.concat(F.lit("V-"), F.col("c_custkey").cast("string")))
    summary = F.when(k == 1, F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY"))).when(k == 2, F.lit(""))
    return slides(spark, d).select(
        "c_custkey", barcode.recover_sample(variant, summary, barcode.patient_prefix(F.col("slide"))).alias("sample")
    )


@query("patient_prefix_dx", "PR5", f"""WITH {SLIDES_CTE}
SELECT c_custkey, substr(trim(slide), 1, 12) AS prefix, contains(slide, '-DX') AS is_dx FROM slides""")
def patient_prefix_dx(spark, d):
    return slides(spark, d).select(
        "c_custkey", barcode.patient_prefix(F.col("slide")).alias("prefix"), barcode.is_diagnostic(F.col("slide")).alias("is_dx")
    )


_WORDS = ["mut", " Mutant ", "WT", "wild type", "", "yes", "0", "unknown", "False", "Wild-Type"]
_WORD_SQL = "CASE " + " ".join(f"WHEN o_orderkey % 11 = {i} THEN '{w}'" for i, w in enumerate(_WORDS)) + " END"


@query("status_words", "PR6 PR7", f"""WITH w AS (SELECT o_orderkey, upper(trim(coalesce({_WORD_SQL}, ''))) AS s FROM orders),
l AS (SELECT o_orderkey, CASE WHEN s IN ('MUT','MUTANT','MUTATED','MUTATION','MUTATIONAL','1','YES','TRUE') THEN 1
 WHEN s IN ('WT','WILD-TYPE','WILDTYPE','WILD_TYPE','WILD TYPE','0','NO','FALSE','') THEN 0 END AS label FROM w)
SELECT o_orderkey, label, CASE label WHEN 1 THEN 'MUTANT' WHEN 0 THEN 'WILD-TYPE' END AS status FROM l""")
def status_words(spark, d):
    label = st.status_label(F.expr(_WORD_SQL))
    return table(spark, d, "orders").select("o_orderkey", label.alias("label"), st.label_text(label).alias("status"))


@query("status_sentences", "PR7", """SELECT p_partkey, CASE WHEN upper(s) LIKE 'MUTANT%' THEN 'MUT' WHEN upper(s) LIKE 'WILD%' THEN 'WT' END AS status
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Mutant: ' || p_name WHEN 1 THEN 'wild-type ' || p_type ELSE p_name END AS s FROM part)""")
def status_sentences(spark, d):
    text = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Mutant: ' || p_name WHEN 1 THEN 'wild-type ' || p_type ELSE p_name END")
    return table(spark, d, "part").select("p_partkey", st.status_from_prefix(text).alias("status"))


# Variants over line items: the protein change follows the part, the sample is the order.
_CHANGES = ["S249C", "Y373C", "Q674*", "R248C", "G372C", "H349D", "G382R", "K650E", "S373C", "E216K", "A393E", "P358L"]
CHANGE_SQL = "CASE l_partkey % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CHANGES)) + " END"
HOTSPOT_SET = "(" + ", ".join(f"'{c}'" for c in st.ACTIVATING) + ")"
ALIAS_SQL = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in st.HOTSPOT_NAMES.items()) + f" ELSE {c} END"
# A total order over line items (exact copies are alike in every column used here).
ITEM_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


def variants(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sample"),
        F.col("l_suppkey").alias("patient"),
        F.struct(*[c.strip() for c in ITEM_ORDER.split(",")]).alias("pos"),
        F.expr(CHANGE_SQL).alias("proteinChange"),
        F.col("l_quantity").cast("int").alias("tumorAltCount"),
        (F.col("l_partkey") % 50).cast("int").alias("tumorRefCount"),
    )


@query("hotspot_names", "PR8 PR9", f"""WITH v AS (SELECT {CHANGE_SQL} AS pc FROM lineitem)
SELECT pc, pc IN {HOTSPOT_SET} AS activating, {ALIAS_SQL('pc')} AS hotspot, count(*) AS n FROM v GROUP BY 1, 2, 3""")
def hotspot_names(spark, d):
    pc = F.col("proteinChange")
    return variants(spark, d).groupBy(
        pc.alias("pc"), st.is_activating(pc).alias("activating"), st.canonical_hotspot(pc).alias("hotspot")
    ).agg(F.count("*").alias("n"))


CLASSIFIED_CTE = f"""v AS (SELECT l_orderkey AS sample, {CHANGE_SQL} AS pc, CAST(l_quantity AS INTEGER) AS alt,
  CAST(l_partkey % 50 AS INTEGER) AS ref,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {ITEM_ORDER}) AS rn,
  row_number() OVER (PARTITION BY l_orderkey, ({CHANGE_SQL}) IN {HOTSPOT_SET} ORDER BY {ITEM_ORDER}) AS hn FROM lineitem),
classified AS (SELECT sample, count(*) AS n_variants, count(*) FILTER (pc IN {HOTSPOT_SET}) AS n_activating,
  max(pc) FILTER (rn = 1) AS any_pc, max(pc) FILTER (pc IN {HOTSPOT_SET} AND hn = 1) AS hit_pc,
  max(alt) FILTER (pc IN {HOTSPOT_SET} AND hn = 1) AS alt_count, max(ref) FILTER (pc IN {HOTSPOT_SET} AND hn = 1) AS ref_count
  FROM v GROUP BY sample)"""


@query("variant_classes", "PR10 PR11", f"""WITH {CLASSIFIED_CTE}
SELECT sample, n_variants, n_activating, coalesce({ALIAS_SQL('hit_pc')}, any_pc) AS hotspot, alt_count, ref_count,
  round(alt_count / nullif(CAST(alt_count + ref_count AS DOUBLE), 0), 6) AS vaf FROM classified""")
def variant_classes(spark, d):
    return rounded(cohort.classify_records(variants(spark, d), "sample"), "vaf")


_CHANGE_LIST_SQL = "[" + ", ".join(f"'{c}'" for c in _CHANGES) + "]"


@query("nested_variant_classes", "PR10", f"""WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN
  list_transform(range(0, p_size % 4), lambda i: ({_CHANGE_LIST_SQL})[(p_partkey + i * 5) % 12 + 1]) END AS pcs FROM part),
h AS (SELECT p_partkey, pcs, list_filter(pcs, lambda c: c IN {HOTSPOT_SET}) AS hits FROM v)
SELECT p_partkey, CAST(len(pcs) AS INTEGER) AS n_variants, CAST(len(hits) AS INTEGER) AS n_activating,
 CASE WHEN pcs IS NOT NULL THEN CASE WHEN len(hits) > 0 THEN 'MUT' ELSE 'WT' END END AS status,
 CASE WHEN pcs IS NOT NULL THEN CASE WHEN len(pcs) > 0 THEN 'MUT_any' ELSE 'WT_any' END END AS status_any,
 coalesce({ALIAS_SQL('hits[1]')}, pcs[1]) AS hotspot, coalesce(hits[1], pcs[1]) AS protein_change_raw FROM h""")
def nested_variant_classes(spark, d):
    """The array form, for sources that already hold nested records."""
    changes = F.array(*[F.lit(c) for c in _CHANGES])
    made = F.when(
        F.col("p_partkey") % 7 > 0,
        F.transform(
            F.slice(F.sequence(F.lit(0), F.lit(4)), F.lit(1), F.col("p_size") % 4),
            lambda i: F.struct(
                F.get(changes, ((F.col("p_partkey") + i * 5) % 12).cast("int")).alias("proteinChange"),
                i.alias("tumorAltCount"), F.lit(3).alias("tumorRefCount"),
            ),
        ),
    )
    typed = table(spark, d, "part").select("p_partkey", "p_size", made.alias("variants"))
    return st.classify_variants(typed).select(
        "p_partkey", "n_variants", "n_activating", "status", "status_any", "hotspot", "protein_change_raw"
    )


_STAGES = ["STAGE IV", "Stage IIIA", "stage 2", "Stage II", "STAGE I", "T3 unknown", "Stage IIIB", "  stage iv "]
STAGE_SQL = "CASE " + " ".join(f"WHEN c_custkey % 9 = {i} THEN '{s}'" for i, s in enumerate(_STAGES)) + " END"
STAGE_GROUP_SQL = """CASE WHEN s IS NULL THEN NULL
  WHEN regexp_extract(upper(s), 'STAGE\\s*(IV|I{1,3}|[0-9])', 1) <> '' THEN 'Stage ' ||
    CASE regexp_extract(upper(s), 'STAGE\\s*(IV|I{1,3}|[0-9])', 1) WHEN '1' THEN 'I' WHEN '2' THEN 'II' WHEN '3' THEN 'III' WHEN '4' THEN 'IV'
    ELSE regexp_extract(upper(s), 'STAGE\\s*(IV|I{1,3}|[0-9])', 1) END
  ELSE s END"""


@query("stage_labels", "PR12", f"""WITH t AS (SELECT c_custkey, {STAGE_SQL} AS s FROM customer)
SELECT c_custkey, CASE WHEN upper(trim(s)) LIKE 'STAGE%' THEN 'Stage ' || list_last(regexp_split_to_array(trim(s), '\\s+')) ELSE trim(s) END AS stage_label,
  CASE WHEN s = 'T3 unknown' THEN 'T3 Unknown' ELSE {STAGE_GROUP_SQL} END AS stage_group FROM t""")
def stage_labels(spark, d):
    s = F.expr(STAGE_SQL)
    return table(spark, d, "customer").select(
        "c_custkey", st.stage_label(s).alias("stage_label"), st.stage_group(s).alias("stage_group")
    )


@query("numeric_text", "PR13", """WITH t AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN CAST(c_custkey AS VARCHAR) || '.0'
  WHEN 2 THEN 'NA' WHEN 3 THEN ' ' || CAST(c_custkey AS VARCHAR) || '.5 ' WHEN 4 THEN 'nan ' ELSE c_mktsegment END AS s FROM customer),
n AS (SELECT c_custkey, s, CASE WHEN c_custkey % 6 IN (1, 3) THEN try_cast(trim(s) AS DOUBLE) END AS v FROM t)
SELECT c_custkey, round(v, 6) AS num, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) WHEN v IS NOT NULL THEN CAST(v AS VARCHAR) END AS num_text,
 CASE WHEN trim(s) NOT IN ('', 'NA', 'nan', 'NaN', 'None') THEN trim(s) END AS cleaned FROM n""")
def numeric_text(spark, d):
    t = table(spark, d, "customer").withColumn("s", F.expr(
        "CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN CAST(c_custkey AS STRING) || '.0' WHEN 2 THEN 'NA' "
        "WHEN 3 THEN ' ' || CAST(c_custkey AS STRING) || '.5 ' WHEN 4 THEN 'nan ' ELSE c_mktsegment END"))
    s = scalars.na_to_null(F.col("s"))
    return t.select("c_custkey", r6(scalars.num_or_null(s)).alias("num"), scalars.num_text(s).alias("num_text"), s.alias("cleaned"))


@query("folder_defaults", "PR14", """SELECT p_partkey, trim(regexp_replace('data/' || p_name || '/', '^data/', ''), '/') AS folder,
 coalesce(nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_type END), ''), 'WT') AS status FROM part""")
def folder_defaults(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        scalars.clean_folder(F.concat(F.lit("data/"), F.col("p_name"), F.lit("/"))).alias("folder"),
        scalars.blank_default(F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_type")), "WT").alias("status"),
    )


@query("gene_fallback", "PR15", """SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN event_type END,
 CASE WHEN event_id % 4 = 1 THEN nullif('', '') WHEN event_id % 4 = 2 THEN 'sym_' || event_type END,
 CASE WHEN event_id % 4 <> 3 THEN json_extract_string(props, '$.k') END, '?') AS gene FROM events""")
def gene_fallback(spark, d):
    k = F.col("event_id") % 4
    nested = F.struct(F.when(k == 0, F.col("event_type")).alias("hugoGeneSymbol")).getField("hugoGeneSymbol")
    flat = F.when(k == 1, "").when(k == 2, F.concat(F.lit("sym_"), F.col("event_type")))
    gid = F.when(k != 3, F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", scalars.gene_symbol(nested, flat, gid).alias("gene"))


@query("attribute_first", "PR16 WN2", """WITH e AS (SELECT conv_id, turn, role, text AS v FROM conversations),
f AS (SELECT conv_id, arg_min(v, turn) FILTER (role = 'user') AS u, arg_min(v, turn) FILTER (role = 'assistant') AS a,
 arg_min(v, turn) FILTER (role = 'system') AS s FROM e GROUP BY conv_id)
SELECT conv_id, u AS opening, coalesce(s, a) AS guidance FROM f""")
def attribute_first(spark, d):
    eav = table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("role").alias("attribute"), F.col("text").alias("value")
    )
    return cohort.attribute_first(eav, ["conv_id"], ["turn"], {"opening": ["user"], "guidance": ["system", "assistant"]})


@query("readable_sizes", "PR17", """WITH t AS (SELECT o_orderkey, o_totalprice * power(10, o_orderkey % 12) AS b FROM orders)
SELECT o_orderkey, CASE WHEN b < 1024 THEN CAST(CAST(floor(b) AS BIGINT) AS VARCHAR) || 'B' WHEN b < 1048576 THEN printf('%.1f', b / 1024) || 'KB'
 WHEN b < 1073741824 THEN printf('%.1f', b / 1048576) || 'MB' WHEN b < 1099511627776 THEN printf('%.1f', b / 1073741824) || 'GB'
 WHEN b < 1125899906842624 THEN printf('%.1f', b / 1099511627776) || 'TB' ELSE printf('%.1f', b / 1125899906842624) || 'PB' END AS readable FROM t""")
def readable_sizes(spark, d):
    size = F.col("o_totalprice") * F.pow(F.lit(10.0), (F.col("o_orderkey") % 12).cast("double"))
    return table(spark, d, "orders").select("o_orderkey", scalars.human_bytes(size).alias("readable"))


@query("report_lines", "PR18", """SELECT o_orderkey, 'tile_' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS tile_name,
 o_orderstatus || ' | ' || printf('%.2f', o_totalprice) AS line FROM orders""")
def report_lines(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.concat(F.lit("tile_"), scalars.padded(F.col("o_orderkey"))).alias("tile_name"),
        F.format_string("%s | %.2f", "o_orderstatus", "o_totalprice").alias("line"),
    )


@query("sigmoid_threshold", "PR19 PR20", """SELECT event_id, round(1 / (1 + exp(-(\"value\" - 50) / 20)), 6) AS prob,
 CAST(1 / (1 + exp(-(\"value\" - 50) / 20)) >= 0.5 AS INTEGER) AS pred FROM events""")
def sigmoid_threshold(spark, d):
    p = scalars.sigmoid((F.col("value") - 50) / 20)
    return table(spark, d, "events").select("event_id", r6(p).alias("prob"), scalars.binarize(p, 0.5).alias("pred"))


@query("vector_algebra", "PR21", """WITH p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
n AS (SELECT vec_id, x, y, sqrt(list_dot_product(x, x)) + 1e-8 AS nx, sqrt(list_dot_product(y, y)) + 1e-8 AS ny FROM p)
SELECT vec_id, round(nx - 1e-8, 6) AS length, round(list_dot_product(x, y), 6) AS inner_product,
 round(list_dot_product(x, y) / (nx * ny), 6) AS cosine, round(list_sum(list_transform(list_zip(x, y), lambda p: power(p[1] / nx - p[2] / ny, 2))), 5) AS sq_dist FROM n""")
def vector_algebra(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    pair = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    x, y = F.col("x"), F.col("y")
    return pair.select(
        "vec_id",
        r6(vx.norm(x)).alias("length"),
        r6(vx.dot(x, y)).alias("inner_product"),
        r6(vx.cosine(x, y)).alias("cosine"),
        F.round(vx.squared_distance(vx.l2n(x), vx.l2n(y)), 5).alias("sq_dist"),
    )


PIXELS_CTE = """px AS (SELECT l_suppkey AS tile, CAST(l_orderkey % 256 AS INTEGER) AS r, CAST((l_partkey * 7) % 256 AS INTEGER) AS g,
  CAST((l_suppkey * 13 + l_linenumber * 31) % 256 AS INTEGER) AS b FROM lineitem)"""


def pixels(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("tile"),
        (F.col("l_orderkey") % 256).cast("int").alias("r"),
        ((F.col("l_partkey") * 7) % 256).cast("int").alias("g"),
        ((F.col("l_suppkey") * 13 + F.col("l_linenumber") * 31) % 256).cast("int").alias("b"),
    )


HSV_SQL = """greatest(r, g, b) AS mx, least(r, g, b) AS mn"""
HUE_SQL = """CASE WHEN mx = mn THEN 0.0 WHEN mx = r THEN 60.0 * (g - b) / (mx - mn) WHEN mx = g THEN 120.0 + 60.0 * (b - r) / (mx - mn)
  ELSE 240.0 + 60.0 * (r - g) / (mx - mn) END"""
_LIN = lambda c: f"CASE WHEN {c} / 255.0 > 0.04045 THEN power(({c} / 255.0 + 0.055) / 1.055, 2.4) ELSE {c} / 255.0 / 12.92 END"
_CURVE = lambda t: f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0 / 116.0 END"
LAB_CTES = f"""lin AS (SELECT *, {_LIN('CAST(r AS DOUBLE)')} AS lr, {_LIN('CAST(g AS DOUBLE)')} AS lg, {_LIN('CAST(b AS DOUBLE)')} AS lb FROM px),
xyz AS (SELECT *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 AS x0, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb AS y0,
  (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS z0 FROM lin),
lab0 AS (SELECT *, {_CURVE('x0')} AS fx, {_CURVE('y0')} AS fy, {_CURVE('z0')} AS fz FROM xyz),
lab AS (SELECT *, (116.0 * fy - 16.0) * 255.0 / 100.0 AS l8, 500.0 * (fx - fy) + 128.0 AS a8, 200.0 * (fy - fz) + 128.0 AS b8 FROM lab0)"""


@query("colour_spaces", "PR22", f"""WITH {PIXELS_CTE}, {LAB_CTES}, c AS (SELECT *, {HSV_SQL} FROM lab)
SELECT tile, round(avg(0.299 * r + 0.587 * g + 0.114 * b), 4) AS grey,
 round(avg((CASE WHEN {HUE_SQL} < 0 THEN {HUE_SQL} + 360 ELSE {HUE_SQL} END) / 2), 4) AS hue,
 round(avg(CASE WHEN mx = 0 THEN 0 ELSE 255.0 * (mx - mn) / mx END), 4) AS sat, round(avg(-log10((r + 1) / 240.0)), 4) AS od,
 round(avg(l8), 4) AS lab_l, round(avg(a8), 4) AS lab_a, round(avg(b8), 4) AS lab_b FROM c GROUP BY tile""")
def colour_spaces(spark, d):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    hue, sat, _ = color.hsv(r, g, b)
    l8, a8, b8 = color.lab(r, g, b)
    r4 = lambda c, n: F.round(F.avg(c), 4).alias(n)
    return pixels(spark, d).groupBy("tile").agg(
        r4(color.grey(r, g, b), "grey"), r4(hue, "hue"), r4(sat, "sat"), r4(color.optical_density(r), "od"),
        r4(l8, "lab_l"), r4(a8, "lab_a"), r4(b8, "lab_b"),
    )


@query("mpp_fallback", "PR25", """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size / 100.0 END AS mpp,
 CASE WHEN p_partkey % 3 = 1 THEN p_name || '|MPP = 0.' || p_size || '|' ELSE p_name END AS txt FROM part)
SELECT p_partkey, round(coalesce(CAST(mpp AS DOUBLE), try_cast(nullif(regexp_extract(txt, 'MPP\\s*=\\s*([0-9.]+)', 1), '') AS DOUBLE), 0.25), 6) AS native_mpp FROM t""")
def mpp_fallback(spark, d):
    k = F.col("p_partkey") % 3
    mpp = F.when(k == 0, F.col("p_size") / 100.0)
    text = F.when(k == 1, F.concat("p_name", F.lit("|MPP = 0."), F.col("p_size").cast("string"), F.lit("|"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", r6(scalars.mpp_or_default(mpp, text)).alias("native_mpp"))


@query("tile_footprints", "PR26", """SELECT p_partkey, CAST(round_even(224.0 / (0.2 + p_size / 100.0), 0) AS INTEGER) AS step,
 CAST(floor(p_size * 10 * p_size * 8 * 0.5 / 100) AS BIGINT) AS min_area FROM part""")
def tile_footprints(spark, d):
    native = F.lit(0.2) + F.col("p_size") / 100.0
    return table(spark, d, "part").select(
        "p_partkey",
        scalars.footprint(224, 1.0, native).alias("step"),
        F.floor(F.col("p_size") * 10 * F.col("p_size") * 8 * 0.5 / 100).cast("long").alias("min_area"),
    )


@query("class_weight", "PR29", """SELECT count(*) FILTER (toxic = 1) AS n_pos, count(*) FILTER (toxic = 0) AS n_neg,
 round(count(*) FILTER (toxic = 0) / CAST(greatest(1, count(*) FILTER (toxic = 1)) AS DOUBLE), 6) AS pos_weight FROM labels""")
def class_weight(spark, d):
    return rounded(scalars.pos_weight(table(spark, d, "labels"), "toxic"), "pos_weight")


@query("run_duration", "PR30", """SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds FROM events GROUP BY user_id""")
def run_duration(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(r6(scalars.elapsed_seconds(F.min("ts"), F.max("ts"))).alias("seconds"))


# ---- filters -----------------------------------------------------------------------------------


def tile_quality(spark, d):
    """Tiles over line items with the figures the validity rules look at."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        (F.col("l_quantity") * 2).alias("tissue_percentage"),
        F.floor(F.col("l_extendedprice") / 300.0).cast("double").alias("focus_score"),
        (F.col("l_partkey") % 256).cast("double").alias("mean_saturation"),
        (F.col("l_suppkey") * 3 % 256).cast("double").alias("mean_value"),
    )


@query("tile_validity", "FL2 FL3", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity * 2 AS tp,
 floor(l_extendedprice / 300.0) AS fs, l_partkey % 256 AS s, l_suppkey * 3 % 256 AS v FROM lineitem),
j AS (SELECT *, tp >= 10 AS a, fs >= 100 AS f, (s > 10 AND s < 220 AND v > 30 AND v < 240) AS c FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, a AND f AND c AS is_valid,
 concat_ws('; ', CASE WHEN NOT a THEN 'low tissue (' || printf('%.1f', tp) || '%)' END, CASE WHEN NOT f THEN 'unfocused (' || printf('%.1f', fs) || ')' END,
 CASE WHEN NOT c THEN 'poor staining' END) AS reasons FROM j""")
def tile_validity(spark, d):
    return quality.judge(tile_quality(spark, d)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "is_valid", F.array_join("reasons", "; ").alias("reasons")
    )


@query("tile_statistics", "AG24 FL3", f"""WITH {PIXELS_CTE}, c AS (SELECT *, {HSV_SQL} FROM px),
s AS (SELECT tile, count(*) AS n, avg((CASE WHEN {HUE_SQL} < 0 THEN {HUE_SQL} + 360 ELSE {HUE_SQL} END) / 2) AS h,
 avg(CASE WHEN mx = 0 THEN 0 ELSE 255.0 * (mx - mn) / mx END) AS s, avg(mx) AS v, var_pop(0.299 * r + 0.587 * g + 0.114 * b) AS gv FROM c GROUP BY tile)
SELECT tile, n, round(h, 4) AS mean_hue, round(s, 4) AS mean_saturation, round(v, 4) AS mean_value, round(gv, 4) AS grey_variance,
 s > 10 AND s < 220 AND v > 30 AND v < 240 AS is_stained FROM s""")
def tile_statistics(spark, d):
    s = raster.tile_stats(pixels(spark, d), ["tile"])
    ok = quality.is_stained(F.col("mean_saturation"), F.col("mean_value"))
    return s.select(
        "tile", "n", *[F.round(c, 4).alias(c) for c in ("mean_hue", "mean_saturation", "mean_value", "grey_variance")], ok.alias("is_stained")
    )


@query("name_globs", "FL5", """SELECT page_id, url FROM pages WHERE regexp_matches(url, '^.*example\\.[no].*/[0-9].*$')""")
def name_globs(spark, d):
    return resolve.glob_filter(table(spark, d, "pages").select("page_id", "url"), "url", "*example.[no]*/[0-9]*")


@query("state_rejects", "FL6", """SELECT o_orderkey, o_orderstatus, o_orderstatus <> 'F' AS rejected FROM orders""")
def state_rejects(spark, d):
    kept, bad = resolve.state_filter(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "F")
    return kept.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True)))


@query("opaque_pixels", "FL7", f"""WITH {PIXELS_CTE}, o AS (SELECT *, least(-log10((r + 1) / 240.0), -log10((g + 1) / 240.0), -log10((b + 1) / 240.0)) >= 0.15 AS dense FROM px),
k AS (SELECT *, count(*) FILTER (dense) OVER (PARTITION BY tile) AS nd FROM o)
SELECT tile, count(*) AS n, CAST(sum(r) AS BIGINT) AS sum_r FROM k WHERE nd < 10 OR dense GROUP BY tile""")
def opaque_pixels(spark, d):
    kept = stain.drop_transparent(pixels(spark, d), ["tile"])
    return kept.groupBy("tile").agg(F.count("*").alias("n"), F.sum("r").alias("sum_r"))


@query("slides_without_tiles", "FL8", """SELECT p_partkey AS slide, 'no tiles kept' AS reason FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_discount < 0.05)""")
def slides_without_tiles(spark, d):
    tiles = table(spark, d, "lineitem").where("l_quantity >= 49 AND l_discount < 0.05").select(F.col("l_partkey").alias("slide"))
    _, skipped = merge.zero_tile_slides(table(spark, d, "part").select(F.col("p_partkey").alias("slide")), tiles)
    return skipped


@query("complete_rows", "FL9", """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND d.lang IS NOT NULL""")
def complete_rows(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return cohort.drop_missing(joined, ["quality", "lang"]).select("doc_id", "quality")
