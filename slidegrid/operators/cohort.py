"""Cohort assembly and statistics over slides, samples, variants and clinical attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from slidegrid.functions import scalars, status as st
from slidegrid.operators.ordered import first_per, group_quantiles
from slidegrid.operators.skew import spread_join


def attribute_first(df: DataFrame, key: list[str], order: list[str], attrs: dict[str, list[str]]) -> DataFrame:
    """First non-null value per attribute out of entity-attribute-value rows.

    ``attrs`` maps an output column to attribute ids in order of preference; within an id the
    earliest row by ``order`` wins. One aggregate, no pivot job.
    """
    picks = {}
    for out, ids in attrs.items():
        for i, attr in enumerate(ids):
            hit = (F.col("attribute") == attr) & F.col("value").isNotNull()
            picks[f"__{out}_{i}"] = F.min_by(
                F.when(hit, F.col("value")), F.when(hit, F.struct(*order))
            )
    wide = df.groupBy(*key).agg(*[c.alias(n) for n, c in picks.items()])
    return wide.select(
        *key, *[F.coalesce(*[F.col(f"__{o}_{i}") for i in range(len(ids))]).alias(o) for o, ids in attrs.items()]
    )


def first_non_null(df: DataFrame, key: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Per key, the first non-null of every column in ``order``."""
    return df.groupBy(*key).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in cols]
    )


def classify_records(variants: DataFrame, key: str, hotspots: list[str] = st.ACTIVATING) -> DataFrame:
    """Per key, the counts, first hotspot and allele fraction of long variant records in ``pos`` order.

    The same answer as ``status.classify_variants`` on arrays, from aggregates with map-side combine:
    no key is ever collected.
    """
    hit = st.is_activating(F.col("proteinChange"), hotspots)
    record = F.struct("proteinChange", "tumorAltCount", "tumorRefCount")
    grouped = variants.groupBy(key).agg(
        F.count("*").alias("n_variants"),
        F.count_if(hit).alias("n_activating"),
        F.min_by(record, "pos").alias("__any"),
        F.min_by(F.when(hit, record), F.when(hit, F.col("pos"))).alias("__hit"),
    )
    return grouped.select(
        key,
        "n_variants",
        "n_activating",
        F.coalesce(
            st.canonical_hotspot(F.col("__hit.proteinChange")), F.col("__any.proteinChange")
        ).alias("hotspot"),
        F.col("__hit.tumorAltCount").alias("alt_count"),
        F.col("__hit.tumorRefCount").alias("ref_count"),
        st.vaf(F.col("__hit.tumorAltCount"), F.col("__hit.tumorRefCount")).alias("vaf"),
    )


def assemble_slides(
    slides: DataFrame,
    profiled: DataFrame,
    variants: DataFrame,
    expression: DataFrame,
    cna: DataFrame,
    burden: DataFrame,
    clinical: DataFrame,
) -> DataFrame:
    """One wide row per slide. All per-sample sources are stacked and grouped in a single shuffle, with
    map-side combine, instead of being joined one after another.

    ``profiled`` lists the samples that have a variant file. A profiled sample without records is a
    known wild-type; a sample outside it keeps NULL.
    """
    record = F.struct("proteinChange", "tumorAltCount", "tumorRefCount")
    hit = F.col("__rec").isNotNull() & st.is_activating(F.col("__rec.proteinChange"))
    rows = [
        profiled.select("sample", F.lit(True).alias("__known")),
        variants.select("sample", record.alias("__rec"), F.col("pos").alias("__vpos")),
        expression.select("sample", F.col("value").alias("__expr"), F.col("pos").alias("__epos")),
        cna.select("sample", F.col("value").alias("__cna"), F.col("pos").alias("__cpos")),
        burden.select("sample", "total_mutation_count"),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    has = F.col("__rec").isNotNull()
    sides = stacked.groupBy("sample").agg(
        F.max("__known").alias("__known"),
        F.count_if(has).alias("n_variants"),
        F.count_if(hit).alias("n_activating"),
        F.min_by("__rec", F.when(has, F.col("__vpos"))).alias("__any"),
        F.min_by("__rec", F.when(hit, F.col("__vpos"))).alias("__hit"),
        F.min_by("__expr", "__epos").alias("expression"),
        F.min_by("__cna", "__cpos").alias("cna"),
        F.max("total_mutation_count").alias("total_mutation_count"),
    )
    seen = F.col("__known") | (F.col("n_variants") > 0)
    facts = sides.select(
        "sample",
        *[F.when(seen, F.col(c)).alias(c) for c in ("n_variants", "n_activating")],
        F.when(seen, F.when(F.col("n_activating") > 0, "MUT").otherwise("WT")).alias("status"),
        F.when(seen, F.when(F.col("n_variants") > 0, "MUT_any").otherwise("WT_any")).alias("status_any"),
        F.coalesce(st.canonical_hotspot(F.col("__hit.proteinChange")), F.col("__any.proteinChange")).alias("hotspot"),
        F.col("__hit.tumorAltCount").alias("alt_count"),
        F.col("__hit.tumorRefCount").alias("ref_count"),
        st.vaf(F.col("__hit.tumorAltCount"), F.col("__hit.tumorRefCount")).alias("vaf"),
        "expression", "cna", "total_mutation_count",
    )
    return spread_join(
        spread_join(slides, facts, ["sample"], "left", salt_on=["slide"]), clinical, ["patient"], "left", salt_on=["slide"]
    )


def per_sample(slides: DataFrame) -> DataFrame:
    """One row per sample: the slide with the first folder name."""
    return first_per(slides, ["sample"], ["folder"])


def prevalence(samples: DataFrame) -> DataFrame:
    n, mut = F.count("*"), F.count_if(F.col("status") == "MUT")
    any_mut = F.count_if(F.col("status_any") == "MUT_any")
    return samples.agg(
        n.alias("n"),
        mut.alias("n_mut"),
        F.count_if(F.col("status") == "WT").alias("n_wt"),
        any_mut.alias("n_any"),
        (any_mut - mut).alias("n_non_activating"),
        F.try_divide(mut * 100.0, n).alias("pct_mut"),
        F.try_divide(any_mut * 100.0, n).alias("pct_any"),
        F.countDistinct("sample").alias("n_samples"),
        F.countDistinct("patient").alias("n_patients"),
    )


def cohort_counts(variants: DataFrame, study_size: int | Column | None) -> DataFrame:
    """Records, distinct patients and their share of the study (411 samples when the size is unknown)."""
    size = study_size if isinstance(study_size, Column) else F.lit(study_size).cast("int")
    total = F.coalesce(size, F.lit(411))
    return variants.agg(F.count("*").alias("n_records"), F.countDistinct("patient").alias("n_patients")).select(
        "n_records", "n_patients", (F.col("n_patients") / total).alias("patient_share")
    )


def hotspots(local: DataFrame, cohort: DataFrame, top: list[str] = st.TOP_HOTSPOTS) -> DataFrame:
    """Counts per named hotspot, the rest as ``Other``, local and cohort side by side, zero filled."""
    name = F.when(F.col("hotspot").isin(top), F.col("hotspot")).otherwise("Other")

    def counted(df: DataFrame, out: str) -> DataFrame:
        return df.where(F.col("hotspot").isNotNull()).groupBy(name.alias("hotspot")).agg(F.count("*").alias(out))

    spine = local.sparkSession.createDataFrame([(i, h) for i, h in enumerate([*top, "Other"])], "pos int, hotspot string")
    return (
        spine.join(counted(local, "n_local"), "hotspot", "left")
        .join(counted(cohort, "n_cohort"), "hotspot", "left")
        .select("pos", "hotspot", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_local", "n_cohort")])
    )


def by_stage(samples: DataFrame, compat: bool = False) -> DataFrame:
    """Counts and mutant rate for Stage I to IV in fixed order, zero filled."""
    staged = samples.where(F.col("stage").isNotNull()).withColumn("stage", st.stage_group(F.col("stage"), compat))
    counted = staged.groupBy("stage").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "MUT").alias("n_mut"))
    spine = samples.sparkSession.createDataFrame(list(enumerate(st.STAGES)), "pos int, stage string")
    zero = F.lit(0)
    return spine.join(counted, "stage", "left").select(
        "pos",
        "stage",
        F.coalesce("n", zero).alias("n"),
        F.coalesce("n_mut", zero).alias("n_mut"),
        F.coalesce(F.try_divide(F.col("n_mut") * 100.0, F.col("n")), F.lit(0.0)).alias("pct_mut"),
    )


def by_group(samples: DataFrame, col: str) -> DataFrame:
    """Mutant, wild-type and rate per value of ``col`` (sex, grade, ...)."""
    mut = F.count_if(F.col("status") == "MUT")
    return samples.where(F.col(col).isNotNull()).groupBy(col).agg(
        F.count("*").alias("n"),
        mut.alias("n_mut"),
        F.count_if(F.col("status") == "WT").alias("n_wt"),
        (mut * 100.0 / F.count("*")).alias("pct_mut"),
    )


def group_stats(df: DataFrame, by: list[str], col: str, splits: list[float] | None = None) -> DataFrame:
    """n, mean, min, max and exact median per group."""
    live = df.where(F.col(col).isNotNull())
    moments = live.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max")
    )
    median = group_quantiles(live, by, col, {"median": 0.5}, splits=splits).drop("n")
    return moments.join(median, by)


def cap_at_quantile(df: DataFrame, col: str, q: float = 0.98, out: str = "capped") -> DataFrame:
    """Clip ``col`` from above at its q-quantile, a scalar subquery."""
    cap = group_quantiles(df, [], col, {"__cap": q}).select("__cap").scalar()
    return df.withColumn(out, F.when(F.col(col).isNotNull(), F.least(F.col(col).cast("double"), cap)))


def correlation(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """Pearson correlation of complete pairs; NULL when one side does not vary."""
    live = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return live.groupBy(*by).agg(r.alias("r"), F.count("*").alias("n"))


def histogram(df: DataFrame, col: str, edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts per bin, last bin closed on the right; ``edges`` is one row with an array ``edges``.

    The bin of a value is the number of edges at or below it; reports use a dozen or two of bins.
    """
    v = F.col(col).cast("double")
    tagged = df.where(F.col(col).isNotNull()).withColumn("edges", edges.select("edges").scalar())
    n = F.size("edges") - 1
    passed = F.aggregate("edges", F.lit(0), lambda acc, e: acc + F.when(e <= v, 1).otherwise(0))
    bin_no = F.when(v == F.element_at("edges", -1), n).otherwise(passed)
    return (
        tagged.where((v >= F.element_at("edges", 1)) & (v <= F.element_at("edges", -1)))
        .groupBy(*by, (bin_no - 1).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def linear_edges(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width edges between min and max, as one row."""
    return df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).select(
        F.transform(
            F.sequence(F.lit(0), F.lit(bins)),
            lambda i: F.when(i == bins, F.col("hi")).otherwise(F.col("lo") + i * ((F.col("hi") - F.col("lo")) / bins)),
        ).alias("edges")
    )


def log_edges(df: DataFrame, col: str, count: int = 20) -> DataFrame:
    """``count`` log-spaced edges from max(1, min) to max, as one row."""
    span = df.agg(F.greatest(F.lit(1.0), F.min(col)).alias("lo"), F.max(col).cast("double").alias("hi"))
    return span.select(
        F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)),
            lambda i: F.when(i == 0, F.col("lo"))
            .when(i == count - 1, F.col("hi"))
            .otherwise(
                F.pow(F.lit(10.0), F.log10("lo") + i * ((F.log10("hi") - F.log10("lo")) / (count - 1)))
            ),
        ).alias("edges")
    )


def co_mutated(variants: DataFrame, gene: str, k: int = 8, per: str = "sample") -> DataFrame:
    """Most often mutated other genes. ``per`` is the unit counted once per gene, or ``record``."""
    others = variants.where(F.col("gene").isNotNull() & (F.col("gene") != gene))
    units = others if per == "record" else others.select(per, "gene").distinct()
    return units.groupBy("gene").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gene").limit(k)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).orderBy(col)


def burden(samples: DataFrame, variants: DataFrame, clinical: DataFrame) -> DataFrame:
    """Mutation records per sample; where a sample has no file, the count its clinical rows state."""
    counted = variants.groupBy("sample").agg(F.count("*").alias("__records"))
    stated = attribute_first(
        clinical, ["sample"], ["pos"], {"stated": ["MUTATION_COUNT", "TMB (NS) - MUTATION COUNT"]}
    )
    return samples.join(counted, "sample", "left").join(stated, "sample", "left").select(
        *samples.columns,
        F.coalesce(F.col("__records"), scalars.num_or_null(F.col("stated")).cast("long")).alias("total_mutation_count"),
    )


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing and present counts per column from a single pass, unpivoted to one row per column."""
    one = df.agg(F.count("*").alias("__all"), *[F.count(c).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return one.selectExpr("__all", f"stack({len(cols)}, {pairs}) AS (col_name, n_present)").select(
        "col_name",
        "n_present",
        (F.col("__all") - F.col("n_present")).alias("n_missing"),
        F.try_divide((F.col("__all") - F.col("n_present")) * 100.0, F.col("__all")).alias("pct_missing"),
    )


def label_summary(labels: DataFrame) -> DataFrame:
    """Class sizes and the warning level they deserve (under 2 impossible, under 5 fewer folds)."""
    sized = labels.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == 1).alias("n_pos"),
        F.count_if(F.col("label") == 0).alias("n_neg"),
    )
    small = F.least("n_pos", "n_neg")
    return sized.withColumn(
        "warning",
        F.when(small < 2, "cannot cross-validate").when(small < 5, "fewer than five folds").otherwise("none"),
    )


def explode_variants(df: DataFrame, variants: str = "variants") -> DataFrame:
    """One row per nested record; parents without records stay with NULLs."""
    return df.select(*[c for c in df.columns if c != variants], F.inline_outer(variants))


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


