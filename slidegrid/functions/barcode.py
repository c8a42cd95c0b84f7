"""Slide barcodes: patient, sample and sample code out of file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The barcode formats.
STRICT_BARCODE = r"^(TCGA-[A-Z0-9]{2}-[A-Z0-9]{4})-([0-9]{2})"
LENIENT_BARCODE = r"^(TCGA-[A-Z0-9]+-[A-Z0-9]+)-([0-9]{2})[A-Z]?-.*"
PATIENT_BARCODE = r"^(TCGA-[A-Za-z0-9]{2}-[A-Za-z0-9]{4})"
SLIDE_SUFFIX = r"(?i)\.svs$"
DIAGNOSTIC_MARK = "-DX"


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"^.*/", "")


def stem(name: Column) -> Column:
    return F.regexp_replace(base_name(name), SLIDE_SUFFIX, "")


def _group(name: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))


def patient_id(name: Column) -> Column:
    """Strict patient id; NULL when the name is no barcode."""
    return _group(base_name(name), STRICT_BARCODE, 1)


def sample_id(name: Column) -> Column:
    """Strict sample id (patient and two-digit code); NULL when the name is no barcode."""
    return F.concat(patient_id(name), F.lit("-"), _group(base_name(name), STRICT_BARCODE, 2))


def patient_or_stem(name: Column) -> Column:
    """Grouping key for folds: the patient, or the file's own stem when it carries no barcode."""
    return F.coalesce(_group(base_name(name), PATIENT_BARCODE, 1), stem(name))


def parse_barcode(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Lenient parse: (rows with patient, sample, sample_code; rows that cannot be parsed).

    A name with at least three dash parts starting ``TCGA`` but no code gets code ``01``.
    """
    base = base_name(F.col(name))
    parts = F.split(base, "-")
    short = (F.size(parts) >= 3) & (parts[0] == "TCGA")
    patient = F.coalesce(
        _group(base, LENIENT_BARCODE, 1), F.when(short, F.array_join(F.slice(parts, 1, 3), "-"))
    )
    code = F.coalesce(_group(base, LENIENT_BARCODE, 2), F.when(short, F.lit("01")))
    parsed = df.withColumns({"patient": patient, "sample_code": code}).withColumn(
        "sample", F.concat_ws("-", "patient", "sample_code")
    )
    return (
        parsed.where(F.col("patient").isNotNull()),
        parsed.where(F.col("patient").isNull()).drop("patient", "sample", "sample_code"),
    )


def recover_sample(from_variants: Column, from_summary: Column, patient: Column) -> Column:
    """Sample id from the first variant record, else the summary, else patient and ``-01``."""
    blank = F.lit("")
    return F.coalesce(
        F.nullif(from_variants, blank), F.nullif(from_summary, blank), F.concat(patient, F.lit("-01"))
    )


def patient_prefix(sample: Column) -> Column:
    return F.substring(F.trim(sample), 1, 12)


def is_diagnostic(name: Column) -> Column:
    return F.contains(name, F.lit(DIAGNOSTIC_MARK))
