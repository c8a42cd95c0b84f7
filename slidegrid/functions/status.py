"""Status words, activating variants, stages."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

# Status spellings.
MUTANT_WORDS = ["MUT", "MUTANT", "MUTATED", "MUTATION", "MUTATIONAL", "1", "YES", "TRUE"]
WILD_TYPE_WORDS = ["WT", "WILD-TYPE", "WILDTYPE", "WILD_TYPE", "WILD TYPE", "0", "NO", "FALSE", ""]

# Activating protein changes, and the display name of those with two numberings.
ACTIVATING = [
    "R248C", "S249C", "G370C", "G372C", "S371C", "S373C", "Y373C", "Y375C",
    "G380R", "G382R", "A393E", "K650E", "K652E", "K652Q", "K652M", "K652T",
]
HOTSPOT_NAMES = {
    "G370C": "G370C/G372C",
    "G372C": "G370C/G372C",
    "G380R": "G380R/G382R",
    "G382R": "G380R/G382R",
    "Y373C": "Y373C/Y375C",
    "Y375C": "Y373C/Y375C",
    "S371C": "S371C/S373C",
    "S373C": "S371C/S373C",
    "K650E": "K652E (K650E)",
    "K652E": "K652E (K650E)",
}
# Report order.
TOP_HOTSPOTS = ["S249C", "Y373C/Y375C", "G370C/G372C", "R248C", "G380R/G382R", "S371C/S373C"]
STAGES = ["Stage I", "Stage II", "Stage III", "Stage IV"]


def status_label(status: Column) -> Column:
    """1 mutant, 0 wild-type (blank counts as wild-type), NULL for any other word."""
    word = F.upper(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(word.isin(MUTANT_WORDS), 1).when(word.isin(WILD_TYPE_WORDS), 0).cast("int")


def label_text(label: Column) -> Column:
    return F.when(label == 1, "MUTANT").when(label == 0, "WILD-TYPE")


def status_from_prefix(text: Column) -> Column:
    """``MUTANT…`` and ``WILD…`` sentences to MUT and WT; anything else NULL."""
    word = F.upper(text)
    return F.when(word.startswith("MUTANT"), "MUT").when(word.startswith("WILD"), "WT")


def is_activating(change: Column, hotspots: list[str] = ACTIVATING) -> Column:
    return F.coalesce(change.isin(hotspots), F.lit(False))


def canonical_hotspot(change: Column, names: dict[str, str] = HOTSPOT_NAMES) -> Column:
    lookup = F.create_map(*[F.lit(v) for v in chain.from_iterable(names.items())])
    return F.coalesce(F.try_element_at(lookup, change), change)


def vaf(alt: Column, ref: Column) -> Column:
    """Variant allele fraction; NULL when no read covers the site."""
    return F.try_divide(alt.cast("double"), (alt + ref).cast("double"))


def classify_variants(df: DataFrame, variants: str = "variants", hotspots: list[str] = ACTIVATING) -> DataFrame:
    """Status, first hotspot and allele fraction from an array of variant records.

    The array must hold structs with proteinChange, tumorAltCount and tumorRefCount. An empty array
    is a known wild-type; a NULL array (no file) leaves every answer NULL.
    """
    all_records = F.col(variants)
    activating = F.filter(all_records, lambda v: is_activating(v["proteinChange"], hotspots))
    first_hit = F.get(activating, F.lit(0))
    first_any = F.get(all_records, F.lit(0))
    known = all_records.isNotNull()
    return df.withColumns(
        {
            "n_variants": F.when(known, F.size(all_records)),
            "n_activating": F.when(known, F.size(activating)),
            "status": F.when(known, F.when(F.size(activating) > 0, "MUT").otherwise("WT")),
            "status_any": F.when(known, F.when(F.size(all_records) > 0, "MUT_any").otherwise("WT_any")),
            "hotspot": F.when(F.size(activating) > 0, canonical_hotspot(first_hit["proteinChange"])).otherwise(
                first_any["proteinChange"]
            ),
            "protein_change_raw": F.coalesce(first_hit["proteinChange"], first_any["proteinChange"]),
            "alt_count": first_hit["tumorAltCount"],
            "ref_count": first_hit["tumorRefCount"],
            "vaf": vaf(first_hit["tumorAltCount"], first_hit["tumorRefCount"]),
        }
    )


def stage_label(stage: Column) -> Column:
    """``STAGE x`` in any case becomes ``Stage x``; other text is only trimmed."""
    text = F.trim(stage)
    return F.when(
        F.upper(text).startswith("STAGE"), F.concat(F.lit("Stage "), F.element_at(F.split(text, r"\s+"), -1))
    ).otherwise(text)


def stage_group(stage: Column, compat: bool = False) -> Column:
    """Collapse sub-stages to I to IV.

    ``compat`` keeps the known slip of matching the ``I`` of ``IV`` first (Stage IV becomes Stage I).
    """
    numerals = r"I{1,3}|IV|[0-9]" if compat else r"IV|I{1,3}|[0-9]"
    text = F.upper(stage)
    token = F.regexp_extract(text, rf"STAGE\s*({numerals})", 1)
    roman = (
        F.when(token == "1", "I").when(token == "2", "II").when(token == "3", "III").when(token == "4", "IV")
    )
    return (
        F.when(stage.isNull(), F.lit(None).cast("string"))
        .when(token != "", F.concat(F.lit("Stage "), F.coalesce(roman, token)))
        .otherwise(F.initcap(F.lower(stage)))
    )
