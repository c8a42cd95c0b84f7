"""Small column expressions: coercion, text, arithmetic, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Spellings of a missing value.
NA_WORDS = ["", "NA", "nan", "NaN", "None"]
DEFAULT_MPP = 0.25
MPP_IN_TEXT = r"MPP\s*=\s*([0-9.]+)"


def num_or_null(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def num_text(text: Column) -> Column:
    """Numbers as text, without a fraction when they are whole; NULL for blank or words."""
    value = num_or_null(text)
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def na_to_null(text: Column) -> Column:
    word = F.trim(text)
    return F.when(~word.isin(NA_WORDS), word)


def clean_folder(path: Column) -> Column:
    """Without a leading ``data/`` and without slashes at either end."""
    return F.regexp_replace(F.regexp_replace(F.trim(path), r"^data/", ""), r"^[/\\]+|[/\\]+$", "")


def blank_default(text: Column, default: Column | str) -> Column:
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), fallback)


def gene_symbol(nested: Column, flat: Column, gene_id: Column) -> Column:
    """First usable gene name of a variant record; ``?`` when there is none."""
    blank = F.lit("")
    return F.coalesce(F.nullif(nested, blank), F.nullif(flat, blank), F.nullif(gene_id.cast("string"), blank), F.lit("?"))


def human_bytes(size: Column) -> Column:
    """``512B``, ``1.5KB`` … ``PB``; one digit of the exact binary value, a tie goes to the even digit."""
    value = size.cast("double")
    out = F.when(value.isNull(), F.lit(None).cast("string")).when(F.abs(value) < 1024, F.concat(value.cast("long").cast("string"), F.lit("B")))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], start=1):
        out = out.when(F.abs(value) < 1024.0 ** (power + 1), F.concat(_one_digit(value / 1024.0**power), F.lit(unit)))
    return out.otherwise(F.concat(_one_digit(value / 1024.0**5), F.lit("PB")))


def _one_digit(x: Column) -> Column:
    """``%.1f`` as C has it, for values of one and more in size: Java's rounds the shortest decimal form, and ties away from zero.

    The fraction of such a double is a whole number of 2^-52, so its tenths are integer arithmetic; no such size comes near 2^62 PB.
    """
    size, half = F.abs(x), F.lit(1 << 51)
    whole = F.floor(size)
    parts = ((size - whole) * float(1 << 52)).try_cast("long") * 10
    tenths, rest = F.shiftright(parts, 52), F.pmod(parts, F.lit(1 << 52))
    digit = tenths + ((rest > half) | ((rest == half) & (tenths % 2 == 1))).cast("long")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, (whole + F.when(digit == 10, 1).otherwise(0)).cast("string"), F.lit("."), (digit % 10).cast("string"))
    return F.when(size < float(1 << 62), text).otherwise(F.format_string("%.1f", x))


def padded(number: Column, width: int = 6) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def binarize(p: Column, threshold: float | Column) -> Column:
    return (p >= threshold).cast("int")


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(F.least(x, hi), lo)


def gamma_opacity(score: Column, gamma: float) -> tuple[Column, Column]:
    """Display value clip(s)^gamma and its opacity 0.5 + 0.5 v."""
    value = F.pow(clip(score, 0.0, 1.0), F.lit(gamma))
    return value, F.lit(0.5) + F.lit(0.5) * value


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1_000_000.0)


def mpp_or_default(mpp: Column, description: Column | None = None, default: float = DEFAULT_MPP) -> Column:
    """Microns per pixel from metadata, else from ``MPP = x`` in the description, else 0.25."""
    choices = [mpp.cast("double")]
    if description is not None:
        choices.append(F.nullif(F.regexp_extract(description, MPP_IN_TEXT, 1), F.lit("")).try_cast("double"))
    return F.coalesce(*choices, F.lit(default))


def footprint(tile_px: int, target_mpp: float, native_mpp: Column) -> Column:
    """Level-0 pixels under one tile, rounded half to even."""
    return F.bround(F.lit(tile_px * target_mpp) / native_mpp, 0).cast("int")


def pos_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """negatives / max(1, positives) as a one-row frame."""
    pos = F.count_if(F.col(label) == 1)
    return df.agg(
        pos.alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"),
        (F.count_if(F.col(label) == 0) / F.greatest(pos, F.lit(1))).alias("pos_weight"),
    )
