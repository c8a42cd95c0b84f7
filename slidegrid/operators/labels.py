"""One label per slide from prioritised sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from slidegrid.functions import status as st
from slidegrid.operators.skew import spread_join


@dataclass(frozen=True)
class Source:
    """A label source: frame with ``key`` columns and ``label``; earlier sources win."""

    name: str
    frame: DataFrame
    key: str
    order: str | None = None


def _one_per_key(source: Source, out: str) -> DataFrame:
    live = source.frame.where(F.col("label").isNotNull() & F.col(source.key).isNotNull())
    pick = F.min_by("label", source.order) if source.order else F.min("label")
    return live.groupBy(source.key).agg(pick.cast("int").alias(out))


def resolve_labels(
    slides: DataFrame, strict: list[Source], coarse: list[Source]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, unresolved, overrides).

    ``strict`` sources carry the narrow positive class and win over ``coarse`` ones. Sources keyed by
    ``slide`` join on the slide; any other key (patient, sample) is shared by many slides and is
    joined with salt. An override is a slide where the coarse answer differs from the strict one.
    """
    wide, names = slides, {"strict": [], "coarse": []}
    for kind, sources in (("strict", strict), ("coarse", coarse)):
        for i, source in enumerate(sources):
            col = f"__{kind}_{i}"
            side = _one_per_key(source, col)
            if source.key == "slide":
                wide = wide.join(side, "slide", "left")
            else:
                wide = spread_join(wide, side, [source.key], "left", salt_on=["slide"])
            names[kind].append((col, source.name))

    def chosen(pairs):
        return F.coalesce(*[F.col(c) for c, _ in pairs], F.lit(None).cast("int"))

    def winner(pairs):
        return F.coalesce(*[F.when(F.col(c).isNotNull(), n) for c, n in pairs], F.lit(None).cast("string"))

    strict_label, coarse_label = chosen(names["strict"]), chosen(names["coarse"])
    everything = wide.withColumns(
        {
            "label": F.coalesce(strict_label, coarse_label),
            "source": winner(names["strict"] + names["coarse"]),
            "strict_label": strict_label,
            "coarse_label": coarse_label,
        }
    ).drop(*[c for pairs in names.values() for c, _ in pairs])
    resolved = everything.where(F.col("label").isNotNull()).withColumn("status", st.label_text(F.col("label")))
    unresolved = everything.where(F.col("label").isNull()).select(*slides.columns)
    overrides = resolved.where(F.col("strict_label") != F.col("coarse_label")).select(
        "slide", "coarse_label", "strict_label"
    )
    return resolved, unresolved, overrides


def require_labels(unresolved: DataFrame, skip_unlabeled: bool = False) -> None:
    """Stop when a slide has no label, naming a few, unless skipping was asked for."""
    if skip_unlabeled:
        return
    some = [r[0] for r in unresolved.select("slide").take(5)]
    if some:
        raise ValueError(f"slides without a label, for example {some}; allow skipping to go on without them")


def known_empty(inventory: DataFrame, parsed: DataFrame, key: str, records: str = "variants") -> DataFrame:
    """Tell "file present, no records" (wild-type) from "no file" (unknown)."""
    sizes = parsed.groupBy(key).agg(F.max(F.size(records)).alias("__n"))
    return inventory.join(sizes, key, "left").withColumn(
        "label", F.when(F.col("__n") > 0, 1).when(F.col("__n") == 0, 0).cast("int")
    ).drop("__n")
