"""Name, inventory ids, Spark function and oracle SQL of every registered query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slidegrid.session import table


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def keep(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, ids, fn, sql)
        return fn

    return keep


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


# Slides over customers: two per patient, some names that are no barcode. Spark and SQL forms.
_NAME = """CASE
  WHEN c_custkey % 10 = 7 THEN c_name || '.svs'
  WHEN c_custkey % 10 = 8 THEN 'TCGA-' || {nation} || '-X' || CAST(c_custkey AS {text})
  ELSE 'TCGA-' || {nation} || '-' || upper(substr(md5(CAST(c_custkey {div} 2 AS {text})), 1, 4)) || '-'
    || CASE WHEN c_custkey % 3 = 0 THEN '11A' ELSE '01Z' END || '-00-DX' || CAST(c_custkey % 2 + 1 AS {text})
    || '.' || substr(md5(CAST(c_custkey AS {text})), 1, 8) || '.svs' END"""
_NATION = "lpad(CAST((c_custkey {div} 2) % 25 AS {text}), 2, '0')"
NAME_SPARK = _NAME.format(nation=_NATION.format(div="div", text="STRING"), div="div", text="STRING")
NAME_SQL = _NAME.format(nation=_NATION.format(div="//", text="VARCHAR"), div="//", text="VARCHAR")
SLIDES_CTE = f"slides AS (SELECT *, {NAME_SQL} AS slide FROM customer)"


def slides(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").withColumn("slide", F.expr(NAME_SPARK))


# Scored units over events: one score and class per event; patients are users.
SCORED_CTE = (
    "scored AS (SELECT event_id, user_id, event_type, \"value\", CAST(event_type = 'purchase' AS INTEGER) AS label, "
    "round(1.0 / (1.0 + exp(-(\"value\" - 20.0) / 25.0)), 4) AS score FROM events)"
)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        F.round(1.0 / (1.0 + F.exp(-(F.col("value") - 20.0) / 25.0)), 4).alias("score"),
    )
