"""Session set-up and the few settings the operators read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "slidegrid", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prefix_buckets(spark: SparkSession) -> int:
    """How many order buckets a prefix sum uses: a few per shuffle partition, 16 to 4096."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(16, min(4096, 4 * parts))


def salt_count(spark: SparkSession) -> int:
    """How many pieces a possibly hot key is dealt into."""
    return int(spark.conf.get("spark.slidegrid.salts", "8"))


def hot_rows(spark: SparkSession) -> int:
    """From how many rows on a join key counts as hot."""
    return int(spark.conf.get("spark.slidegrid.hotRows", "1000000"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an iterative result.

    The folder comes from the cluster's ``spark.checkpoint.dir``; only where that is unset and the
    master is local (a test) a temporary folder is chosen.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set once."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder name on the same shared storage."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")
