"""Session settings the audit relies on.

A cluster brings its own session; ``tune`` only touches runtime SQL settings
and leaves anything the cluster has set on purpose.  The checkpoint folder is
always the one the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed sort-merge join is worth one more exchange above it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


_FORCE = "spark.sql.adaptive.forceOptimizeSkewedJoin"


def local_session(app: str = "sievework", cores: str = "8", **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
    )
    for key, value in {**_SQL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings above that the session's creator has not given."""
    given = spark.sparkContext.getConf()
    for key, value in _SQL_DEFAULTS.items():
        if not given.contains(key) and spark.conf.get(key) != "false":
            spark.conf.set(key, value)
    if not given.contains(_FORCE):  # off unless set, so "off" says nothing about anybody's wish
        spark.conf.set(_FORCE, "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only when unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="run-ckpt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written_table(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read back.

    For results several jobs start from: columns are pruned on each read, and
    nothing has to be recomputed when executors are lost.
    """
    spark = df.sparkSession
    target = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return spark.read.parquet(target)
