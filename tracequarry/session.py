"""Session helpers: table access and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's tables, read lazily so filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoint() writes to: the session's spark.checkpoint.dir.

    Only where the setting is absent, no folder was given yet and the master is local
    (tests on one machine) is a temporary folder used; a cluster must name its own.
    """
    sc = spark.sparkContext
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not wanted and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder: executors can't use this machine's")
    sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="tracequarry-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
