"""Cutting lineage in the folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..operators.errors import AnalysisError


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where the session names none and runs in one JVM, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise AnalysisError("no_checkpoint_folder", "on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spindlestat-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into checkpoint_folder()."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
