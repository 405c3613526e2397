"""Cutting lineage in a place that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the folder of ``spark.checkpoint.dir``; where that is unset a local session (as in tests) gets one of its own, a cluster an error."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spanwise-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """The frame in at least ``per_core`` partitions a core, for work that costs far more than a shuffle of its input.

    A large table has more partitions than that and passes untouched; only a plan without exchanges is looked at,
    as counting the partitions of another would run its stages.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().sparkPlan().toString():
        return df
    return df.repartition(want) if df._jdf.queryExecution().toRdd().getNumPartitions() < want else df
