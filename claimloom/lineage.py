"""Cutting lineage so that a lost executor costs one stage, not the whole job."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def checkpoint_dir(df: DataFrame) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, a single-machine session gets a folder of its own, removed at its end; on a cluster that is an error, as executors share no such folder."""
    context = df.sparkSession.sparkContext
    now = context.getCheckpointDir()
    if now is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="claimloom-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
        now = context.getCheckpointDir()
    return now


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    checkpoint_dir(df)
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> DataFrame:
    """``df`` as a plan of its own, to be run once: its shuffle files go as soon as it has run, not when the driver happens to collect garbage (since Spark 4.1; earlier ones ignore the setting)."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return df.select("*")  # a plan takes the setting when it is made
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
