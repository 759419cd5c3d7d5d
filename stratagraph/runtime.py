"""Session helpers: checkpoints in the shared folder, inputs, size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it. Does nothing on a cluster that ships or
    installs it; there the path simply isn't found."""
    home, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (home, env.get("PYTHONPATH", ""))))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession) -> str:
    """A new folder for tables of this run, in the checkpoint folder; what is left there goes with it."""
    return f"{checkpoint_folder(spark)}/work/{uuid.uuid4().hex}"


def tabled(df: DataFrame) -> DataFrame:
    """As `cut`, by a table of the work folder: smaller where values repeat, and later plans take over no constraints of this
    one, which a checkpoint hands on and which double round by round where each round joins the one before."""
    folder = work_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def joins_by_size(spark: SparkSession) -> None:
    """From now on this session broadcasts a side of a join by its measured size, or by a hint, and not by the planner's guess:
    it can't know how large the rows are that a Python function makes, takes them for the input's compressed size, and would
    send gigabytes through the driver. AQE measures a side when it is shuffled, and broadcasts it below the same limit."""
    guess, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if (limit := spark.conf.get(guess)) != "-1":
        spark.conf.set(measured, spark.conf.get(measured, None) or limit)
        spark.conf.set(guess, "-1")


@contextmanager
def small_splits(spark: SparkSession, size: str = "16m") -> Iterator[None]:
    """Within it files and shuffles are read by tasks of this size, so that a task that makes wide rows of narrow ones can sort
    them in memory."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, size)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit: int) -> bool:
    """Whether df has at most `limit` rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """A broadcast hint behind a row count, else the frame as it is."""
    return F.broadcast(df) if small(df, limit) else df
