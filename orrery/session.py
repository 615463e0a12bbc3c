"""Session helpers shared by the driver entry point, the bench and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build(cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library expects (ANSI and AQE stay on)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("orrery")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers started from a source checkout import this package.

    On a cluster the package is installed or sent with ``--py-files``; the path
    added here is then simply not found.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder serves a local session; on a cluster its absence is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base and sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="orrery-")
    return f"{base or _local[sc.applicationId]}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends here,
    and no lost executor makes it be computed again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_join(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the data. Sizes are guessed from files, and columns of
    few values are small there: such a side would be broadcast, whole, through the driver."""
    return df.hint("merge")


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt to tasks of about ``rows`` rows, and to all cores at least: a small file is one
    task, however much is done with each of its rows. Give it few and narrow columns."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks)
