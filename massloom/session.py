"""Spark sessions for the library."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster, spark-submit decides."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("massloom")
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    That does for workers on this machine or with the same path; elsewhere, install the package or give it by --py-files.
    """
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    env = spark.sparkContext.environment
    if _ROOT not in known and _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); on a local master without it, as in tests, one of
    this machine. A cluster without the setting is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        base = "file://" + tempfile.mkdtemp(prefix="massloom-")
    return base.rstrip("/")
