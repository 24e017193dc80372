"""Spark session defaults for this library's jobs and tests.

Cluster jobs should build their own session; ``get_session`` only fills settings that
are unset: AQE with partition coalescing and skew-join splitting, UTC session zone,
Arrow for pandas exchange, no UI. ``checkpoint_dir`` reads ``spark.checkpoint.dir``
and only falls back to a scratch folder for a local-mode session without one (tests).
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import tabtrail

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "tabtrail",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        b = b.master(master or "local[8]")
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def app_key(spark: SparkSession) -> str:
    """Identity of the running Spark application (memo caches are scoped to it)."""
    return spark.sparkContext.applicationId


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir`` or one set on
    the context). Only a local-mode session (tests) without one gets a scratch folder;
    on a cluster a machine-local folder would not survive executor loss, so it is an
    error to leave the setting empty there."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster first")
    d = tempfile.mkdtemp(prefix="tabtrail-ckpt-")
    sc.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> None:
    """Make ``tabtrail`` importable in the Python workers of every executor, wherever the
    driver was started from: the package's source goes out once per application through
    ``addPyFile`` (the driver serves the zip; executors need no shared path for it)."""
    sc = spark.sparkContext
    if getattr(sc, "_tabtrail_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(tabtrail.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tabtrail-src-"), "tabtrail_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._tabtrail_shipped = True
