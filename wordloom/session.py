"""Session defaults and the few helpers every plan shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session built here. A cluster's own session is used as it is.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**DEFAULTS, **extra}.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package known to the session's Python workers, once a session: Spark's own
    file server hands them a zip of it, whatever folder they run in. Not needed, but
    harmless, where the package is installed on all machines."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        # Spark serves the zip from the driver as long as the session lasts.
        d = tempfile.mkdtemp(prefix="ship-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        shutil.copytree(here, os.path.join(d, "lib", os.path.basename(here)), ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(d, os.path.basename(here)), "zip", os.path.join(d, "lib")))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder the cluster names in spark.checkpoint.dir. Only a local session
    may leave it unset: it takes a temporary folder of its one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and stored reliably, so that lost executors don't lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
