"""Sessions, and the package on their executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once an application: Spark's file server hands it out."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        zipped = shutil.make_archive(f"{tempfile.mkdtemp(prefix='crease-')}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(zipped)
        _shipped.add(app)


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="crease-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the session's shared checkpoint folder; in a temporary one only in local mode (tests)."""
    return f"{_shared(spark).rstrip('/')}/{name}"


def kept(df: DataFrame) -> DataFrame:
    """Write `df` to the session's shared checkpoint folder and go on from there."""
    _shared(df.sparkSession)
    return df.checkpoint()
