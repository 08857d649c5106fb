"""Sessions, and the package's own code on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("corvane")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package: once per context, a zip of its sources goes through Spark's file server."""
    context = spark.sparkContext
    if getattr(context, "_corvane_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="corvane-")) / "corvane_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._corvane_shipped = True
