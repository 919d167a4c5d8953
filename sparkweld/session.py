"""Sessions: settings that the engine is built for, and giving executors the package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session on one machine, for tests and benchmarks. A cluster's session needs nothing from here."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkweld")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package through Spark's own file server, once a context; needed where they don't have it."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkweld_shipped", False):
        return spark
    top = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="pyfiles-")) / "sparkweld_src.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(out))
    sc._sparkweld_shipped = True
    return spark
