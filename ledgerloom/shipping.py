"""Puts this package on the Python path of the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".json", ".csv"):
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._ledgerloom_shipped = True
