"""Bring this package to Python workers that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Serve the package's sources to the workers of a session, once; a driver may have it on its path alone."""
    sc = spark.sparkContext
    if getattr(sc, "_helixsieve_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="helixsieve-")) / "helixsieve_sources.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(at))
    sc._helixsieve_shipped = True
