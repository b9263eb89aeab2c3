"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build(app: str = "apportion", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; conf overrides."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_apportion_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="apportion-")) / "apportion_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(str(path))
    sc._apportion_shipped = True
