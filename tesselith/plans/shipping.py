"""Sends the package to the workers of a session whose Python can't import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """The session, after its executors can import this package; once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        root = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="tesselith-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(target))
        _sent.add(sc.applicationId)
    return spark
