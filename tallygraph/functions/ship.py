"""Sends this library to the Python workers, once per application."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import tallygraph

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Workers import the library from an archive that Spark hands out, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    home = Path(tallygraph.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tallygraph-")) / "tallygraph.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(home.rglob("*.py")):
            out.write(path, path.relative_to(home.parent))
    context.addPyFile(str(archive))
