"""Sending this package to Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Let the Python workers of a session import this package; once for each application."""
    spark = spark or SparkSession.active()
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp()  # on the driver alone, which serves the archive as long as it runs
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder) / "tessella_library.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
