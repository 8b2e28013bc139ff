"""Sends the package's sources to Python workers, once for a context, so that they can import it wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if getattr(context, "_meridian_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # else it came as an archive itself
        archive = Path(tempfile.mkdtemp(prefix="sources-")) / "meridian_sources.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(archive))
        atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    context._meridian_shipped = True
