"""The package for the executors' Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that tasks can import it wherever they run."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = Path(tempfile.mkdtemp())  # the driver's own: executors get the file from the driver
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = folder / "tesselix.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path(package.name) / f.relative_to(package))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(application)
