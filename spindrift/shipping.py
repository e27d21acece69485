"""Gives the executors this package, once per session: their Python may not see the driver's folders."""

from __future__ import annotations

import atexit
import os
import pathlib
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    sc = spark.sparkContext
    if not getattr(sc, "_spindrift_shipped", False):
        root = pathlib.Path(__file__).resolve().parent
        # the driver's file server reads it as executors ask for it, so it stays until the driver ends
        folder = tempfile.mkdtemp(prefix="spindrift-")
        atexit.register(shutil.rmtree, folder, True)
        path = f"{folder}/spindrift_package.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        sc.addPyFile(os.path.realpath(path))
        sc._spindrift_shipped = True
    return spark
