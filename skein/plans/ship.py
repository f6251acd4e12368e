"""Sending this package to the executors, whose Python workers may not find it on their own path."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from skein.plans.cut import shared_dir


def ship(spark: SparkSession) -> None:
    """Once a session: zip the package into the shared folder and add it to the workers' path."""
    sc = spark.sparkContext
    if getattr(sc, "_skein_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(file.relative_to(root.parent))), file.read_bytes())
    raw = packed.getvalue()
    path = f"{shared_dir(spark)}/skein-{hashlib.sha256(raw).hexdigest()[:16]}.zip"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(raw))
    out.close()
    sc.addPyFile(path)
    sc._skein_shipped = True
