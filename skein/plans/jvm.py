"""Java of this package in the executors, for inner loops over pairs of texts: compiled on the driver with the compiler that Spark brings
along for its own code, so that neither a build nor another library is needed, and sent to the executors as a jar."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from skein.plans.cut import shared_dir


def java_class(spark: SparkSession, source: Path):
    """The class of a source file (package skein, named as the file) in the driver's JVM, compiled once a session."""
    sc = spark.sparkContext
    made = sc.__dict__.setdefault("_skein_java", {})
    if source not in made:
        text, jvm = source.read_text(), spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(text)
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for name, code in sorted(dict(compiler.getBytecodes()).items()):
                z.writestr(zipfile.ZipInfo(name.replace(".", "/") + ".class"), bytes(code))
        path = f"{shared_dir(spark)}/skein-{source.stem}-{hashlib.sha256(packed.getvalue()).hexdigest()[:16]}.jar"
        place = jvm.org.apache.hadoop.fs.Path(path)
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
        out.write(bytearray(packed.getvalue()))
        out.close()
        sc._jsc.addJar(path)
        made[source] = compiler.getClassLoader().loadClass(f"skein.{source.stem}")
    return made[source]
