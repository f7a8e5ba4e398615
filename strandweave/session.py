"""Making the package importable in Spark's Python workers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's sources to the workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_strandweave_shipped", False):
        return spark
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, Path(PACKAGE.name) / path.relative_to(PACKAGE))
    with tempfile.NamedTemporaryFile(prefix="strandweave-", suffix=".zip", delete=False) as out:
        out.write(sink.getvalue())
    sc.addPyFile(out.name)
    sc._strandweave_shipped = True
    return spark
