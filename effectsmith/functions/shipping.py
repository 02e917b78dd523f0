"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shipped(spark: SparkSession) -> SparkSession:
    """Adds the package's source, zipped, to the session's Python files; once a session."""
    context = spark.sparkContext
    if getattr(context, "_effectsmith_shipped", False):
        return spark
    root = Path(__file__).resolve().parent.parent
    if root.is_dir():  # not already inside an archive
        target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "effectsmith.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        context.addPyFile(target)
    context._effectsmith_shipped = True
    return spark
