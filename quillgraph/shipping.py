"""Makes the package importable in Python workers that do not see its folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the application's Python files, once, unless PYTHONPATH has it for the workers."""
    context = spark.sparkContext
    root = os.path.dirname(_PACKAGE)
    known = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if root in known or context.applicationId in _SENT or not os.path.isdir(_PACKAGE):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="quillgraph-"), "quillgraph.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    _SENT.add(context.applicationId)
    return spark
