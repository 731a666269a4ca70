"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they start.

    Nothing is sent where the workers' PYTHONPATH has the package already.
    """
    root = Path(__file__).resolve().parent.parent
    on_path = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if root in on_path or app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="engram-ship-")) / "engram.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.glob("engram/**/*.py")):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
