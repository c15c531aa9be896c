"""Making the package known to a session's Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the workers of this session, once per application.

    Workers import the package by name; on a cluster, or where the driver only has it on its own path, they
    would not find it otherwise.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="codegrain-code-")) / "codegrain.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(_ROOT.rglob("*.py")):
            z.write(file, Path("codegrain") / file.relative_to(_ROOT))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
