"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """A zip of the package, served by the driver to every executor, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / "taktwerk_flow.zip"
    with zipfile.ZipFile(target, "w") as z:
        for part in ("__init__.py", "operators", "streaming", "functions"):
            for f in [top / part] if part.endswith(".py") else sorted((top / part).rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
