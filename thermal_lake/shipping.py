"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package's sources to the workers, once for each application."""
    sc = spark.sparkContext
    home = Path(__file__).parent
    if sc.applicationId in _SHIPPED or not home.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="thermal-lake-src-")) / "thermal_lake_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
