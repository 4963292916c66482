"""Sends the package to executors that can't import it."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package as a zip through Spark's own file server, unless PYTHONPATH leads to it."""
    app = spark.sparkContext.applicationId
    if app in _sent or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "tessera.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted((ROOT / "tessera").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
        kept = Path(tempfile.gettempdir(), f"tessera-{app}.zip")
        path.replace(kept)
    # Spark serves it from there as long as the application lives
    atexit.register(kept.unlink, missing_ok=True)
    spark.sparkContext.addPyFile(str(kept))
    _sent.add(app)
