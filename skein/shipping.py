"""Makes this package importable for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Sends the package along with the application, unless workers find it by PYTHONPATH or by a local session's folder."""
    context = spark.sparkContext
    if getattr(context, "_skein_shipped", False):
        return
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known and not (context.master.startswith("local[") and Path.cwd() == ROOT):
        path = Path(tempfile.mkdtemp(prefix="skein-")) / "skein.zip"
        with zipfile.ZipFile(path, "w") as archive:
            for file in [*sorted((ROOT / "skein").rglob("*.py")), *sorted(ROOT.glob("corpus_pipeline.py"))]:
                archive.write(file, file.relative_to(ROOT))
        context.addPyFile(str(path))
    context._skein_shipped = True
