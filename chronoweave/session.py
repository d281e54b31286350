"""Make the package importable on executors, whether or not it is installed there."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each application. Workers of a local master share the driver's
    PYTHONPATH, so they may have it already; what executors of a cluster have is not known here."""
    app = spark.sparkContext.applicationId
    here = str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if app in _shipped or (here and spark.sparkContext.master.startswith("local")):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "chronoweave_src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    path = list(sys.path)
    spark.sparkContext.addPyFile(str(archive))
    sys.path[:] = path
    _shipped.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir, which a cluster's executors share. Where that is unset, a local master gets a
    temporary folder and a cluster an error, as its machines share none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(folder or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{uuid.uuid4().hex}"
