"""A session with the settings that results depend on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "codelens", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans and Arrow; ``conf`` comes on top (dots written as two underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Bytes of a batch that goes to a Python worker, about; Spark's own bound, 64 MB, counts several times in worker and executor.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def ship(spark: SparkSession) -> None:
    """Lets executors import this package where it isn't installed: it is sent once to each, as a zip of its sources.

    Python workers get small batches from then on, unless the session was started with a size for them.
    """
    sc = spark.sparkContext
    if not sc.getConf().contains(BATCH[0]):
        spark.conf.set(*BATCH)
    if getattr(sc, "_codelens_shipped", False):
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="codelens-")) / "codelens.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._codelens_shipped = True
