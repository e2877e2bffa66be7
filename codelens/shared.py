"""Tables written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder in ``spark.checkpoint.dir``; it goes when the application ends.

    Only where the session names none and runs on a single machine a
    temporary one is made, once per session; elsewhere that is an error.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not given:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="codelens-")
        spark.conf.set("spark.checkpoint.dir", given)
    own = f"{given.rstrip('/')}/{sc.applicationId}"
    if getattr(sc, "_codelens_folder", None) != own:
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._codelens_folder = own
    return own


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._codelens_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``materialise`` has written, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._codelens_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """``conf`` (dots written as two underscores) for what runs inside; afterwards the session's own values hold again."""
    own = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
