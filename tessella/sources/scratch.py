"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_kept: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where the setting is missing, a folder inside the
    warehouse, which they share as well; a temporary one only if driver and executors are one local process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.applicationId not in _own_folder:
        alone = context.master == "local" or context.master.startswith("local[")
        own = tempfile.mkdtemp(prefix="tessella-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tessella-{uuid.uuid4().hex}"
        _own_folder[context.applicationId] = own
    return _own_folder[context.applicationId]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage, survives the loss of executors and gives each later reader the very same rows,
    also where partition numbers or samples went into them.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for scope in _kept:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove on leaving what was written inside: for steps whose result is stored elsewhere by then."""
    scope: list[str] = []
    _kept.append(scope)
    try:
        yield
    finally:
        _kept.remove(scope)
        for path in scope:
            remove(spark, path)
