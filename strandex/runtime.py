"""What all parts share: the package on the executors, and tables between steps in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Adds a zip of the package's modules to the application, once, so that its Python workers can import it."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _sent:
        return
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="strandex-zip-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset a temporary folder is made and set, in local mode only; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        had = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not had.isDefined() and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = had.get() if had.isDefined() else "file://" + tempfile.mkdtemp(prefix="strandex-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: The tables that each open scratch_scope() has to delete.
_scopes: list[list[DataFrame]] = []


def scratch(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again.

    This cuts lineage and survives lost executors. The folder goes with the scratch_scope() around it, with drop(), or
    when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, store = _path(spark, path)
    store.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def scratch_scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what scratch() wrote inside it, but for tables handed to the function that it gives; those
    are left to the scope around."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.remove(made)
        for df in made:
            if not any(df is k for k in kept):
                drop(df)
        if _scopes:
            _scopes[-1].extend(kept)


def drop(df: DataFrame) -> None:
    """Deletes what scratch() wrote for df, which nothing may read any more."""
    where, store = _path(df.sparkSession, df._scratch)
    store.delete(where, True)
