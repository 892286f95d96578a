"""Small helpers of this package: word expressions, let-bindings and tables in the shared folder."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once. A plain reference inside a lambda would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidewire-')}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def remove(spark: SparkSession, name: str) -> None:
    """Deletes a folder on any Hadoop store."""
    path = _path(spark, name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_roots: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the application's own folder of the shared folder.

    That folder is deleted when the driver's JVM ends, be the session stopped by then or not; free() deletes it before.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_dir(spark)}/tidewire-{uuid.uuid4().hex}"
        path = _path(spark, _roots[app])
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{_roots[app]}/{uuid.uuid4().hex}-{name}"


def free(spark: SparkSession) -> None:
    """Deletes all that the application has written to the shared folder so far: for drivers that live long, once results are written."""
    if root := _roots.pop(spark.sparkContext.applicationId, None):
        remove(spark, root)


def keep(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := scratch(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def tidy(run):
    """A function over Arrow batches that gives free memory back to the system at its end: Spark keeps Python workers for later tasks,
    and an idle one should hold no more than its modules."""

    @functools.wraps(run)
    def tidied(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied
