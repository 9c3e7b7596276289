"""Reading the driver's tables and writing intermediate ones."""

from __future__ import annotations

import tempfile
import threading
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_MADE: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SETTING = threading.RLock()
#: Where each table of materialise lies, for forget(), as long as its frame lives.
_PLACE: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one all executors share, gone when the driver's JVM ends. A root of our own only
    where the session names none and runs on one machine (tests, a laptop)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="rosterlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/rosterlake-{spark.sparkContext.applicationId}"
    if path not in _MADE:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(jvm_path)
        fs.deleteOnExit(jvm_path)
        _MADE.add(path)
    return path


def materialise(df: DataFrame, tag: str = "part") -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there, so a lost executor costs
    one re-read and not a re-run. The shuffle files of the query that wrote it go as soon as it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _SETTING:  # one thread's write at a time sets and unsets it
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACE[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that materialise made and nothing reads any more, before the application ends."""
    for t in tables:
        if path := _PLACE.pop(t, None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
