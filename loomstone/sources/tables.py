"""Tables written in a shared folder, which cut the lineage of what iterates and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a write as soon as it ends, where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Without it only a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="ckpt-")
    return _own[app]


def filesystem(spark: SparkSession, name: str):
    """A Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


class Scratch:
    """Tables below one folder of the shared one, which cut lineage.

    drop() removes tables that nothing reads any more, at once; what is left goes when the session's JVM ends, since
    results still read it. Shuffle files of a write are removed when it ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.at: dict[int, tuple[DataFrame, str]] = {}
        path, fs = filesystem(spark, self.folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def cut(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        name = f"{self.folder}/{uuid.uuid4().hex[:12]}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            # numbers are written as they are: keys and hashes don't shrink, and codecs hold buffers outside the heap
            texts = any(kind in t for _, t in df.dtypes for kind in ("string", "binary"))
            (df.write if texts else df.write.option("compression", "none")).parquet(name)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(name)
        self.at[id(out)] = (out, name)
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for f in frames:
            _, name = self.at.pop(id(f), (None, None))
            if name:
                path, fs = filesystem(self.spark, name)
                fs.delete(path, True)
