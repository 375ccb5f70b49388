"""Tables written between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; set here only where it is unset and Spark runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="hearthline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Removes the shuffle files of an execution once it is over; otherwise they stay until the driver happens to collect garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def released(spark: SparkSession):
    """What is shuffled for a write in here is removed once it is written."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df and reads it back, so that several readers compute it once and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    """(path, its file system)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target, files = _path(spark, path)
    files.delete(target, True)


def escaped(value: str) -> str:
    """A value as it stands in the name of a partition's folder."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^" or ord(c) < 32 or ord(c) == 127 else c for c in value)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, once all that was derived from them is written itself."""
    for df in tables:
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            remove(df.sparkSession, path)
