"""Paths on the cluster's shared file system."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a ``local[..]`` session, which has one machine, may go without and gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tripweave-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tripweave/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, and the planner knows its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for frame in frames:
        for path in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            fs, p = _fs_path(frame.sparkSession, path)
            fs.delete(p, True)


def _fs_path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A few bytes beside a table, replaced if there."""
    fs, p = _fs_path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    text = bytes(b & 0xFF for b in stream.readAllBytes()).decode()
    stream.close()
    return text


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a first-level ``column=value`` partition, by directory listing only."""
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(p) if status.isDirectory()]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


def drop_partition(spark: SparkSession, path: str, column: str, value: str) -> None:
    fs, p = _fs_path(spark, f"{path}/{column}={value}")
    fs.delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no folder."""
    fs, p = _fs_path(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(p)) if fs.exists(p) else []


def rename(spark: SparkSession, source: str, target: str) -> bool:
    fs, p = _fs_path(spark, source)
    return fs.rename(p, _fs_path(spark, target)[1])


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs_path(spark, path)
    fs.delete(p, True)
