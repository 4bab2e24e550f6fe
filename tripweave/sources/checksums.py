"""SHA-256 integrity records for raw files of any size.

Spark lists paths and lengths; the bytes are read by the tasks themselves, a megabyte at a time, so no file is ever a row. A SHA-256 of a whole file is
sequential and thus one task's work. For large files there is a digest tree beside it: digests of byte ranges, each a task's row, and a root
over them in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripweave.sources.storage import exists

#: Bytes read at once, and bytes of a range.
BLOCK_BYTES, RANGE_BYTES = 1 << 20, 64 << 20
#: Tasks at most that ranges are dealt to.
MAX_TASKS = 10_000


def _relative(path: str) -> Column:
    """File path below the raw folder."""
    root = path.rstrip("/").split(":", 1)[-1].rsplit("/", 1)[-1]
    return F.regexp_replace(F.regexp_extract("path", f"/{root}/(.*)$", 1), "%20", " ")


def _open(uri: str):
    """A file for reading at any place, local or in a store that pyarrow knows."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path))
    store, name = fs.FileSystem.from_uri(uri)
    return store.open_input_file(name)


def range_digest(uri: str, offset: int, length: int) -> str:
    """SHA-256 of ``length`` bytes from ``offset`` on, in fixed memory."""
    whole = sha256()
    with _open(uri) as file:
        file.seek(offset)
        while length > 0:
            block = file.read(min(length, BLOCK_BYTES))
            if not block:
                raise EOFError(f"{uri} ends before it should")
            whole.update(block)
            length -= len(block)
    return whole.hexdigest()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``file`` (below the folder) and ``length`` of every raw file; the bytes are not read. Spark passes over empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.withColumn("file", _relative(path)).filter(~F.col("file").rlike(r"(^|/)[_.]"))


def _digested(rows: DataFrame) -> DataFrame:
    """``digest`` of the bytes that each row (path, file, start, size, length) names."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [range_digest(r["path"], r["start"], r["size"]) for r in batch.to_pylist()]
            columns = [batch.column(c) for c in ("file", "start", "length")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], ["file", "start", "length", "digest"])

    return rows.select("path", "file", "start", "size", "length").mapInArrow(digests, "file string, start bigint, length bigint, digest string")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``digest`` and ``length`` of every raw file. A task reads the files that Spark deals to it by their size."""
    whole = listed(spark, path).select("*", F.lit(0).cast("long").alias("start"), F.col("length").alias("size"))
    return _digested(whole).select("file", "digest", "length")


def tree_digests(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file``, ``length`` and ``root``: the SHA-256 over the hexadecimal digests of the file's ranges, in order; a file's ranges are spread over tasks."""
    files = listed(spark, path)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = files.select("*", F.explode(starts).alias("start"))
    ranges = ranges.withColumn("size", F.least(F.lit(range_bytes).cast("long"), F.col("length") - F.col("start")))
    tasks = files.agg(F.sum(F.ceil(F.greatest("length", F.lit(1)) / range_bytes))).first()[0] or 1
    # a number, or the few bytes of these rows would be packed into one task
    spread = ranges.repartition(int(min(MAX_TASKS, tasks)), "path", "start")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("start", "digest"))), lambda x: x["digest"])
    return _digested(spread).groupBy("file", "length").agg(F.sha2(F.array_join(in_order, ""), 256).alias("root"))


def write_tree_digests(spark: SparkSession, path: str, out: str, range_bytes: int = RANGE_BYTES) -> None:
    rows = tree_digests(spark, path, range_bytes).withColumn("range_bytes", F.lit(range_bytes).cast("long"))
    rows.write.mode("overwrite").parquet(out)


def verify_tree_digests(spark: SparkSession, path: str, recorded: str) -> DataFrame:
    """OK, FAIL or MISSING for every raw file, by the digest trees recorded for them."""
    known = spark.read.parquet(recorded)
    first = known.select("range_bytes").first()
    actual = tree_digests(spark, path, first[0] if first else RANGE_BYTES)
    both = actual.join(known.select("file", F.col("root").alias("expected")), "file", "left")
    status = F.when(F.col("expected").isNull(), "MISSING").when(F.col("expected") == F.col("root"), "OK").otherwise("FAIL")
    return both.select("file", status.alias("status"))


def write_checksums(spark: SparkSession, path: str, checksum_path: str) -> None:
    """Write ``<digest>  <file>`` lines, the format ``sha256sum -c`` reads."""
    digests = file_digests(spark, path)
    digests.select(F.concat_ws("  ", "digest", "file").alias("value")).write.mode("overwrite").text(checksum_path)


def verify_checksums(spark: SparkSession, path: str, checksum_path: str) -> DataFrame:
    """OK, FAIL or MISSING (no recorded digest) for every raw file."""
    actual = file_digests(spark, path)
    lines = (
        spark.read.text(checksum_path) if exists(spark, checksum_path) else spark.createDataFrame([], "value string")
    )
    recorded = lines.select(
        F.regexp_extract("value", r"^([0-9a-f]+)  (.*)$", 2).alias("file"),
        F.regexp_extract("value", r"^([0-9a-f]+)  (.*)$", 1).alias("expected"),
    )
    status = (
        F.when(F.col("expected").isNull(), "MISSING").when(F.col("expected") == F.col("digest"), "OK").otherwise("FAIL")
    )
    return actual.join(recorded, "file", "left").select("file", status.alias("status"))


def checksum_totals(verified: DataFrame) -> DataFrame:
    return verified.groupBy("status").agg(F.count("*").alias("files"))
