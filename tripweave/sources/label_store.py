"""The label store as a log-structured merge table: a base, deltas on top of it, and a manifest per version that one rename publishes.

Deltas are of two kinds. Label deltas hold new labels. Move deltas rename trips: each row is a tombstone for the labels of an old trip id that
earlier parts hold, and the id under which they live on. Nothing stored is rewritten until ``merge_labels`` folds the parts into a new base of
live labels. Readers fold the parts in order; runs of label deltas are one scan, and a move delta is one join on the trip key.

A job that fails before the rename changes nothing. There is one writer at a time; a second one finds its version taken and fails. The parts of the
last ``KEEP`` versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripweave.config import ENTITY
from tripweave.operators.labels import latest_labels, migration_map
from tripweave.schema import LABELS
from tripweave.sources.snapshots import KEEP, publish, versions
from tripweave.sources.storage import delete, list_names, read_text

#: Move deltas on a base, each one join of a reader, after which a writer merges.
MERGE_AT = 8


def _manifest(path: str, version: int) -> str:
    return f"{path}/_manifest/{version:012d}.json"


def _parts(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[list[str]]]:
    """Version, and its (kind, folder) parts from the base on."""
    have = versions(spark, path)
    if version is None:
        version = have[-1] if have else 0
    elif version not in have:
        raise ValueError(f"there is no version {version} of {path}")
    return version, json.loads(read_text(spark, _manifest(path, version)) or "[]") if version else []


def _commit(spark: SparkSession, path: str, version: int, parts: list[list[str]]) -> int:
    publish(spark, path, version + 1, json.dumps(parts))
    have = versions(spark, path)
    kept, old = have[-KEEP:], have[:-KEEP]
    if old:
        live = {folder for v in kept for _, folder in _parts(spark, path, v)[1]}
        for v in old:
            delete(spark, _manifest(path, v))
        for name in list_names(spark, path):
            # a folder of a later version belongs to a write under way
            if name.startswith("v=") and name not in live and int(name[2:].split("-")[0]) <= kept[-1]:
                delete(spark, f"{path}/{name}")
    return version + 1


def _add(frame: DataFrame, path: str, kind: str) -> int:
    spark = frame.sparkSession
    version, parts = _parts(spark, path)
    folder = f"v={version + 1}-{uuid.uuid4().hex[:8]}"
    frame.write.parquet(f"{path}/{folder}")
    return _commit(spark, path, version, [*parts, [kind, folder]])


def put_labels(new: DataFrame, path: str, now: Column | None = None) -> int:
    """Add labels, with optional notes and stamped with the current time unless given; returns the version."""
    defaults = {"notes": F.lit(""), "labeled_at": F.current_timestamp() if now is None else now}
    new = new.withColumns({c: v for c, v in defaults.items() if c not in new.columns})
    return _add(new.select(*[F.col(f.name).cast(f.dataType) for f in LABELS]), path, "labels")


def _renamed(log: DataFrame, moves: DataFrame, entity: Sequence[str]) -> DataFrame:
    target = moves.select(*entity, F.col("old_id").alias("commute_id"), "new_id")
    moved = log.join(target, [*entity, "commute_id"], "left")
    return moved.withColumn("commute_id", F.coalesce("new_id", "commute_id")).select(*log.columns)


def stored_labels(spark: SparkSession, path: str, version: int | None = None, entity: Sequence[str] = ENTITY) -> DataFrame:
    """The label log of a version, the newest unless given; empty where there is none. Read it through ``latest_labels``."""
    _, parts = _parts(spark, path, version)
    log = None
    for kind, run in groupby(parts, key=lambda part: part[0]):
        folders = [f"{path}/{folder}" for _, folder in run]
        if kind == "moves":  # the moves of one rename do not feed each other, those of the next one do
            for folder in folders:
                log = _renamed(log, spark.read.parquet(folder), entity) if log is not None else None
        else:
            read = spark.read.schema(LABELS).parquet(*folders)
            log = read if log is None else log.unionByName(read)
    return spark.createDataFrame([], LABELS) if log is None else log


def migrate_stored(spark: SparkSession, path: str, trips: DataFrame, entity: Sequence[str] = ENTITY) -> int:
    """Store the renames of labels whose trip is gone; returns the version, the same one if nothing moves."""
    version, parts = _parts(spark, path)
    if not parts:
        return version
    moves = migration_map(stored_labels(spark, path, entity=entity), trips, entity)
    folder = f"v={version + 1}-{uuid.uuid4().hex[:8]}"
    moves.write.parquet(f"{path}/{folder}")
    if spark.read.parquet(f"{path}/{folder}").isEmpty():
        delete(spark, f"{path}/{folder}")
        return version
    version = _commit(spark, path, version, [*parts, ["moves", folder]])
    return merge_labels(spark, path, entity) if sum(kind == "moves" for kind, _ in parts) + 1 >= MERGE_AT else version


def merge_labels(spark: SparkSession, path: str, entity: Sequence[str] = ENTITY) -> int:
    """Fold all parts into a base of the live labels alone."""
    version, parts = _parts(spark, path)
    if not parts:
        return version
    folder = f"v={version + 1}-{uuid.uuid4().hex[:8]}"
    latest_labels(stored_labels(spark, path, entity=entity), entity).write.parquet(f"{path}/{folder}")
    return _commit(spark, path, version, [["labels", folder]])
