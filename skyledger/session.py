"""Session settings and the shared working folder."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_sequence = itertools.count()
_run_id = uuid.uuid4().hex[:12]
_local_fallback: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs rely on; safe to call on a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # state beyond the heap
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    A session whose driver and executors are one process (``local[n]``) may leave it
    unset and gets a temporary folder; on a cluster that is an error, because each
    executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir names no shared folder; {master} needs one that every executor can reach")
    if not _local_fallback:
        _local_fallback.append(tempfile.mkdtemp(prefix="skyledger-"))
    return _local_fallback[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else has used."""
    return f"{shared_root(spark)}/skyledger-{_run_id}/{next(_sequence):04d}-{label}"
