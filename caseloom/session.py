"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Adaptive execution splits skewed join partitions and merges small ones at run time.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Times here have no zone; in any zone with clock changes Spark would shift some of them.
    "spark.sql.session.timeZone": "UTC",
}


# Bytes of input per shuffle partition; a partition has to fit an executor's share of memory.
PARTITION_BYTES = 128 * 1024 * 1024


def tune(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Switch on the adaptive features and the time zone the operators rely on.

    With the size of the input, shuffles also get enough partitions for it; adaptive
    execution merges those that turn out small.
    """
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    if input_bytes is not None:
        wanted = -(-input_bytes // PARTITION_BYTES)
        if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return spark


@contextmanager
def joined_where_dealt(spark: SparkSession) -> Iterator[None]:
    """Tables dealt by some of the keys of a join are joined as they lie, for what runs inside.

    Only for keys none of which has very many rows.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scratch_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a local master may fall back to a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="caseloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
