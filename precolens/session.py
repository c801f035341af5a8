"""Session set-up and the durable scratch area used to cut lineage."""

from __future__ import annotations

import os
import uuid
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after it has been written out and measured at or below this size.
BROADCAST_BYTES = 32 * 1024 * 1024

# Compression of stored tables: rows of texts take about 60 % of what they take by Parquet's default.
CODEC = "zstd"


def local_session(cpus: int | str = 8, app: str = "precolens") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written tables.

    A cluster names it in ``spark.checkpoint.dir``. A session without the setting uses a folder in
    its warehouse, which all executors share, too.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def importable(df: DataFrame) -> DataFrame:
    """``df``, with this package importable in Python workers of a local session; a cluster installs it."""
    root, env = str(Path(__file__).resolve().parents[1]), df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return df


# Folders of this process under the shared one, by application; ``clear_scratch`` deletes them.
_made: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{scratch_root(spark).rstrip('/')}/precolens/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this process wrote to :func:`scratch_path`; call it when no result of it is read any more.

    Returns the number of paths. Checkpoints go by themselves where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, as in :func:`local_session`.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    return len(paths)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once, so later reads survive lost executors."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for results of which later reads need parts."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=CODEC)
    return spark.read.schema(df.schema).parquet(path)


class Measured(NamedTuple):
    """A written DataFrame with its row count, and whether its measured size allows a broadcast."""

    rows: DataFrame
    count: int
    small: bool

    @property
    def side(self) -> DataFrame:
        """For a join: broadcast when small, else left to shuffle."""
        return F.broadcast(self.rows) if self.small else self.rows


def measured(df: DataFrame) -> Measured:
    """Write ``df`` once and measure it."""
    kept = durable(df)
    width = sum(
        (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in kept.columns),
        F.lit(0),
    )
    count, size = kept.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return Measured(kept, count, size <= BROADCAST_BYTES)
