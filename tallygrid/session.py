"""Session helpers: the shared checkpoint folder and frames frozen in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Use the checkpoint folder the cluster names, and UTC for typed timestamps."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[|$)", context.master):  # executors in other processes share no temporary folder
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tallygrid-")
        context.setCheckpointDir(folder)
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once; later reads see exactly those rows.

    Used wherever a value depends on how rows fell into partitions, so that a lost
    executor cannot lead to a second, different evaluation.
    """
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


_stored: dict[str, list[str]] = {}


def store(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a parquet table in the checkpoint folder and read it back.

    Like :func:`freeze`, for frames that are read by column or partition more than once:
    parsed sources, whose row keys depend on how the source was split into tasks, and ranks.
    """
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> int:
    """Delete the tables that :func:`store` wrote for this application; returns how many.

    Frames and profiles built on them can no longer be used. Checkpoints are removed by
    Spark itself if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    paths = _stored.pop(spark.sparkContext.applicationId, [])
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(paths)
