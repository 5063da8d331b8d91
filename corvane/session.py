"""A session with the settings that the engine's semantics need."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(name: str = "corvane", **settings: str) -> SparkSession:
    """The session of this process; ``settings`` come on top, with dots as double underscores."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="corvane-written-")
    atexit.register(shutil.rmtree, path, True)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the folder that driver and executors share (``spark.checkpoint.dir``), read again: what uses it
    several times computes it once, with a short plan, and a lost executor costs a read. Only a local session without
    that setting uses a folder of its own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
