"""Session helpers: code shipping, the shared scratch folder and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_FALLBACK = "file:///tmp/checkpoints"
_LEFT_AT_EXIT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per Spark application."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="scriptorium"), f"scriptorium-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or _FALLBACK).rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scriptorium/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    own = _own_dir(spark)
    if own.startswith(_FALLBACK) and own not in _LEFT_AT_EXIT:  # tests: nothing stays behind
        _LEFT_AT_EXIT.add(own)
        atexit.register(shutil.rmtree, own.removeprefix("file://"), ignore_errors=True)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def clean(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that were not written yet may still need them."""
    remove(spark, _own_dir(spark))


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer, so that any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
