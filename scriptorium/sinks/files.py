"""Small files that are replaced whole, and deletes that can't leave their root, through Hadoop's file systems (SNK-06, SNK-09)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from scriptorium.session import remove


def _hadoop(spark: SparkSession, path: str):
    """(the path, its file system, the configuration)."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    conf = context._jsc.hadoopConfiguration()
    files = where.getFileSystem(conf)
    # The local file system keeps checksums in files of their own, which no rename replaces together with the file.
    return where, files.getRaw() if files.getUri().getScheme() == "file" else files, conf


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file aside, under a name that starts with a point, and rename it over the old one: readers see the old text or the new one, whole.

    The rename is one step of the file system where that has one (local folders, HDFS); object stores put a whole object in place anyway.
    """
    where, files, conf = _hadoop(spark, path)
    jvm = spark.sparkContext._jvm
    aside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}.tmp")
    try:
        out = files.create(aside, True)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()
        _replace(spark, aside, where, conf, files)
    except BaseException:
        files.delete(aside, False)
        raise


def _replace(spark: SparkSession, source, target, conf, files) -> None:
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    if files.getUri().getScheme() == "file":  # its rename deletes what is there first
        kinds = array(jvm.java.nio.file.CopyOption, 1)
        kinds[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
        jvm.java.nio.file.Files.move(files.pathToFile(source).toPath(), files.pathToFile(target).toPath(), kinds)
    else:
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        kinds = array(rename, 1)
        kinds[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(source, target, kinds)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, null where there is none."""
    where, files, _ = _hadoop(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=1))


def read_json(spark: SparkSession, path: str, default=None):
    """What a JSON file holds; the default where there is none, or where it holds no JSON."""
    raw = read_text(spark, path)
    try:
        return default if raw is None else json.loads(raw)
    except ValueError:
        return default


def drop_within(spark: SparkSession, root: str, *parts: str) -> None:
    """Delete what lies under a root by the names of its folders; names that are blank, go up, or have separators in them are refused, so the root itself is never deleted."""
    if not parts or any(not p.strip() or p in (".", "..") or set(p) & set("/\\\0") for p in parts):
        raise ValueError(f"not under {root}: {parts!r}")
    remove(spark, "/".join([root.rstrip("/"), *parts]))
