"""Small files on the file system of a path, from the driver: records, never rows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, p, p.getFileSystem(conf)


def create_only(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, or not at all: False where it is there already. The text is
    written aside and renamed without overwriting (in a local folder: linked), which one of
    several writers can do."""
    jvm, conf, target, fs = _file_system(spark, path)
    if fs.getUri().getScheme() == "file":
        return _linked(str(target.toUri().getPath()), text)
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), no_options)
        return True
    except Exception:
        if fs.exists(target):
            return False
        raise
    finally:
        if fs.exists(aside):
            fs.delete(aside, False)


def _linked(path: str, text: str) -> bool:
    folder = os.path.dirname(path)
    os.makedirs(folder, exist_ok=True)
    aside = os.path.join(folder, f".{uuid.uuid4().hex}")
    with open(aside, "w", encoding="utf-8") as f:
        f.write(text)
    try:
        os.link(aside, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(aside)


def exists(spark: SparkSession, path: str) -> bool:
    _, _, p, fs = _file_system(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    jvm, _, p, fs = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder, in order; none where there is no folder."""
    _, _, p, fs = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    _, _, p, fs = _file_system(spark, path)
    fs.delete(p, True)
