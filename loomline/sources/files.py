"""Small files in the shared folder, through Hadoop's file system classes (any scheme Spark can write to)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def swap_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace the file in one step: readers see the old text or the new one, never a part."""
    jvm = spark._jvm
    p, fs = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(path + ".next")
    fs.mkdirs(p.getParent())
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context.rename(tmp, p, how)


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file with its whole text in one step; False, and nothing changes, if it is there already."""
    jvm = spark._jvm
    p, fs = _fs(spark, path)
    fs.mkdirs(p.getParent())
    tmp = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        context.rename(tmp, p, how)
    except Exception:
        fs.delete(tmp, False)
        if fs.exists(p):
            return False
        raise
    return True


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder that aren't hidden; none if it isn't there."""
    p, fs = _fs(spark, path)
    return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(p)) if n[0] != ".") if fs.exists(p) else []


def move(spark: SparkSession, path: str, target: str) -> None:
    p, fs = _fs(spark, path)
    t = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(t.getParent())
    if not fs.rename(p, t):
        raise OSError(f"{path} can't be moved to {target}")


def set_time(spark: SparkSession, path: str, millis: int) -> None:
    """Set the time of last change, where the file system keeps it."""
    p, fs = _fs(spark, path)
    fs.setTimes(p, millis, -1)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.getFileStatus(p).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all in it; nothing happens if it isn't there."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)
