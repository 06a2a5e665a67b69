"""File-system questions the sources ask before they read: what is there, which number is free; and small files."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob names anything. Errors of the file system are raised, not read as "no"."""
    p, fs = _path(spark, pattern)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; not the files that :func:`put` is just writing."""
    return [n for n, _ in aged(spark, folder)]


def aged(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """(name, time of the last change in seconds) of what a folder holds."""
    p, fs = _path(spark, folder)
    found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(p)] if fs.exists(p) else []
    return [(n, t) for n, t in found if not n.startswith(".")]


def size(spark: SparkSession, folder: str) -> tuple[int, int]:
    """(bytes, files) below a folder."""
    p, fs = _path(spark, folder)
    held = fs.getContentSummary(p)
    return held.getLength(), held.getFileCount()


def create(spark: SparkSession, path: str) -> bool:
    """Create an empty file that must not exist yet; False if another writer has it.

    The test and the creation are one step: on a local disk by the operating system, on a cluster's file system by its
    name node. Where a store has no such step two writers may both succeed; nothing that would lose rows then relies on it.
    """
    p, fs = _path(spark, path)
    if fs.getUri().getScheme() == "file":
        nio, jvm = spark.sparkContext._jvm.java.nio.file, spark.sparkContext._jvm
        fs.mkdirs(p.getParent())
        place = nio.Path.of(jvm.java.net.URI.create("file://" + fs.makeQualified(p).toUri().getRawPath()))
        try:
            nio.Files.createFile(place, spark.sparkContext._gateway.new_array(nio.attribute.FileAttribute, 0))
            return True
        except Exception:
            if fs.exists(p):
                return False
            raise
    try:
        fs.create(p, False).close()
        return True
    except Exception:
        if fs.exists(p):
            return False
        raise


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all. Its name must be the writer's own: nothing is replaced."""
    p, fs = _path(spark, path)
    part, _ = _path(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, p):
        raise OSError(f"cannot write {path}")


def read(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, folder: str, text: str) -> None:
    """Make ``text`` the folder's current entry. Each entry has a name of its own, so that two writers never replace each other's."""
    last = max([0, *(int(n.partition("-")[0]) for n in names(spark, folder))])
    put(spark, f"{folder}/{last + 1:012d}-{uuid.uuid4().hex}", text + "\n")


def current(spark: SparkSession, folder: str) -> list[str]:
    """The lines of the folder's newest complete entry; empty before the first one."""
    for name in sorted(names(spark, folder), reverse=True):
        lines = read(spark, f"{folder}/{name}").splitlines()
        if lines:
            return lines
    return []
