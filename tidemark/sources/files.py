"""Small things about files and folders, through the file system that Spark uses for a path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    """A path and its file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = hadoop(spark, path)
    return fs.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target, fs = hadoop(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def part_files(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and bytes of the part files directly below a folder."""
    target, fs = hadoop(spark, path)
    parts = [s for s in fs.listStatus(target) if s.getPath().getName().startswith("part-")]
    return len(parts), sum(s.getLen() for s in parts)


def part_paths(spark: SparkSession, path: str) -> list[str]:
    """The part files directly below a folder, in the order of the tasks that wrote them."""
    target, fs = hadoop(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(target) if s.getPath().getName().startswith("part-"))


def state_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change) of the files at or below a path, in order: differs when any of them has changed."""
    target, fs = hadoop(spark, path)
    if not fs.exists(target):
        return []
    out, walk = [], fs.listFiles(target, True)
    while walk.hasNext():
        s = walk.next()
        out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


def folder_numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Values of the folders `name=<number>` directly below a path."""
    target, fs = hadoop(spark, path)
    if not fs.exists(target):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{name}="))


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    """Files and folders of this package's own that nothing reads any more."""
    for path in paths:
        target, fs = hadoop(spark, path)
        fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place, then renamed."""
    target, fs = hadoop(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}._writing")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(beside, target)


def read_texts(spark: SparkSession, path: str) -> list[str]:
    """Contents of the small files `*.json` directly below a folder."""
    target, fs = hadoop(spark, path)
    if not fs.exists(target):
        return []
    out = []
    for s in fs.listStatus(target):
        if s.getPath().getName().endswith(".json"):
            stream = fs.open(s.getPath())
            try:
                out.append(bytes(b & 0xFF for b in stream.readAllBytes()).decode())
            finally:
                stream.close()
    return out
