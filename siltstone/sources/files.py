"""Small files on any file system that Spark reads, through Hadoop's API on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that did not exist, as a whole: it is written beside and renamed. False if it exists."""
    place, fs = _at(spark, path)
    if fs.exists(place):
        return False
    part, _ = _at(spark, f"{path.rpartition('/')[0]}/_part-{uuid.uuid4().hex}")
    out = fs.create(part)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    done = fs.rename(part, place)
    if not done:
        fs.delete(part, False)
    return done


def read(spark: SparkSession, path: str) -> str:
    place, fs = _at(spark, path)
    stream = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    place, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def mkdirs(spark: SparkSession, path: str) -> None:
    place, fs = _at(spark, path)
    fs.mkdirs(place)


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _at(spark, path)
    fs.delete(place, True)
