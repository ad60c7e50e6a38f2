"""Folders on whatever file system a path names, through Hadoop's client."""

from __future__ import annotations

from pyspark.sql import SparkSession


def folder(spark: SparkSession, path: str):
    """``(file system, path)`` of Hadoop's client."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = folder(spark, path)
    return fs.exists(where)


def make_folder(spark: SparkSession, path: str) -> str:
    fs, where = folder(spark, path)
    fs.mkdirs(where)
    return path


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folders in ``path``, sorted."""
    fs, where = folder(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(where) if s.isDirectory())


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Deletes a folder and what is in it; ``False`` if there was none."""
    fs, where = folder(spark, path)
    return fs.delete(where, True)
