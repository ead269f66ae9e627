"""Folders in whatever storage Spark's paths name: what is there, and removal of what nobody reads."""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _of(spark, path)
    return bool(fs.exists(where))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, where = _of(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


class Entry(NamedTuple):
    """An entry of a folder, and where its path leads."""

    path: str
    name: str
    is_folder: bool
    length: int
    resolved: str


def qualified(spark: SparkSession, path: str) -> str:
    fs, where = _of(spark, path)
    return fs.makeQualified(where).toString()


def resolved(spark: SparkSession, path: str) -> str:
    """A path with its links followed, where they are a machine's own; others are as the storage names them."""
    fs, where = _of(spark, path)
    full = fs.resolvePath(where)
    if full.toUri().getScheme() != "file":
        return full.toString()
    return "file:" + os.path.realpath(full.toUri().getPath())


def entries(spark: SparkSession, path: str) -> list[Entry]:
    """What is in a folder, by name."""
    fs, where = _of(spark, path)
    own = lambda p: f"{path}/{p.getName()}"
    return sorted((Entry(own(s.getPath()), s.getPath().getName(), s.isDirectory(), 0 if s.isDirectory() else s.getLen(), resolved(spark, s.getPath().toString())) for s in fs.listStatus(where)), key=lambda e: e.name)


def size(spark: SparkSession, path: str) -> int:
    fs, where = _of(spark, path)
    return int(fs.getContentSummary(where).getLength()) if fs.exists(where) else 0


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _of(spark, path)
    fs.delete(where, True)
