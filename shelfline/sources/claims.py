"""Small files that are written whole or not at all, and by one writer only.

They decide between writers that do not know of each other: whoever creates the next file of a
numbered series has the number. A file system must refuse to rename onto an existing file, as
HDFS does; a local one is given a hard link, which refuses that too.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text; False if it exists."""
    files, final = _at(spark, path)
    if files.exists(final):
        return False
    draft = spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
        out.close()
        if files.getScheme() != "file":
            return files.rename(draft, final)
        os.link(draft.toUri().getPath(), final.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        files.delete(draft, False)


def read_text(spark: SparkSession, path: str) -> str:
    files, place = _at(spark, path)
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, drafts left out; none if there is no folder."""
    files, place = _at(spark, folder)
    if not files.exists(place):
        return []
    found = (status.getPath().getName() for status in files.listStatus(place))
    return sorted(name for name in found if not name.startswith("."))


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        files, place = _at(spark, path)
        files.delete(place, True)


def bytes_in(spark: SparkSession, folders: Iterable[str]) -> int:
    """The size of all files in some folders that exist."""
    total = 0
    for folder in folders:
        files, place = _at(spark, folder)
        total += files.getContentSummary(place).getLength()
    return total
