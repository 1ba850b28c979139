"""Plain files in the shared folder, written and read by tasks through Arrow's file systems.

A task writes under a name that no other attempt uses, and the file counts only once a committed table names it; what
a lost or repeated attempt leaves behind is never read.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

from tidewheel import storage


def folder(spark: SparkSession, label: str) -> str:
    """A new place under the shared folder; nothing is created yet."""
    return f"{storage.shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """(file system, path) of a path or URI as Spark writes them."""
    from pyarrow import fs

    if re.match(r"^file:/(?!/)", uri):
        uri = uri.replace("file:/", "file:///", 1)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def create(uri: str, name: str):
    """(URI of a new file, its output stream); the name gets a part that is unique to this attempt."""
    files, path = file_system(uri)
    files.create_dir(path, recursive=True)
    full = f"{name}-{uuid.uuid4().hex}"
    return f"{uri}/{full}", files.open_output_stream(f"{path}/{full}")


def tasks(spark: SparkSession, size: int | None, each: int) -> int:
    """Number of tasks that read ``size`` units, at most about ``each`` in a task."""
    return max(spark.sparkContext.defaultParallelism, (size or 0) // each + 1)


def runs(places: list[tuple[int, int]], gap: int = 1 << 16, most: int = 8 << 20) -> list[tuple[int, int]]:
    """Coalesce sorted (offset, length) into (first, last) index ranges, each read at once: small gaps, bounded size."""
    out: list[tuple[int, int]] = []
    first, end = 0, 0
    for i, (at, length) in enumerate(places):
        if i == first:
            end = at + length
        elif at - end > gap or max(end, at + length) - places[first][0] > most:
            out.append((first, i - 1))
            first, end = i, at + length
        else:
            end = max(end, at + length)
    if places:
        out.append((first, len(places) - 1))
    return out


def read_places(uri: str, places: list[tuple[int, int]]):
    """Bytes at each of the sorted (offset, length), by coalesced range reads."""
    files, path = file_system(uri)
    with files.open_input_file(path) as f:
        for first, last in runs(places):
            start = places[first][0]
            end = max(at + n for at, n in places[first : last + 1])
            f.seek(start)
            block = memoryview(f.read(end - start))
            for at, n in places[first : last + 1]:
                yield block[at - start : at - start + n]
