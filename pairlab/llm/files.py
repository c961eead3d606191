"""Files that tasks write to and read from the shared folder.

A path may name any store that Arrow opens (``file:``, ``hdfs:``, ``s3:``, ``gs:``).
A task writes under a name of its own and returns it; a table of the returned
names (written after the task committed) says which files count.  So a task that
runs twice, or dies half way, leaves a file that nobody names.
"""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs
from pyspark import TaskContext


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


def new_file(folder: str, suffix: str) -> str:
    """A name in ``folder`` that no other task, attempt or call uses."""
    context = TaskContext.get()
    return f"{folder}/part-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}{suffix}"


def open_out(path: str) -> BinaryIO:
    store, place = _resolve(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    return store.open_output_stream(place, compression=None)  # as is, whatever the name ends with


def open_in(path: str) -> BinaryIO:
    """A seekable input."""
    store, place = _resolve(path)
    return store.open_input_file(place)
