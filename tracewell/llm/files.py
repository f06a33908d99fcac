"""Whole files in the shared folder, written and read by tasks through pyarrow's file systems (file, hdfs, s3, ...).

A task writes under a name of its own (``uuid``) and returns that name in its rows; only names in committed rows are
read, so a task that runs twice does no harm.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str):
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def open_new(folder: str, suffix: str):
    """(uri, open stream) of a new file."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    where, path = _at(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, where.open_output_stream(path, compression=None)


def write_new(folder: str, suffix: str, payload) -> str:
    uri, out = open_new(folder, suffix)
    with out:
        out.write(payload)
    return uri


def open_read(uri: str):
    where, path = _at(uri)
    return where.open_input_stream(path, compression=None)


def read_all(uri: str) -> bytes:
    where, path = _at(uri)
    with where.open_input_file(path) as f:
        return f.read()


class RangeReader:
    """Range reads of one file."""

    def __init__(self, uri: str):
        where, path = _at(uri)
        self._file = where.open_input_file(path)

    def read(self, offset: int, length: int) -> bytes:
        return self._file.read_at(length, offset)

    def close(self) -> None:
        self._file.close()
