"""Files that operators write beside tables: archives and index runs, under a folder that all machines share.

A `file:` URI is a mounted path. Other schemes go through pyarrow's file systems. A file appears under its name only when
it is whole: it is written under a name of its own and then moved, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import posixpath
import uuid

import pyarrow.fs as pafs


def _resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


class Writer:
    """A binary file that exists only once close() has moved it into place."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = _resolve(uri)
        self.temporary = f"{posixpath.dirname(self.path)}/.{uuid.uuid4().hex}"
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.stream = self.fs.open_output_stream(self.temporary)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.path)


def open_input(uri: str):
    """A seekable binary file."""
    fs, path = _resolve(uri)
    return fs.open_input_file(path)


def sizes(uri: str, suffix: str) -> list[tuple[str, int]]:
    """Names and sizes of the finished files with this suffix in a folder, by name; none if it doesn't exist."""
    fs, path = _resolve(uri)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted((i.base_name, i.size) for i in found if i.is_file and i.base_name.endswith(suffix) and not i.base_name.startswith("."))
