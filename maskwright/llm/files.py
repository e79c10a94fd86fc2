"""Files in the shared folder that Spark has no writer for, through Arrow's file systems."""

from __future__ import annotations


def open_fs(uri: str):
    """(file system, path) of a URI or an absolute path."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    where, path = open_fs(uri)
    where.create_dir(path, recursive=True)
