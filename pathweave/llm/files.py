"""Byte access, from tasks, to files in the shared folder by their URI."""

from __future__ import annotations

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, parts) -> int:
    """Write ``parts`` one after the other; the file appears under its name when it is whole."""
    where, path = _open(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    size = 0
    with where.open_output_stream(path + ".part") as out:
        for p in parts:
            out.write(p)
            size += len(p)
    where.move(path + ".part", path)
    return size


def read_range(uri: str, offset: int, length: int) -> bytes:
    where, path = _open(uri)
    with where.open_input_file(path) as f:
        return f.read_at(length, offset)


def read_all(uri: str) -> bytes:
    where, path = _open(uri)
    with where.open_input_file(path) as f:
        return f.read()
