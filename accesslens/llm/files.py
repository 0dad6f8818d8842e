"""Plain files on any storage Arrow knows (local, S3, GCS, HDFS), by URI."""

from __future__ import annotations

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else f"file://{uri[5:]}")


def writer(folder: str, name: str):
    """An output stream for ``folder/name``; the folder is made if missing."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}", compression=None)


def reader(uri: str):
    """A seekable input file."""
    system, path = _open(uri)
    return system.open_input_file(path)
