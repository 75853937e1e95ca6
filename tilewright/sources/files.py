"""Files that executors and the driver write below one folder, on whatever file system its address names."""

from __future__ import annotations

import os

import pyarrow.fs as pafs


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address (file:, hdfs:, s3: and so on; a bare path is a mount that all machines share) and the path on it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def write_bytes(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Written under another name and moved, so that a task that is run again leaves a whole file."""
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{os.getpid()}.part"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)
