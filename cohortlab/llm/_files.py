"""Bytes of whole files in the shared folder, written and range-read by executors through Arrow's file systems.

``file``, ``hdfs``, ``s3``, ``gs`` and ``abfs`` addresses work as far as Arrow has them. A writer finishes a file under a
name of its own and only then reports it, so files of tasks that died are never referred to.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow.fs as pafs


@lru_cache(64)
def _filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in root and root.startswith("file:"):
        root = "file://" + root[5:]
    if "://" not in root:
        return pafs.LocalFileSystem(), root
    return pafs.FileSystem.from_uri(root)


def write_file(root: str, name: str, chunks) -> int:
    """Write ``chunks`` of bytes to ``root/name``; returns the length."""
    fs, base = _filesystem(root)
    fs.create_dir(base, recursive=True)
    n = 0
    with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    return n


class Reader:
    """Range reads that keep the last file open."""

    def __init__(self, root: str):
        self.fs, self.base = _filesystem(root)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.base}/{name}")
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{name} ends before {offset + length}")
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name = self.file = None
