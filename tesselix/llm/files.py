"""Files in the shared folder, written and read by tasks. Paths are URIs as Spark names them."""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there; a path without a scheme or with file: is a mounted one."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    for name in ("s3a:", "s3n:"):  # Spark's names of a store that is s3 here
        if uri.startswith(name):
            uri = "s3:" + uri[len(name) :]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Writer:
    """A file that is there whole or not at all: it is written under another name and moved when it is closed. Each
    attempt of a task has a name of its own, so a lost one never stands in the way."""

    def __init__(self, folder: str, name: str, suffix: str = ""):
        self.uri = f"{folder}/{name}-{uuid.uuid4().hex[:12]}{suffix}"
        self.fs, self.path = store(self.uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(f"{self.path}.part")

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> str:
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)
        return self.uri


def write_file(folder: str, name: str, data: bytes) -> str:
    out = Writer(folder, name)
    out.write(data)
    return out.close()
