"""Files that tasks write into and read from the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path within it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def new_name(folder: str, ending: str) -> str:
    """A name that no other attempt of the task uses: a retried task leaves the first one's file unused."""
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{ending}"


class Output:
    """A file that appears under its name when it is complete."""

    def __init__(self, uri: str):
        self.uri = uri
        self.system, self.path = locate(uri)
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream = self.system.open_output_stream(f"{self.path}.part", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(f"{self.path}.part", self.path)


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = locate(uri)
    with system.open_input_file(path) as file:
        return file.read_at(length, offset)
