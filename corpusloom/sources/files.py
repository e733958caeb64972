"""Files of any file system that all executors reach, by path or URI."""

from __future__ import annotations

import json

from pyarrow import fs


def open_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (``file``, ``hdfs``, ``s3`` and other URIs, or a plain path)
    and the folder's path in it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def write_file(folder: str, name: str, data: bytes) -> None:
    system, base = open_system(folder)
    path = f"{base}/{name}"
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def write_json(folder: str, name: str, content: object) -> None:
    write_file(folder, name, json.dumps(content).encode())


def read_json(folder: str, name: str) -> dict:
    system, base = open_system(folder)
    with system.open_input_stream(f"{base}/{name}") as found:
        return json.loads(found.read())
