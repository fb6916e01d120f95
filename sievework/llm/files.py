"""Byte files in the shared folder, written and read by tasks through the file system of their address."""

import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> str:
    """Address of a file that no other attempt of the task writes; the rows a task returns say which one counts."""
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    system, path = place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_file(uri: str):
    system, path = place(uri)
    return system.open_input_file(path)
