"""Binary files in the shared folder, opened from tasks."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs


def at(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (a path without a scheme is a local one)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def new_file(folder: str, name: str):
    """Open a new file of a name that no other attempt of the task uses. A task
    returns its file's URI as its result, so files that a lost or repeated
    attempt left behind are in no manifest and are never read."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex}"
    fs, path = at(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        yield uri, out


@contextmanager
def read_file(uri: str):
    fs, path = at(uri)
    with fs.open_input_file(path) as source:
        yield source
