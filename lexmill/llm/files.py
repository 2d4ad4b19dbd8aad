"""Files that tasks write to the shared folder: one per task attempt, found through a stored manifest."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def open_folder(uri: str):
    """The file system and path of a folder URI; what pyarrow can open (file, hdfs, s3, gs) is supported."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def new_file(folder: str, stem: str, suffix: str):
    """(name, stream) of a file that gets its name only once complete; every attempt has a name of its own."""
    system, base = open_folder(folder)
    system.create_dir(base, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    part = f"{base}/.{name}.part"
    with system.open_output_stream(part, compression=None) as out:
        yield name, out
    system.move(part, f"{base}/{name}")


@contextmanager
def open_file(folder: str, name: str):
    system, base = open_folder(folder)
    with system.open_input_file(f"{base}/{name}") as f:
        yield f
