"""Whole files written and read by tasks in the shared folder, through the file system that its address names."""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write under a name of the attempt's own, then move it into place: a task that is run again or twice leaves one whole file."""
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    path, own = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own, compression=None) as f:
        f.write(data)
    system.move(own, path)
    return f"{folder}/{name}"


def read_file(path: str) -> bytes:
    system, base = fs.FileSystem.from_uri(path)
    with system.open_input_stream(base, compression=None) as f:
        return f.read()
