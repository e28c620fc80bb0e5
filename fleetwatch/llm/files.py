"""Files in the shared folder, opened by tasks."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyarrow import fs


def opened(uri: str):
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def local_path(uri: str) -> str | None:
    """The plain path of a URI whose file system is mounted on every machine, else None."""
    system, path = opened(uri)
    return path if isinstance(system, fs.LocalFileSystem) else None


def save(folder: str, name: str, **arrays: np.ndarray) -> str:
    """Write arrays to files of their own in a shared folder; gives the name they share, a new one for each attempt of a task."""
    system, path = opened(folder)
    name = f"{name}-{uuid.uuid4().hex}"
    for kind, array in arrays.items():
        with system.open_output_stream(f"{path}/{name}.{kind}", compression=None) as out:
            out.write(np.ascontiguousarray(array).tobytes())
    return name


def mapped(uri: str, kind) -> np.ndarray:
    """A saved array, memory-mapped; one of a file system that isn't mounted is read whole."""
    path = local_path(uri)
    if path is None:
        system, remote = opened(uri)
        with system.open_input_stream(remote, compression=None) as source:
            return np.frombuffer(source.read(), kind)
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
