"""Files of arrays in the shared folder, written by tasks and mapped or read by others."""

from __future__ import annotations

import numpy as np
import pyarrow.fs as pafs
from pyspark import TaskContext


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def put_file(path: str, *columns: np.ndarray | bytes) -> None:
    """Puts arrays, one after the other, into a file; it appears whole or not at all, and a retried task replaces it."""
    fs, base = _place(path)
    folder, _, name = base.rpartition("/")
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(part) as f:
        for c in columns:
            f.write(c if isinstance(c, bytes) else np.ascontiguousarray(c).tobytes())
    fs.move(part, base)


def map_file(path: str) -> np.ndarray:
    """A file of ``put_file`` as bytes: mapped where the shared folder is a mounted one, else read."""
    fs, base = _place(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(base, np.uint8, "r")
    with fs.open_input_file(base) as f:
        return np.frombuffer(f.read(), np.uint8)
