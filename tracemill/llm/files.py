"""Binary files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import io
import uuid
from contextlib import contextmanager

from pyarrow import fs


@contextmanager
def new_file(folder: str, suffix: str):
    """(stream, path) of a new file below a folder.  Each attempt of a task writes a file of its own; only
    the attempt whose rows count names its file, so a lost or repeated attempt leaves nothing that is read."""
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with system.open_output_stream(f"{base}/{name}", compression=None) as out:
        yield out, f"{folder}/{name}"


@contextmanager
def open_file(path: str):
    """A buffered reader at the start of a file; it can seek."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as raw:
        yield io.BufferedReader(raw, 1 << 20)
