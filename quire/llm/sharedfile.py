"""Arrays in the shared folder: written once under their final name, memory-mapped where possible."""

from __future__ import annotations

import io
import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def _local(uri: str) -> str | None:
    p = urlparse(uri)
    return unquote(p.path) if p.scheme == "file" else uri if p.scheme == "" else None


def put(folder: str, name: str, array: np.ndarray) -> str:
    """Writes an array; a task that is tried again only replaces it by the same."""
    if (at := _local(folder)) is not None:
        os.makedirs(at, exist_ok=True)
        tmp = f"{at}/.{name}.{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            np.save(f, array)
        os.replace(tmp, f"{at}/{name}.npy")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        buf = io.BytesIO()
        np.save(buf, array)
        tmp = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(tmp) as f:
            f.write(buf.getbuffer())
        store.move(tmp, f"{path}/{name}.npy")
    return f"{folder}/{name}.npy"


def get(uri: str) -> np.ndarray:
    """The array of put(): mapped from a file system that all machines mount, else read whole."""
    if (at := _local(uri)) is not None:
        return np.load(at, mmap_mode="r")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return np.load(io.BytesIO(f.read()))
