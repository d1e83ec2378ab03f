"""Blocks of vectors in the shared checkpoint folder: written once, read in pieces by any task."""

from __future__ import annotations

import pickle
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from claimloom.lineage import checkpoint_dir


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path in it."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Shelf:
    """A folder of files beside the checkpoints. Every file gets a new name, so a task that is run twice overwrites nothing; ``remove`` deletes them all."""

    def __init__(self, root: str) -> None:
        self.root = root

    @classmethod
    def beside(cls, df: DataFrame) -> Shelf:
        """A new folder in the checkpoint folder of the session of ``df``."""
        shelf = cls(f"{checkpoint_dir(df)}/vectors-{uuid.uuid4().hex}")
        system, path = _place(shelf.root)
        system.create_dir(path)
        return shelf

    def put(self, *parts: bytes | memoryview) -> str:
        """The name of a new file that holds the parts one after another."""
        name = uuid.uuid4().hex
        system, path = _place(self.root)
        with system.open_output_stream(f"{path}/{name}") as out:
            for part in parts:
                out.write(part)
        return name

    def get(self, name: str) -> bytes:
        """A whole file."""
        system, path = _place(self.root)
        with system.open_input_file(f"{path}/{name}") as f:
            return f.read()

    def put_vectors(self, ids: np.ndarray, x: np.ndarray) -> str:
        """A file of keys and vectors."""
        return self.put(memoryview(np.ascontiguousarray(ids, dtype=np.int64)).cast("B"), memoryview(np.ascontiguousarray(x, dtype=np.float32)).cast("B"))

    def vectors(self, name: str, rows: int, start: int, count: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and vectors ``start`` to ``start + count`` of a file of ``rows`` vectors."""
        system, path = _place(self.root)
        with system.open_input_file(f"{path}/{name}") as f:
            ids = np.frombuffer(f.read_at(8 * count, 8 * start), dtype=np.int64)
            return ids, np.frombuffer(f.read_at(4 * dim * count, 8 * rows + 4 * dim * start), dtype=np.float32).reshape(count, dim)

    def put_table(self, table: pa.Table) -> str:
        """A file of a table."""
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return self.put(sink.getvalue())

    def table(self, name: str) -> pa.Table:
        """The table of a file."""
        return pa.ipc.open_stream(self.get(name)).read_all()

    def drop(self, names: list[str]) -> None:
        """Delete some files."""
        system, path = _place(self.root)
        for name in names:
            system.delete_file(f"{path}/{name}")

    def remove(self) -> None:
        """Delete the folder."""
        system, path = _place(self.root)
        system.delete_dir(path)


class Kept:
    """Objects of a shelf by name, the last used ones in memory."""

    def __init__(self, shelf: Shelf, most: int = 300) -> None:
        self.shelf, self.most, self.held = shelf, most, OrderedDict()

    def __getitem__(self, name: str) -> object:
        if name not in self.held:
            self.held[name] = pickle.loads(self.shelf.get(name))
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(name)
        return self.held[name]
