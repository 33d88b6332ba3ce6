"""Repositories by id: where they are, what they are called, and the index built for each."""

from __future__ import annotations

import threading
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Repository:
    id: str
    name: str
    description: str
    path: str


class Catalog:
    """Registrations keep their order, a new registration of an id its place; indexes are built once an id and evicted with it."""

    def __init__(self, spark: SparkSession):
        self.spark, self._entries, self._indexes, self._lock = spark, {}, {}, threading.Lock()

    def register(self, id: str, path: str, name: str | None = None, description: str | None = None) -> Repository:
        id = id.strip()
        if not id:
            raise ValueError("repository id must not be empty")
        if len(id) > 100:
            raise ValueError("repository id must have at most 100 characters")
        root = Path(path).resolve()
        if not root.is_dir():
            raise FileNotFoundError(f"repository path is not a directory: {path}")
        entry = Repository(id, name or id, description or f"Repository at {root}", str(root))
        with self._lock:
            self._entries[id] = entry
        self.invalidate(id)
        return entry

    def unregister(self, id: str) -> bool:
        with self._lock:
            known = self._entries.pop(id, None) is not None
        self.invalidate(id)
        return known

    def resolve(self, id: str) -> str:
        entry = self._entries.get(id)
        if entry is None:
            raise ValueError(f"unknown repository '{id}'; known: {sorted(self._entries)}")
        if not Path(entry.path).is_dir():
            raise FileNotFoundError(entry.path)
        return entry.path

    def get(self, id: str) -> Repository | None:
        return self._entries.get(id)

    def repositories(self) -> DataFrame:
        rows = [(e.id, e.name, e.description, e.path) for e in self._entries.values()]
        return self.spark.createDataFrame(rows, "repository_id string, name string, description string, path string")

    def index(self, id: str):
        """The engine over one repository, built once."""
        from ..plans.engine import CodeIndex

        path = self.resolve(id)
        with self._lock:
            if id not in self._indexes:
                self._indexes[id] = CodeIndex.from_directory(self.spark, id, path)
            return self._indexes[id]

    def invalidate(self, id: str | None = None) -> None:
        with self._lock:
            gone = [self._indexes.pop(k) for k in ([id] if id is not None else list(self._indexes)) if k in self._indexes]
        for index in gone:
            index.unpersist()
