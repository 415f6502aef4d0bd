"""Collections below a folder: create, open, list, drop."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from vecspark.collection import Collection
from vecspark.config import CollectionConfig, DurabilityConfig, FilterConfig
from vecspark.errors import CollectionExistsError, CollectionNotFoundError
from vecspark.sources.store import Files, Manifests, shared_root

DROPPED = ".dropped-"


class CollectionManager:
    """Without a folder collections live in a new one below ``spark.checkpoint.dir``, and no other manager finds them."""

    def __init__(self, spark: SparkSession, root: str | None = None, durability: DurabilityConfig = DurabilityConfig(), filter_config: FilterConfig = FilterConfig()):
        self.durable = root is not None
        self.spark, self.files = spark, Files(spark, root or shared_root(spark, "collections"))
        self.durability, self.filter_config = durability, filter_config
        self._lock, self._open = threading.RLock(), {}
        self.files.mkdirs("")
        for folder in self.files.names():
            if DROPPED in folder:
                self.files.delete(folder)
                continue
            manifest = Manifests(self.files, folder).load()
            if manifest is None:  # a create that never got its manifest
                self.files.delete(folder)
            else:
                self._open[folder] = Collection(self.files, folder, manifest, durability, filter_config, self.durable)

    def create(self, config: CollectionConfig) -> Collection:
        with self._lock:
            if any(n.lower() == config.name.lower() for n in self._open):
                raise CollectionExistsError(config.name)
            manifest = Collection.new_manifest(config)
            self.files.mkdirs(config.name)
            try:
                Manifests(self.files, config.name).commit(manifest)
            except FileExistsError as e:
                raise CollectionExistsError(config.name) from e
            self._open[config.name] = Collection(self.files, config.name, manifest, self.durability, self.filter_config, self.durable)
            return self._open[config.name]

    def get(self, name: str) -> Collection:
        with self._lock:
            if name not in self._open:
                raise CollectionNotFoundError(name)
            return self._open[name]

    def names(self) -> list[str]:
        with self._lock:
            return sorted(self._open)

    def drop(self, name: str) -> None:
        """The folder is renamed first, so a drop that is cut off counts as done and is cleared up at the next opening."""
        with self._lock:
            if self._open.pop(name, None) is None:
                raise CollectionNotFoundError(name)
            aside = f"{name}{DROPPED}{uuid.uuid4().hex}"
            self.files.rename(name, aside)
            self.files.delete(aside)

    def stats(self) -> DataFrame:
        rows = [(s["name"], s["config"].dim, s["config"].metric, s["config"].index, s["live"], s["tombstones"], s["memory_bytes"], s["compactions"], s["last_lsn"]) for s in (self.get(n).stats() for n in self.names())]
        return self.spark.createDataFrame(rows, "name string, dim int, metric string, index_type string, live long, tombstones long, memory_bytes long, compactions long, last_lsn long").orderBy("name")

    def close(self) -> None:
        """Every commit is durable already, so there is nothing to write; the manager forgets its collections."""
        with self._lock:
            self._open.clear()
