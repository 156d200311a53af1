"""Watching folders: change events stream through filters and debounce into the index. Each watcher is a streaming query of its own."""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators import index
from ..sources import tree
from ..sources.events import FolderEvents
from . import debounce

if TYPE_CHECKING:
    from ..plans.store import Store


@dataclass
class Watcher:
    id: str
    directory: str
    workspace_id: str
    recursive: bool
    query: StreamingQuery


class Watchers:
    """Running watchers. A failed file is the pipeline's to report; it doesn't end the stream."""

    def __init__(self, spark: SparkSession, store: Store, config: Config):
        self.spark, self.store, self.config, self.running = spark, store, config, {}
        spark.dataSource.register(FolderEvents)

    def start(self, directory: str, workspace_id: str, recursive: bool = True, interval: str = "1 second") -> str:
        """Watch a folder. Where a watch of it into this workspace was begun before, also by another process, it goes on from there: what changed meanwhile is seen first."""
        for w in self.running.values():
            if (w.directory, w.workspace_id, w.recursive) == (directory, workspace_id, recursive) and w.query.isActive:
                return w.id
        # Beside the index, which is on storage that all machines share.
        base = f"{self.store.root.rstrip('/')}.watch/{hashlib.sha256(repr((directory, workspace_id, recursive)).encode()).hexdigest()[:24]}"
        events = self.spark.readStream.format("folder_events").option("path", directory).option("recursive", str(recursive).lower()).option("state", f"{base}/state").option("since", str(time.time_ns())).load()
        own = self.config.index
        wanted = debounce.passing(events, own.supported_extensions, own.exclude_patterns, directory)
        stream = debounce.debounce_stream(wanted, self.config.watcher.debounce_ms)
        query = stream.writeStream.foreachBatch(lambda batch, _: self.apply(batch, workspace_id, directory)).trigger(processingTime=interval).option("checkpointLocation", f"{base}/checkpoint").start()
        watcher = Watcher(str(uuid.uuid4()), directory, workspace_id, recursive, query)
        self.running[watcher.id] = watcher
        return watcher.id

    def apply(self, batch: DataFrame, workspace_id: str, root: str) -> None:
        """Deleted files leave the index, if deletions are followed; the others are indexed unless their hash is known. The last event of a file counts."""
        last = index.last_wins(batch, ["file_path"], [F.col("ts"), F.col("event_type")]).persist()
        try:
            gone, fresh = last.filter("event_type = 'deleted'"), last.filter("event_type <> 'deleted'")
            if self.config.watcher.sync_deletions and not gone.isEmpty():
                self.store.delete_files(workspace_id, gone)
            if not fresh.isEmpty():
                self.store.index_listing(tree.stated(fresh), workspace_id, root)
        finally:
            last.unpersist()

    def stop(self, watcher_id: str) -> bool:
        watcher = self.running.pop(watcher_id, None)
        if watcher:
            watcher.query.stop()
        return watcher is not None

    def stop_workspace(self, workspace_id: str) -> int:
        return sum(self.stop(k) for k in [k for k, w in self.running.items() if w.workspace_id == workspace_id])

    def list_watchers(self) -> list[dict]:
        return [{"watcher_id": w.id, "directory": w.directory, "workspace_id": w.workspace_id, "recursive": w.recursive, "active": w.query.isActive} for w in self.running.values()]

    def shutdown(self) -> None:
        for k in list(self.running):
            self.stop(k)
