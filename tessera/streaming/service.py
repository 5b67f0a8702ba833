"""Generations of an index: published whole, read by snapshot, kept up by a stream.

A generation is a directory ``v=<n>`` that never changes; ``CURRENT`` names the one that is served and is
replaced by a rename. A reader holds the generation that it took, so a swap never changes answers in
flight; generations that nobody holds, and that are not current, can be collected.
"""

from __future__ import annotations

import threading
import time
import weakref
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.engine import Engine
from tessera.sources import store
from tessera.sources.files import Files


class Generation:
    def __init__(self, number: int, engine: Engine):
        self.number, self.engine = number, engine


@dataclass
class SearchService:
    spark: SparkSession
    root: str

    def __post_init__(self):
        self._lock, self._rebuild = threading.Lock(), threading.Lock()
        self._files = Files(self.spark, self.root)
        self._held: weakref.WeakValueDictionary[int, Generation] = weakref.WeakValueDictionary()
        self._current: Generation | None = None
        if self._files.exists(f"{self.root}/CURRENT"):
            self._adopt(int(self._files.read(f"{self.root}/CURRENT")), Engine(self.spark))

    def _adopt(self, number: int, like: Engine) -> Generation:
        engine = like.fork_config()
        engine.use(store.load(self.spark, f"{self.root}/v={number}"))
        now = Generation(number, engine)
        with self._lock:
            self._current = now
            self._held[number] = now
        return now

    def snapshot(self) -> Generation:
        with self._lock:
            if self._current is None:
                raise LookupError("nothing is published yet")
            return self._current

    def generation(self) -> int:
        with self._lock:
            return self._current.number if self._current else 0

    def search(self, query: str, k: int = 10) -> tuple[DataFrame, int]:
        now = self.snapshot()
        return now.engine.search(query, k), now.number

    def publish(self, engine: Engine) -> int:
        """Writes the engine's index as the next generation and serves it."""
        with self._rebuild:
            return self._publish(engine)

    def _publish(self, engine: Engine) -> int:
        taken = [int(n[2:]) for n in self._files.children(self.root) if n.startswith("v=")]
        number = max([0, self.generation(), *taken]) + 1
        store.save(engine.index, f"{self.root}/v={number}")
        self._files.write(f"{self.root}/CURRENT", str(number))
        self._adopt(number, engine)
        return number

    def reindex(self, tree: str) -> int:
        """A full rebuild under the current configuration; if it fails, what is served stays."""
        with self._rebuild:
            engine = self._current.engine.fork_config() if self._current else Engine(self.spark)
            engine.index_dir(tree)
            return self._publish(engine)

    def reload(self) -> int:
        """Adopts the generation that another process published."""
        number = int(self._files.read(f"{self.root}/CURRENT"))
        like = self._current.engine if self._current else Engine(self.spark)
        return self._adopt(number, like).number

    def collect(self, grace: float = 0.0) -> list[int]:
        """Deletes generations that are neither published last, nor held here, nor followed by another only since
        ``grace`` seconds; their numbers. What readers in other processes hold isn't known here: ``grace`` is the
        time after which they must have reloaded."""
        numbers = sorted(int(n[2:]) for n in self._files.children(self.root) if n.startswith("v=") and self._files.exists(f"{self.root}/{n}/meta.json"))
        last = int(self._files.read(f"{self.root}/CURRENT")) if self._files.exists(f"{self.root}/CURRENT") else 0
        gone = []
        for number, after in zip(numbers, numbers[1:]):
            replaced = self._files.modified(f"{self.root}/v={after}/meta.json")
            if number not in self._held and number not in (last, self.generation()) and time.time() - replaced >= grace:
                self._files.delete(f"{self.root}/v={number}")
                gone.append(number)
        return gone

    def watch(self, tree: str, every: int = 10, checkpoint: str | None = None, globs: Iterable[str] = ("*",)):
        """A streaming query that reindexes ``tree`` whenever files arrive, at most every ``every`` seconds."""
        stream = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        stream = stream.option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(globs) + "}").load(tree).select("path")
        writer = stream.writeStream.foreachBatch(lambda batch, _: self.reindex(tree)).trigger(processingTime=f"{max(1, every)} seconds")
        return writer.option("checkpointLocation", checkpoint or f"{self.root}/watch").start()
