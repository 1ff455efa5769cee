"""Indexing that catches up by itself: a stream of new files, and listings on a schedule.

New files come through Spark's file source with a checkpoint, all that there are at one
time (``availableNow``), some thousand in a batch; each batch is one commit that also
says which batch it was, so a batch that is run again after a failure changes nothing.
A file source never reports a file again, so what has changed or is gone is found by
comparing a listing with the index, less often.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..plans.engine import Engine, IndexResult
from ..sources import files

BINARY_FILES = "path string, modificationTime timestamp, length bigint, content binary"


class LazyIndex:
    """An engine whose searches index first what is due."""

    def __init__(self, engine: Engine, checkpoint: str, files_of_batch: int = 2000, new_every: float = 60.0, reconcile_every: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.engine, self.checkpoint, self.files_of_batch = engine, checkpoint, files_of_batch
        self.new_every, self.reconcile_every, self.clock = new_every, reconcile_every, clock
        self._new_at = self._reconciled_at = float("-inf")

    def catch_up(self) -> list[IndexResult]:
        """Index the files that came since the last time; a result for each batch."""
        engine, done = self.engine, []
        stream = f"{engine.corpus}:{self.checkpoint}"

        def batch(rows: DataFrame, number: int) -> None:
            held = files.scanned(rows, engine.root).persist()
            done.append(engine.index_files(held, (stream, number)))
            held.unpersist()

        source = engine.spark.readStream.format("binaryFile").schema(BINARY_FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", self.files_of_batch).load(engine.root)
        query = source.writeStream.foreachBatch(batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        self._new_at = self.clock()
        return done

    def reconcile(self) -> IndexResult:
        done = self.engine.reconcile()
        self._reconciled_at = self.clock()
        return done

    def refresh(self) -> None:
        """Do what is due; between two times nothing is listed."""
        if self.clock() - self._new_at >= self.new_every:
            self.catch_up()
        if self.clock() - self._reconciled_at >= self.reconcile_every:
            self.reconcile()

    def search(self, query: str, filters: str | None = None, **rest) -> DataFrame:
        self.refresh()
        return self.engine.search(query, filters, refresh=False, **rest)

    def search_pages(self, query: str, filters: str | None = None, **rest) -> DataFrame:
        self.refresh()
        return self.engine.search_pages(query, filters, **rest)
