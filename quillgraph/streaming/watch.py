"""Watching a project with Structured Streaming: refreshes, sessions, health."""

from __future__ import annotations

import threading
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Config
from ..sources.markdown import list_files
from ..sources.store import GraphStore

FATAL, DEGRADED = ("ENOSPC", "EMFILE"), ("EACCES", "INDEX_ERROR")
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


@dataclass(frozen=True)
class WatchHealth:
    """state: starting, healthy, degraded or failed."""

    state: str = "starting"
    refreshes: int = 0
    failures: int = 0
    last_error: str | None = None
    pending: bool = False

    def succeeded(self) -> WatchHealth:
        return replace(self, state="healthy", refreshes=self.refreshes + 1, last_error=None, pending=False)

    def failed(self, code: str, message: str, phase: str) -> WatchHealth:
        """Lack of handles or space ends the watch; so does any error at startup.  Others leave it degraded, with work pending."""
        fatal = code in FATAL or phase == "startup"
        return replace(self, state="failed" if fatal else "degraded", failures=self.failures + 1, last_error=f"{code}: {message}", pending=not fatal)


def file_stream(spark: SparkSession, root: str, per_batch: int = 10_000) -> DataFrame:
    """New and changed Markdown files under ``root`` as a stream; a file is seen again when its time changes."""
    return (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,mdx}")
        .option("maxFilesPerTrigger", per_batch).load(root).select("path", "modificationTime", "length")
    )


class Watcher:
    """Refreshes a store whenever files arrive, change or vanish.

    The stream of files tells when to look, and so does a clock, as a file
    that vanishes gives no batch and a refresh that failed is to be tried
    again: at each tick a listing without contents is compared with that of
    the last refresh.  What changed is found by comparing contents with the
    index, so a batch that runs twice does no harm.
    """

    def __init__(self, spark: SparkSession, root: str, store: GraphStore, config: Config | None = None):
        self.spark, self.root, self.store, self.config = spark, root, store, config or Config()
        self.health = WatchHealth()
        self.query: StreamingQuery | None = None
        self.ticks: StreamingQuery | None = None
        self._seen: tuple | None = None
        self._lock = threading.Lock()

    def listing(self) -> tuple:
        """The number of files and a sum of hashes of their names, times and lengths."""
        rows = list_files(self.spark, self.root, self.config).select(F.xxhash64("path", "modified", "length").cast("decimal(38,0)").alias("h"))
        return tuple(rows.agg(F.count(F.lit(1)), F.sum("h")).first())

    def refresh(self, phase: str = "runtime") -> dict[str, int] | None:
        try:
            seen = self.listing()
            _, done = self.store.refresh(list_files(self.spark, self.root, self.config), self.config)
        except Exception as e:  # noqa: BLE001  the watch goes on
            code = next((c for c in (*FATAL, "EACCES") if c in str(e)), "INDEX_ERROR")
            self.health = self.health.failed(code, str(e).splitlines()[0] if str(e) else type(e).__name__, phase)
            return None
        self.health, self._seen = self.health.succeeded(), seen
        return done

    def _on_batch(self, batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            self.look()

    def look(self) -> dict[str, int] | None:
        """Refreshes where the listing differs from that of the last refresh, or one is pending."""
        with self._lock:
            if self.health.state == "failed":
                return None
            return self.refresh() if self.health.pending or self.listing() != self._seen else None

    def stop(self) -> None:
        for q in (self.query, self.ticks):
            if q is not None and q.isActive:
                q.stop()

    def start(self, checkpoint: str, interval: str = "2 seconds", once: bool = False) -> StreamingQuery:
        """Runs until stopped, or over what is there with ``once``.  Bursts within ``interval`` are one refresh."""
        if self.refresh("startup") is None:
            raise RuntimeError(self.health.last_error)
        writer = file_stream(self.spark, self.root).writeStream.foreachBatch(self._on_batch).option("checkpointLocation", checkpoint)
        self.query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
        if not once:
            clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
            self.ticks = clock.writeStream.foreachBatch(lambda *_: self.look() and None).option("checkpointLocation", f"{checkpoint}-ticks").trigger(processingTime=interval).start()
        return self.query


def change_sessions(events: DataFrame, when: str, who: str, gap: str, late: str) -> DataFrame:
    """who, started, ended, events of a stream: bursts without a pause over ``gap``; events later than ``late`` are dropped."""
    w = F.session_window(when, gap)
    grouped = events.withWatermark(when, late).groupBy(F.col(who), w.alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select(who, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def latest_state(events: DataFrame, when: str, who: str, kind: str, late: str, window: str) -> DataFrame:
    """who, window, last, errors, state of a stream of events, by windows."""
    last = F.max_by(kind, when)
    error = (F.col(kind) == "error").cast("bigint")
    return events.withWatermark(when, late).groupBy(F.col(who), F.window(when, window).alias("w")).agg(
        last.alias("last"), F.sum(error).alias("errors"), F.when(last == "error", "degraded").otherwise("healthy").alias("state")
    )
