import datetime as dt
import time

import corpus

from quillgraph.sources.store import GraphStore
from quillgraph.streaming.watch import Watcher, WatchHealth, change_sessions, latest_state


def test_files_that_arrive_are_indexed(spark, tmp_path):
    root = corpus.write(tmp_path / "p", {"docs/a.md": "# a page\n"})
    w = Watcher(spark, root, GraphStore(spark, str(tmp_path / "store")))
    w.start(str(tmp_path / "checkpoint"), once=True).awaitTermination(60)
    assert w.health.state == "healthy" and w.store.load().documents.count() == 1
    corpus.write(tmp_path / "p", {"docs/b.md": "# b page\n"})
    (tmp_path / "p/docs/a.md").unlink()
    w.start(str(tmp_path / "checkpoint"), once=True).awaitTermination(60)
    assert [r["path"] for r in w.store.load().documents.collect()] == ["docs/b.md"]


def test_a_file_that_vanishes_is_noticed_and_a_failure_tried_again(spark, tmp_path):
    root = corpus.write(tmp_path / "p", {"docs/a.md": "# a page\n", "docs/b.md": "# b page\n"})
    w = Watcher(spark, root, GraphStore(spark, str(tmp_path / "store")))
    w.start(str(tmp_path / "checkpoint"), interval="1 second")

    def until(condition):
        end = time.time() + 90
        while time.time() < end and not condition():
            time.sleep(0.5)
        return condition()

    try:
        assert w.store.load().documents.count() == 2
        (tmp_path / "p/docs/a.md").unlink()
        assert until(lambda: [r["path"] for r in w.store.load().documents.collect()] == ["docs/b.md"])
        w.health = w.health.failed("INDEX_ERROR", "x", "runtime")
        n = w.health.refreshes
        assert until(lambda: w.health.state == "healthy" and w.health.refreshes > n)
    finally:
        w.stop()


def test_health_states():
    h = WatchHealth().succeeded()
    assert h.failed("INDEX_ERROR", "x", "runtime").state == "degraded" and h.failed("INDEX_ERROR", "x", "runtime").pending
    assert h.failed("ENOSPC", "x", "runtime").state == "failed" and h.failed("EACCES", "x", "startup").state == "failed"
    assert h.failed("EACCES", "x", "runtime").succeeded().last_error is None


def test_sessions_and_states_of_a_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    rows = [(1, at(0), "view"), (1, at(2), "error"), (1, at(30), "view"), (2, at(1), "error")]
    spark.createDataFrame(rows, "user_id long, ts timestamp, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, kind string").parquet(str(tmp_path / "in"))
    for name, df, mode in (("s", change_sessions(stream, "ts", "user_id", "10 minutes", "1 hour"), "complete"), ("h", latest_state(stream, "ts", "user_id", "kind", "1 hour", "20 minutes"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(60)
    assert sorted((r["user_id"], r["events"]) for r in spark.table("s").collect()) == [(1, 1), (1, 2), (2, 1)]
    assert sorted((r["user_id"], r["state"]) for r in spark.table("h").collect()) == [(1, "degraded"), (1, "healthy"), (2, "degraded")]
