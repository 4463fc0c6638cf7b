"""Versions that fail half way, and a queue over restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomstone.operators.publishing import ScopeError
from loomstone.sources import versions
from loomstone.streaming import queue


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    frame = lambda r: spark.createDataFrame(r, "g string, v long")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    first = versions.publish(frame([("a", 1), ("b", 2), (None, 3)]), root, ["g"])
    pinned = versions.read(spark, root)
    second = versions.publish_scope(root, frame([("a", 10), ("a", 11)]), F.col("g") == "a", ["g"])
    assert rows(versions.read(spark, root).where("g IS NOT NULL")) == [("a", 10), ("a", 11), ("b", 2)] and versions.parent(spark, root, second) == first
    assert pinned.count() == 3 and rows(pinned.where("g = 'a'")) == [("a", 1)]
    with pytest.raises(ScopeError):
        versions.publish_scope(root, frame([("b", 1)]), F.col("g") == "a")

    # a failure between the write and the rename: the old version is still read
    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "_point", fail)
        with pytest.raises(OSError):
            versions.publish(frame([("z", 0)]), root)
    assert versions.current(spark, root) == second and versions.read(spark, root).count() == 4
    assert versions.rollback(spark, root, by=["g"]) == first and versions.read(spark, root).count() == 3
    assert versions.sync(frame([(None, 3), ("b", 2), ("a", 1)]), root, ["g"]) == "unchanged"
    assert versions.sync(frame([("a", 1), ("a", 1)]), root, ["g"]) == "replaced" and versions.read(spark, root).count() == 2
    assert len(versions.remove_before(spark, root, 1)) == 2  # the second one and the one that failed
    assert versions.rollback(spark, root, by=["g"]) == first
    # contents that are not what the manifest says
    spark.createDataFrame([("x", 1)], "g string, v long").write.mode("append").parquet(f"{root}/versions/{first}/data")
    with pytest.raises(versions.BrokenVersion):
        versions.rollback(spark, root, first, ["g"])


def test_claims(spark):
    t = lambda s: dt.datetime(2026, 1, 2) + dt.timedelta(seconds=s)
    data = [
        ("a", 2, "queued", None, 0, t(-10), None, None), ("b", 1, "failed", None, 3, t(-5), t(-1), None), ("c", 1, "leased", "w", 1, t(-400), None, t(0)), ("d", 1, "leased", "w", 1, t(-400), None, t(1)),
        ("e", 1, "completed", "w", 1, t(-86_400), None, None), ("f", 1, "completed", "w", 1, t(-86_399), None, None), ("g", 0, "queued", None, 0, t(0), t(1), None), ("h", 1, "queued", None, 0, t(-9_000), None, None),
    ]
    df = spark.createDataFrame(data, "id string, priority int, status string, owner string, attempts int, updated_at timestamp, next_due_at timestamp, lease_expires_at timestamp")
    got = lambda n, x=None: sorted((r["id"], r["attempts"]) for r in queue.claim(df, "me", "2026-01-02 00:00:00", n, x).collect())
    assert got(10) == [("a", 1), ("b", 4), ("c", 2), ("e", 2), ("h", 1)]
    assert got(2) == [("e", 2), ("h", 1)] and got(0) == []
    assert got(2, spark.createDataFrame([("h",)], "id string")) == [("e", 2)]
    one = queue.claim(df, "me", "2026-01-02 00:00:00", 1).first()
    assert (one["status"], one["owner"], one["lease_expires_at"]) == ("leased", "me", t(300))


def test_leases_over_restarts(spark, tmp_path):
    source, table, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    t = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    schema = "task string, at timestamp, kind string, worker string"

    def send(n, events):
        """Events as a file; then the stream starts anew from its checkpoint and takes what is there."""
        spark.createDataFrame([(k, t(s), kind, w) for k, s, kind, w in events], schema).coalesce(1).write.parquet(str(source / str(n)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        q = queue.leases(stream).writeStream.format("parquet").option("path", table).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive and q.exception() is None
        return sorted((r["at"], r["task"], r["what"], r["owner"], r["attempts"]) for r in spark.read.parquet(table).collect())

    send(1, [("x", 0, "add", None), ("x", 1, "claim", "w1"), ("x", 2, "claim", "w2"), ("y", 0, "add", None), ("y", 5, "claim", "w2"), ("y", 9, "complete", "w1"), ("y", 10, "complete", "w2")])
    send(2, [("x", 200, "claim", "w2"), ("z", 400, "add", None)])  # time passes the end of x's lease
    send(3, [("z", 401, "claim", "w3"), ("z", 500, "fail", "w3"), ("x", 402, "claim", "w2")])
    got = send(4, [("v", 90_000, "add", None)]) and send(5, [("v", 90_100, "claim", "w")])
    what = lambda k: [(a, b, c) for _, task, a, b, c in got if task == k]
    assert what("x") == [("added", "", 0), ("claimed", "w1", 1), ("refused", "w2", 1), ("refused", "w2", 1), ("expired", "w1", 1), ("claimed", "w2", 2), ("expired", "w2", 2)]
    assert what("y") == [("added", "", 0), ("claimed", "w2", 1), ("completed", "w2", 1), ("due", "w2", 1)]
    assert what("z") == [("added", "", 0), ("claimed", "w3", 1), ("failed", "w3", 1)]
    assert [at for at, task, w, _, _ in got if (task, w) == ("x", "expired")][0] == t(301)
