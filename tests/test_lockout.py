"""Lockouts as a stream: late events, a lock that ends without input, a restart between batches."""

import datetime as dt
import json

import pytest

from tamarack.streaming import limits

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def run(spark, tmp_path):
    """Run batches of (who, second, ok) as a stream, one file each, and return what was told; a second call goes on from the first."""
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    n = 0

    def feed(*batches):
        nonlocal n
        for rows in batches:
            lines = [json.dumps({"who": w, "at": (START + dt.timedelta(seconds=s)).isoformat(), "ok": ok}) for w, s, ok in rows]
            (tmp_path / "in" / f"{n:03}.json").write_text("\n".join(lines))
            n += 1
        events = spark.readStream.schema("who string, at timestamp, ok boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        told = limits.lockouts(events, "who", "at", "ok", most=3, window_seconds=60, lock_seconds=100, late="20 seconds")
        told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        seen = spark.read.schema("who string, at timestamp, action string").parquet(str(tmp_path / "out")).collect()
        return sorted((r.who, round((r.at.replace(tzinfo=dt.timezone.utc) - START).total_seconds()), r.action) for r in seen)

    yield feed
    spark.conf.unset(store)


def test_lock_ends_without_input(run):
    first = [("a", 0, False), ("a", 10, False), ("a", 20, False), ("a", 30, True), ("b", 0, False), ("b", 61, False), ("b", 62, False)]
    told = run(first)
    assert told == [("a", 0, "failed"), ("a", 10, "failed"), ("a", 20, "locked"), ("a", 30, "rejected"), ("b", 0, "failed"), ("b", 61, "failed"), ("b", 62, "failed")]
    told = run([("c", 200, True)], [("c", 201, True)], [("a", 110, False), ("c", 202, True)])
    assert ("a", 120, "unlocked") in told and ("a", 110, "rejected") not in told and ("a", 110, "failed") not in told
    told = run([("a", 230, False), ("b", 231, True)])
    assert ("a", 230, "failed") in told and ("b", 231, "passed") in told and sum(x[2] == "unlocked" for x in told) == 1


def test_event_after_the_lock_and_forgotten_failures(run):
    told = run([("a", s, False) for s in (0, 1)] + [("a", 2, True), ("a", 3, False), ("a", 4, False), ("a", 5, False)], [("a", 106, True), ("a", 50, False)])
    assert told == [("a", 0, "failed"), ("a", 1, "failed"), ("a", 2, "passed"), ("a", 3, "failed"), ("a", 4, "failed"), ("a", 5, "locked"), ("a", 50, "rejected"), ("a", 105, "unlocked"), ("a", 106, "passed")]
