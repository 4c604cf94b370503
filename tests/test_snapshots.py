"""Snapshots and chained logs: what was touched is told."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tamarack.sources import snapshots


def people(spark, *rows):
    return spark.createDataFrame(rows, "id long, name string, tags array<string>")


def test_digest_of_a_multiset(spark):
    rows = [(1, "a", ["x"]), (2, None, None), (2, None, None), (3, "é", [])]
    one = snapshots.digest(people(spark, *rows)).head()
    assert one == snapshots.digest(people(spark, *rows[::-1]).repartition(3).select("tags", "id", "name")).head()
    for other in (rows[:3], rows + rows[:1], [(1, "b", ["x"]), *rows[1:]], [(1, "a", ["x"]), (2, "", None), *rows[2:]], [rows[0], rows[0], *rows[1:3]]):
        assert snapshots.digest(people(spark, *other)).head() != one
    assert snapshots.digest(people(spark).limit(0)).head().rows == 0


@pytest.mark.parametrize("harm", ["none", "row", "file", "table", "schema", "manifest"])
def test_a_restored_copy_is_told(spark, tmp_path, harm):
    path = str(tmp_path / "s")
    snapshots.snapshot({"people": people(spark, (1, "a", None), (2, "b", ["c"])).repartition(2), "empty": people(spark).limit(0)}, path)
    table = f"{path}/tables/people"
    if harm == "row":
        changed = spark.read.parquet(table).withColumn("name", F.when(F.col("id") == 1, "z").otherwise(F.col("name"))).collect()
        people(spark, *changed).write.mode("overwrite").parquet(table)
    elif harm == "file":
        os.remove(next(os.path.join(table, f) for f in sorted(os.listdir(table)) if f.endswith(".parquet") and os.path.getsize(os.path.join(table, f)) > 900))
    elif harm == "table":
        shutil.rmtree(table)
    elif harm == "schema":
        spark.createDataFrame([(1, "a")], "id int, name string").write.mode("overwrite").parquet(table)
    elif harm == "manifest":
        shutil.rmtree(f"{path}/manifest")
    got = {r.name: (r.ok, r.error) for r in snapshots.verify(spark, path).collect()}
    if harm == "manifest":
        assert list(got) == [None] and "no manifest" in got[None][1]
    else:
        assert got["empty"] == (True, None) and got["people"][0] == (harm == "none") and (got["people"][1] is None) == (harm == "none")


def test_log_tells_what_was_done_to_it(spark, tmp_path):
    def written(name):
        log = snapshots.ChainedLog(spark, str(tmp_path / name))
        for i in range(3):
            assert log.append(people(spark, (i, f"n{i}", None), (i, "same", None)), F.lit("2026-01-01").cast("timestamp")) == i
        return log

    log = written("whole")
    assert log.check() == [] and log.read().count() == 6 and sorted({r.batch for r in log.read().collect()}) == [0, 1, 2]
    assert snapshots.ChainedLog(spark, str(tmp_path / "none")).check() == []

    def harmed(name, harm):
        log = written(name)
        harm(lambda kind, i: os.path.join(log.path, kind, f"batch={i}"))
        return log.check()

    def swap(at):
        for kind in ("rows",):
            os.rename(at(kind, 0), at(kind, 9))
            os.rename(at(kind, 1), at(kind, 0))
            os.rename(at(kind, 9), at(kind, 1))

    def swap_all(at):
        swap(at)
        os.rename(at("chain", 0), at("chain", 9))
        os.rename(at("chain", 1), at("chain", 0))
        os.rename(at("chain", 9), at("chain", 1))

    assert harmed("changed", lambda at: people(spark, (1, "n1", None), (1, "other", None)).withColumn("at", F.lit("2026-01-01").cast("timestamp")).write.mode("overwrite").parquet(at("rows", 1))) == ["batch 1 was changed"]
    assert harmed("dropped", lambda at: shutil.rmtree(at("rows", 1))) == ["batch 1 is gone"]
    assert harmed("swapped", swap) == ["batch 0 was changed", "batch 1 was changed"]
    assert any("does not follow" in w for w in harmed("swapped_all", swap_all))
    assert any("does not follow" in w for w in harmed("cut", lambda at: [shutil.rmtree(at(k, 0)) for k in ("rows", "chain")]))
    assert harmed("unlinked", lambda at: shutil.rmtree(at("chain", 2))) == ["batch 2 has no link"]
