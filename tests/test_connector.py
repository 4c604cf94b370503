"""The connector format in batches and streams, with a restart between batches."""

import json

import pytest

from tamarack.sources import connector, feeds


def page(folder, name, *ids):
    (folder / name).write_text(json.dumps({"places": [{"id": i, "displayName": {"text": f"é {i}"}} for i in ids]}, ensure_ascii=False), encoding="utf-8")


@pytest.fixture
def folder(spark, tmp_path):
    connector.install(spark)
    path = tmp_path / "pages"
    path.mkdir()
    page(path, "a.json", "1", "2")
    page(path, "b.json")
    page(path, "c.json", "3")
    return path


def test_batch(spark, folder):
    (folder / "d.json").write_text("{broken", encoding="utf-8")
    (folder / "notes.txt").write_text("no page")
    df = spark.read.format("connector").option("connector", "recorded").option("each", "1").load(str(folder))
    assert df.rdd.getNumPartitions() == 4
    rows = sorted(map(tuple, df.collect()), key=str)
    assert [(r[1], r[2], json.loads(r[3])["id"]) for r in rows if r[3]] == [("a.json", 0, "1"), ("a.json", 1, "2"), ("c.json", 0, "3")]
    assert [(r[1], r[2], r[4].split(":")[0]) for r in rows if not r[3]] == [("d.json", 0, "JSONDecodeError")]
    valid, invalid = feeds.validated(df.where("payload is not null").selectExpr("position", "payload as raw"))
    assert {r.name for r in feeds.candidates(valid, "recorded").collect()} == {"é 1", "é 2", "é 3"} and invalid.count() == 0


def test_empty_folder_and_unknown_connector(spark, tmp_path):
    connector.install(spark)
    (tmp_path / "none").mkdir()
    assert spark.read.format("connector").load(str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="no connector is named"):
        spark.read.format("connector").option("connector", "other").load(str(tmp_path)).collect()
    with pytest.raises(ValueError, match="registered"):
        connector.register("recorded")(connector.Recorded)


def test_stream_goes_on_after_a_restart(spark, folder, tmp_path):
    def run():
        stream = spark.readStream.format("connector").option("perBatch", "2").load(str(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.ref, r.position) for r in spark.read.schema(connector.RAW).parquet(str(tmp_path / "out")).collect())

    assert run() == [("a.json", 0), ("a.json", 1), ("c.json", 0)]
    assert run() == [("a.json", 0), ("a.json", 1), ("c.json", 0)]
    page(folder, "d.json", "4")
    page(folder, "e.json", "5", "6")
    assert run() == [("a.json", 0), ("a.json", 1), ("c.json", 0), ("d.json", 0), ("e.json", 0), ("e.json", 1)]
