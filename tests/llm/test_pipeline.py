import corpus_pipeline
from tamarack.llm import common, decontaminate, jaccard, language, mixing, sharding


def test_stages_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(d.columns == columns for d in seen[:-1])
    rejected = {r.doc_id for r in language.identify(spark, seen[0]).where("rejected").collect()}
    assert {r.doc_id for r in seen[1].collect()} == {r.doc_id for r in docs.collect()} - rejected
    classes = {r.class_id for r in jaccard.similar(spark, seen[1]).collect()}
    assert sorted(r.doc_id for r in seen[2].collect()) == sorted(classes)
    flagged = {r.doc_id for r in decontaminate.contaminated(spark, seen[2], common.load(spark, sf, "benchmark")).where("contaminated").collect()}
    assert {r.doc_id for r in seen[3].collect()} == classes - flagged
    want = sorted(r.doc_id for r in mixing.mix(spark, seen[3]).collect() for _ in r.draws)
    assert sorted(r.doc_id for r in seen[4].collect()) == want
    assert sorted(r.doc_id for r in seen[5].collect()) == want
    assert sorted(map(str, sharding.shard(spark, seen[4]).collect())) == sorted(map(str, seen[5].collect()))
    assert corpus_pipeline.run(spark, sf).count() == len(want)


def test_odd_rows(spark, docs, empty):
    for rows in (docs, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
