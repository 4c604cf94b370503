from pyspark.sql import functions as F

from tamarack.llm import decontaminate, jaccard


def test_texts_of_one_32_bit_hash_stay_apart(spark):
    texts = spark.range(500_000).select(F.concat(F.lit("one two three four w"), F.col("id").cast("string")).alias("text"))
    a, b = texts.groupBy(F.hash("text").alias("hash")).agg(F.sort_array(F.collect_list("text")).alias("same")).where("size(same) > 1").orderBy("hash").head().same[:2]
    for doc_id in (None, 7):
        docs = spark.createDataFrame([(doc_id, a), (doc_id, b)], "doc_id long, text string")
        assert {r.text for r in jaccard.distinct(spark, docs).collect()} == {a, b}
        items = spark.createDataFrame([(1, a)], "item_id long, text string")
        assert [r.text for r in decontaminate.clean(spark, docs, items, sent_bytes=0).collect()] == [b]
