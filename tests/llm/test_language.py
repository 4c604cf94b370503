import random
import zlib

from tamarack.llm import language

WORDS = {"aa": ["the", "and", "with", "thing", "other", "house"], "bb": ["der", "und", "nicht", "schön", "häuser", "über"], "cc": ["les", "être", "avec", "maison", "où", "déjà"]}


def corpus(spark, n=300):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 40))), lang, "s", "clash"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(spark, docs, rows_each=60).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = corpus(spark)
    from pyspark.sql import functions as F

    wrong = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, language.identify(spark, d, rows_each=60).collect())) for d in (docs, wrong))
    assert a == b


def test_odd_rows(spark, docs, plain):
    rows = language.identify(spark, docs).collect()
    assert len(rows) == len(plain)
    for r in rows:
        if r.doc_id in (130, 131, 132, 133):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id == 134:
            assert r.lang_pred in ("en", "de")
    got = language.accepted(spark, docs)
    assert got.columns == docs.columns and got.where("doc_id in (130, 131, 132, 133)").count() == 0


def test_nothing_to_learn(spark, docs, empty):
    from pyspark.sql import functions as F

    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(spark, unlabelled).collect()} == {"und"}
    assert language.identify(spark, empty).count() == 0


def test_chunks_do_not_matter(monkeypatch):
    texts = [("wort " * 40).encode(), b"", "über häuser".encode(), b"x", b" "]
    model = language.train([b"the house", "über häuser".encode()] * 5, ["aa", "bb"] * 5, __import__("numpy").zeros(10, bool), buckets=1 << 10, epochs=2)
    whole = model.scores(texts)
    monkeypatch.setattr(language, "_CHUNK", 16)
    assert abs(model.scores(texts) - whole).max() < 1e-6


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.",
    "Съешь же ещё этих мягких французских булок, да выпей чаю",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である",
    "asdkjh qwlkej zmxncb",
    "jkdfh sdkjfh weriuy cvbnm zxqwe " * 20,
]
SF = "/root/testdata/sf0.01"


def test_tables_are_kept_and_the_rest_is_rejected(spark):
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect() if r.lang and r.text}
    rows = [r for r in language.identify(spark, docs, model).collect() if r.held_out and r.doc_id in truth]
    assert len(rows) > 100
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in rows) / len(rows) > 0.98
    assert sum(r.rejected for r in rows) / len(rows) < 0.02
    assert not language._judge(model, [t.encode() for t in FOREIGN])[2].any()
    # runs of words of held-out texts stay, noise of the same lengths goes
    rng = np.random.default_rng(4)
    for n, least_noise in ((4, 0.8), (16, 0.9), (64, 0.9)):
        texts = [truth[r.doc_id][1].encode().split() for r in rows]
        runs = [b" ".join(t[a : a + n]) for t in texts if len(t) > n for a in rng.integers(0, len(t) - n, 3)]
        assert language._judge(model, runs)[2].mean() > 0.97
        assert 1 - language._judge(model, [language.noise(x, rng) for x in runs])[2].mean() > least_noise


def test_the_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, langs, held, **o: seen.append((texts, langs)))
    rows = [(i, f"text {i} " * 10, f"l{i % 5}" if i % 9 else "rare") for i in range(2000)] + [(7001, "x" * 3000, "l1")] * 50 + [(7003, "same", "l1")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language.fit(docs, rows_each=40, text_bytes=2000, languages=4)
    texts, langs = seen[0]
    assert len(set(langs)) == 4 and max(map(len, texts)) <= 2000
    assert all(langs.count(g) < 100 for g in set(langs)) and texts.count(b"same") <= 1
