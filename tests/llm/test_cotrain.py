import random

import numpy as np

from tamarack.llm import cotrain


def corpus(n=500):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(words) for _ in range(60))
        if not good:
            text = " ".join([rng.choice(words)] * 30) + " " + text if rng.random() < 0.5 else text.replace(" ", " badword ", 5)
        rows.append((i, text, "en", "trusty" if good and rng.random() < 0.8 else "other", len(text), "clash"))
        if i % 2:
            labels.append((i, int(good or "badword" in text), int("badword" in text)))
    truth = {r[0]: "badword" not in r[1] and len(set(r[1].split()[:30])) > 5 for r in rows}
    return rows, labels, truth


def test_held_out_accuracy(spark):
    rows, labels, truth = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in cotrain.classify(spark, docs, marks).collect()}
    other = [i for i in truth if i % 2 == 0]
    assert np.mean([(got[i].score >= 0.5) == truth[i] for i in other]) > 0.9
    assert np.mean([got[i].kept for i in other if truth[i]]) > 0.93
    assert np.mean([got[i].meta_score for i in other if truth[i]]) > np.mean([got[i].meta_score for i in other if not truth[i]])
    assert all(0 <= r.score <= 1 for r in got.values())


def test_views_teach_each_other(spark, monkeypatch):
    rows, labels, truth = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    marks = spark.createDataFrame([x for x in labels if x[0] < 150], "doc_id long, quality int, toxic int")
    asked = []
    own = cotrain.cotrain

    def seen(known, held, ask, rounds):
        def heard(views):
            asked.append(ask(views))
            return asked[-1]

        return own(known, held, heard, rounds)

    monkeypatch.setattr(cotrain, "cotrain", seen)
    a = {r.doc_id: r.score for r in cotrain.classify(spark, docs, marks, rounds=0).collect()}
    assert not asked
    b = {r.doc_id: r.score for r in cotrain.classify(spark, docs, marks, rounds=2, taken=10, sure=0.55).collect()}
    assert len(asked) == 2 and all(len(side.good) <= 20 for two in asked for side in two) and sum(len(side.good) for two in asked for side in two) > 10
    assert a != b
    again = {r.doc_id: r.score for r in cotrain.classify(spark, docs.repartition(7), marks, rounds=2, taken=10, sure=0.55).collect()}
    assert max(abs(again[i] - b[i]) for i in b) < 1e-9


def test_the_surest_of_all_rows_are_found(spark):
    """Against a sort of every unlabelled text in plain numpy, with copies that count once."""
    rows, _, _ = corpus(200)
    rows += [(1000 + i, rows[3][1], "en", "other", 5, "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(6)
    features = cotrain.extracted(docs)
    rng = np.random.default_rng(3)
    views = [cotrain.View(cotrain.BUCKETS, cotrain.FORM), cotrain.View(cotrain.META_BUCKETS, 0)]
    for v in views:
        v.weights, v.form = rng.standard_normal(v.buckets), rng.standard_normal(v.dense)
    got = features.mapInArrow(cotrain._surest(spark.sparkContext.broadcast((*views, frozenset())), 7, 0.5), f"view int, good int, chance double, {cotrain.FEATURES}").collect()
    best = {bytes(r.key): r.chance for r in sorted((r for r in got if (r.view, r.good) == (0, 1)), key=lambda r: r.chance)}
    chance = {}
    for r in features.collect():
        raw = views[0].weights[np.array(r.ids, int)].sum() + np.array(r.form) @ views[0].form
        chance[bytes(r.key)] = float(cotrain.sigmoid(raw))
    want = sorted((c for c in chance.values() if c >= 0.5), reverse=True)[:7]
    assert np.allclose(sorted(best.values(), reverse=True)[:7], want)


def test_held_out_labels_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    learned = labels.where("pmod(xxhash64('test', doc_id), 4) <> 0")
    score = {r.doc_id: r.score for r in cotrain.classify(spark, docs, learned).collect()}
    rest = [(score[r.doc_id], int(r.quality == 1 and r.toxic != 1)) for r in labels.collect() if r.doc_id not in {x.doc_id for x in learned.select("doc_id").collect()} and r.doc_id in score]
    good, bad = ([s for s, y in rest if y == k] for k in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.8, auc


def test_repeated_ids_and_reruns(spark):
    rows, labels, _ = corpus(120)
    rows += [(1, "another text " * 20, "en", "other", 5, "x"), (None, "no id here " * 9, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = (sorted((str(r.doc_id), round(r.score, 9)) for r in cotrain.classify(spark, d, marks).collect()) for d in (docs, docs.repartition(5)))
    assert a == b and len(a) == len(rows)


def test_odd_rows(spark, docs, empty, plain):
    marks = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 0), (5, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int")
    rows = cotrain.classify(spark, docs, marks).collect()
    assert len(rows) == len(plain) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in cotrain.classify(spark, docs, marks.limit(0)).collect()} == {0.5}
    assert cotrain.classify(spark, empty, marks).count() == 0
