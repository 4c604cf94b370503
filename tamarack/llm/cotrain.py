"""Quality classifier by co-training of two views of a document.

The text view sees which hashed words a text has, and measures of its form (repetition, symbols, capitals
and so on). The metadata view sees source, language and length alone. Each is a logistic regression
trained by stochastic gradient descent on labelled rows. In each round both score all unlabelled rows, in
Spark, and each adds the texts it is most sure of, with its label, to what the other learns from. At the end
each view is calibrated, and a logistic regression over both scores combines them, on labelled rows that
neither has seen. A good document has quality 1 and is not toxic.

Features are extracted once and written; rounds and the final scores read that table, never the texts.
"""

from __future__ import annotations

import copy
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import common, hashing
from tamarack.llm.decontaminate import SEPARATORS, folded
from tamarack.scratch import Scratch
from tamarack.session import ship

BUCKETS, META_BUCKETS = 1 << 17, 1 << 12
#: Labelled rows of each class that training may use, of texts with at most so many buckets.
ROWS_EACH, MOST_WORDS = 2000, 20_000
#: Rounds, and texts that a view may add to the other's training rows in each, of each class, if it is so sure.
ROUNDS, TAKEN, SURE = 3, 100, 0.95
#: Share of good held-out rows that the fitted least score may lose.
LOST = 0.005
#: A word has a weight if so many of the training rows have it.
LEAST_ROWS = 8
#: Bytes of the word beginnings that are features too.
STEMS = (5, 7)

_CLASS = np.zeros((256, 5), bool)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (_b in b"#*$%&|<>{}[]=~^@\\", _b < 0x80 and _c.isupper(), _b < 0x80 and _c.isdigit(), _b in b"!?", _b == 0x0A)
FORM = 9


def text_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and word beginnings each text has (each once), how many, and its form measures."""
    low, starts, ends, hashes, counts = hashing.words(folded(texts), SEPARATORS)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    of = hashing.owner(counts)
    keyed = [of * BUCKETS + (hashes >> np.uint64(47)).astype(np.int64)]
    with np.errstate(over="ignore"):
        stem = np.full(len(starts), 7, dtype=np.uint64)
        for j in range(max(STEMS)):
            stem = (stem + low[np.minimum(starts + j, len(low) - 1)]) * np.uint64(0x9E3779B97F4A7C15)
            stem ^= stem >> np.uint64(29)
            if j + 1 in STEMS:
                longer = ends - starts > j + 1
                keyed.append(of[longer] * BUCKETS + (hashing.mix(stem[longer]) >> np.uint64(47)).astype(np.int64))
    seen = np.unique(np.concatenate(keyed))
    per = np.bincount(seen // BUCKETS, minlength=len(texts))
    sizes = np.array([len(t) for t in texts]) + 1
    first = np.cumsum(sizes) - sizes
    form = np.zeros((len(texts), FORM))
    for j in range(5):
        form[:, j] = np.sqrt(np.add.reduceat(_CLASS[:, j][buf].astype(np.int64), first) / sizes)
    n = np.maximum(counts, 1)
    follows = np.zeros(len(hashes), bool)
    follows[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    form[:, 5] = np.bincount(of[follows], minlength=len(texts)) / n
    form[:, 6] = np.minimum(per / n, 3)
    form[:, 7] = np.log1p(counts) / 8
    form[:, 8] = np.minimum(sizes / n, 40) / 20
    return seen % BUCKETS, per, form


def meta_features(source: list, lang: list, size: list) -> np.ndarray:
    """Four buckets of each row: source, language, length, and language with length."""
    rows = []
    for s, g, n in zip(source, lang, size, strict=True):
        scale = "?" if n is None or n < 0 else str(int(n).bit_length())
        rows.append([zlib.crc32(x.encode()) % META_BUCKETS for x in (f"s{s}", f"g{g}", f"n{scale}", f"g{g}n{scale}")])
    return np.array(rows, dtype=np.int64).reshape(-1, 4)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class View:
    """A logistic regression over sparse buckets of weight 1 and a few dense measures, trained with Adagrad."""

    buckets: int
    dense: int
    weights: np.ndarray = field(init=False)
    form: np.ndarray = field(init=False)
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], truth: np.ndarray, epochs: int = 8, rate: float = 0.05, decay: float = 2e-3, seed: int = 1) -> None:
        # a bucket counts by its log odds between the classes, which holds down the many that say nothing
        ids = [r[0] for r in rows]
        flat, mark = np.concatenate(ids), np.repeat(truth, [len(x) for x in ids])
        share = np.array([max(1, (truth == c).sum()) for c in (0, 1)]) / len(truth)
        seen = np.stack([(np.bincount(flat[mark == c], minlength=self.buckets) + 1) / (share[c] * len(truth) + 2) for c in (0, 1)])
        odds = np.abs(np.log(seen[1] / seen[0]))
        odds[np.bincount(flat, minlength=self.buckets) == 0] = 0
        value, self.form, self.bias = np.zeros(self.buckets), np.zeros(self.dense), 0.0
        sparse, dense, one = np.full(self.buckets, 1e-2), np.full(self.dense, 1e-2), 1e-2
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                own, form = rows[i]
                weight = odds[own]
                error = (float(sigmoid(value[own] @ weight + form @ self.form + self.bias)) - truth[i]) / (2 * share[int(truth[i])])
                g = error * weight + decay * value[own]
                sparse[own] += g * g
                value[own] -= rate * g / np.sqrt(sparse[own])
                h = error * form
                dense += h * h
                self.form -= 5 * rate * h / np.sqrt(dense)
                one += error * error
                self.bias -= rate * error / one**0.5
        self.weights = value * odds

    def raw(self, ids: np.ndarray, per: np.ndarray, form: np.ndarray | None) -> np.ndarray:
        total = np.zeros(len(per))
        some = per > 0
        if some.any():
            total[some] = np.add.reduceat(self.weights[ids], (np.cumsum(per) - per)[some])
        return total + self.bias + (form @ self.form if form is not None else 0)

    def chance(self, raw: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * raw + self.scale[1])


def logistic(x: np.ndarray, truth: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a small dense logistic regression with bias (Newton's method), on targets drawn in as Platt does."""
    x = np.column_stack((x, np.ones(len(x))))
    n1, n0 = truth.sum(), (1 - truth).sum()
    y = np.where(truth == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    text: View
    meta: View
    both: np.ndarray
    least: float = 0.5

    def chances(self, ids: np.ndarray, per: np.ndarray, form: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of a good document by the text, by the metadata and by both."""
        a, b = scaled(self.text, self.text.raw(ids, per, form)), scaled(self.meta, self.meta.raw(meta.ravel(), np.full(len(meta), 4), None))
        return sigmoid(a), sigmoid(b), sigmoid(np.column_stack((a, b, np.ones(len(a)))) @ self.both)


def scaled(view: View, raw: np.ndarray) -> np.ndarray:
    return np.clip(view.scale[0] * raw + view.scale[1], -20, 20)


@dataclass
class Rows:
    """Training rows: buckets of the text, its form, buckets of the metadata, and a label (1 or 0)."""

    ids: list[np.ndarray]
    form: list[np.ndarray]
    meta: list[np.ndarray]
    good: list[int]

    def of(self, view: int, often: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        if view == 0:
            return [(i[often[i]], f) for i, f in zip(self.ids, self.form, strict=True)]
        return [(m, np.empty(0)) for m in self.meta]

    def plus(self, other: Rows) -> Rows:
        return Rows(self.ids + other.ids, self.form + other.form, self.meta + other.meta, self.good + other.good)


def cotrain(known: Rows, held: Rows, ask, rounds: int = ROUNDS) -> Model:
    """Both views trained on ``known``; ``held`` only calibrates, combines, and tells which round to keep.

    Of all rounds that one counts after which the combined score is surest of the held-out rows (by log loss), so an exchange that
    teaches the views wrong things costs nothing but time. ``ask(views)`` gives for a round two ``Rows``: what the first view teaches the second, and the reverse.
    """
    views = [View(BUCKETS, FORM), View(META_BUCKETS, 0)]
    learned = [known, known]
    truth = np.array(held.good)
    best: tuple[float, Model] | None = None
    for turn in range(rounds + 1):
        for v, view in enumerate(views):
            n = np.bincount(np.concatenate([*learned[v].ids, np.empty(0, np.int64)]).astype(np.int64), minlength=BUCKETS)
            often = n >= min(LEAST_ROWS, len(learned[v].good) / 50)
            view.train(learned[v].of(v, often), np.array(learned[v].good))
            if len(truth):
                raw = np.array([view.weights[i].sum() + f @ view.form + view.bias for i, f in held.of(v, often)])
                view.scale = tuple(logistic(raw[:, None], truth))
        if len(truth):
            loss, model = _combined(copy.deepcopy(views), held, truth)
            if best is None or loss < best[0]:
                best = loss, model
        if turn == rounds:
            break
        taught = ask(views)
        learned = [learned[0].plus(taught[1]), learned[1].plus(taught[0])]
    return best[1] if best else Model(views[0], views[1], np.array([1.0, 1.0, 0.0]))


def _combined(views: list[View], held: Rows, truth: np.ndarray) -> tuple[float, Model]:
    """The views with their weights in the combined score, and the log loss of that on the held-out rows."""
    every = np.ones(BUCKETS, bool)
    logits = np.column_stack([scaled(view, np.array([view.weights[i].sum() + f @ view.form + view.bias for i, f in held.of(v, every)])) for v, view in enumerate(views)])
    both = logistic(logits, truth)
    chance = sigmoid(np.column_stack((logits, np.ones(len(logits)))) @ both)
    loss = -float(np.log(np.clip(np.where(truth == 1, chance, 1 - chance), 1e-12, 1)).mean())
    return loss, Model(views[0], views[1], both, float(np.quantile(chance[truth == 1], LOST)))


FEATURES = "doc_id long, key binary, n int, ids array<int>, form array<double>, meta array<int>"
_NAMES = ["doc_id", "key", "n", "ids", "form", "meta"]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in common.sliced(batches, "text", hashing.PIECE):
        ids, per, form = text_features(texts)
        meta = meta_features(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
        lists = [
            pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32)), pa.array(ids.astype(np.int32))),
            *(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (form, meta.astype(np.int32))),
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(per.astype(np.int32)), *lists], names=_NAMES)


def extracted(docs: DataFrame) -> DataFrame:
    """The features of each row of ``docs``, as in ``FEATURES``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key(F.col("text")).alias("key"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(_extract, FEATURES)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, how many each row has, forms and metadata of a batch of features."""
    lists = batch.column("ids")
    per = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
    flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "form", "meta")]
    return flat[0].astype(np.int64), per, flat[1].reshape(-1, FORM), flat[2].astype(np.int64).reshape(-1, 4)


def _surest(sent, taken: int, sure: float):
    """Of a partition, the ``taken`` texts of which each view is surest, for each label: (view, good, chance, doc_id, key, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, meta, used = sent.value
        best: dict[tuple[int, int], dict[bytes, tuple]] = {(v, g): {} for v in (0, 1) for g in (0, 1)}
        for batch in batches:
            ids, per, form, buckets = _read(batch)
            keys, owners, ends = batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), np.cumsum(per)
            chances = text.chance(text.raw(ids, per, form)), meta.chance(meta.raw(buckets.ravel(), np.full(len(buckets), 4), None))
            for (v, g), own in best.items():
                chance = chances[v] if g else 1 - chances[v]
                floor = max(sure, min((x[0] for x in own.values()), default=0.0) if len(own) >= taken else 0.0)
                # ties are broken by the text's key, so that reruns agree
                for i in np.flatnonzero(chance >= floor):
                    if keys[i] not in used and keys[i] not in own:
                        own[keys[i]] = (float(chance[i]), owners[i], ids[ends[i] - per[i] : ends[i]].copy(), form[i].copy(), buckets[i].copy())
                if len(own) > taken:
                    best[v, g] = dict(sorted(own.items(), key=lambda x: (-x[1][0], x[0]))[:taken])
        rows = [(v, g, x[0], x[1], key, len(x[2]), *(y.tolist() for y in x[2:])) for (v, g), own in best.items() for key, x in own.items()]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["view", "good", "chance", *_NAMES])

    return run


def _rows(collected: list) -> Rows:
    wide = lambda c, kind: [np.array(r[c], dtype=kind) for r in collected]
    return Rows(wide("ids", np.int64), wide("form", np.float64), wide("meta", np.int64), [int(r["good"]) for r in collected])


def fit(
    features: DataFrame, marks: DataFrame, rows_each: int = ROWS_EACH, most_words: int = MOST_WORDS, rounds: int = ROUNDS, taken: int = TAKEN, sure: float = SURE
) -> Model | None:
    """Train on features and labels (doc_id, good: 1 or 0); None unless both classes have rows.

    About ``rows_each`` labelled rows of each class, chosen by a hash of id and text, and what views take of the
    others: in each round every row is scored, and of the distinct texts that are not learned from yet each view
    gives the other the ``taken`` surest of each class. A text so found that has a label of its own is taught with
    that. Features are never moved but for these rows.
    """
    spark = features.sparkSession
    tables = Scratch(spark, "cotrain")
    marked = features.where(F.col("doc_id").isNotNull() & (F.col("n") <= most_words)).select("doc_id", "key").join(marks, "doc_id").distinct()
    counts = {r.good: r["count"] for r in marked.groupBy("good").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return None
    draw = F.pmod(F.xxhash64(F.lit("cotrain"), "doc_id", "key"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.when(F.col("good") == 1, min(1.0, rows_each / counts[1])).otherwise(min(1.0, rows_each / counts[0]))
    chosen = F.broadcast(marked.where(draw < share))  # bounded by rows_each
    sample = features.join(chosen, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).collect()
    sample.sort(key=lambda r: (r.doc_id, bytes(r.key)))
    apart = np.array([h % 4 == 0 for h in hashing.mix(np.array([r.doc_id for r in sample], dtype=np.int64).view(np.uint64)).tolist()], bool)
    classes = lambda side: {r.good for r, x in zip(sample, apart, strict=True) if x == side}
    if len(classes(True)) < 2 or len(classes(False)) < 2:
        apart = np.zeros(len(sample), bool)
    used: set[bytes] = {bytes(r.key) for r in sample}

    def ask(views: list[View]) -> list[Rows]:
        sent = spark.sparkContext.broadcast((*views, frozenset(used)))
        schema = f"view int, good int, chance double, {FEATURES}"
        found = tables.keep(features.where(F.col("n") <= most_words).mapInArrow(_surest(sent, taken, sure), schema), f"surest-{uuid.uuid4().hex}")
        out: list[list] = [[], []]
        for v in (0, 1):
            for good in (1, 0):
                # of copies the least doc_id stands for the text
                one = found.where((F.col("view") == v) & (F.col("good") == good)).groupBy("key").agg(F.min_by(F.struct("doc_id", "chance", "ids", "form", "meta"), F.coalesce("doc_id", F.lit(2**63 - 1))).alias("r"))
                one = one.select("key", "r.*").orderBy(F.desc("chance"), "key").limit(taken)
                for r in one.join(marks, "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(good))).orderBy(F.desc("chance"), "key").collect():
                    if bytes(r.key) not in used:
                        used.add(bytes(r.key))
                        out[v].append(r)
        return [_rows(x) for x in out]

    known, held = (_rows([r for r, x in zip(sample, apart, strict=True) if x == side]) for side in (False, True))
    del sample
    return cotrain(known, held, ask, rounds)


def _score(sent, least: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        under = least if least is not None else model.least if model else 0.5
        for batch in batches:
            views = model.chances(*_read(batch)) if model else [np.full(batch.num_rows, 0.5)] * 3
            columns = [batch.column("doc_id"), *(pa.array(v) for v in views), pa.array(views[2] >= under)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return run


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, model: Model | None = None, least: float | None = None, **options) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, score (chance of a good document), kept (score >= ``least``,
    by default the score that all but a few of the held-out good rows reach).

    Null texts count as empty, null metadata as a value of its own. A document with several labels is good if
    all say so; rows that share a doc_id share its label. Every text is scored whole; texts of more than ``most_words``
    different features teach nothing and give no pseudo-labels. If either class has no labelled rows, every score is
    0.5. Repeated rows get equal answers; other columns are not read. An empty table gives an empty result.
    """
    ship(spark)
    features = extracted(docs)
    if model is None:
        good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
        marks = labels.where("doc_id is not null and (quality is not null or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when(good, 1).otherwise(0)).alias("good"))
        features = Scratch(spark, "quality").keep(features, "features")
        model = fit(features, marks, **options)
    sent = spark.sparkContext.broadcast(model)
    return features.select(*_NAMES).mapInArrow(_score(sent, least), "doc_id long, text_score double, meta_score double, score double, kept boolean")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document of ``documents``, learned from ``labels``; see ``classify``."""
    return classify(spark, common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels"))
