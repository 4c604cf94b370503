"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are its byte 2- to 4-grams inside words (a word's edge counts as one byte), hashed to
buckets. Each bucket has an embedding; a text is the average of its n-grams' embeddings, and a linear
softmax over it gives the languages and one class more, for what is in none of them. Both are trained
together by stochastic gradient descent in numpy; the further class learns from noise: training words with
their letters dealt anew, random letters, and random signs of other scripts. As the softmax is linear,
scoring needs only the product of the two matrices.

The score is the softmax under a temperature fitted on rows kept from training. Rejection is calibrated on
the same rows, by length: of those rows and of pieces of them, all but a share ``lost`` of each band of
lengths reach the band's least score (a split conformal bound). Texts below it are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import common, hashing
from tamarack.session import ship

BUCKETS, DIMENSIONS, EPOCHS, RATE = 1 << 15, 16, 4, 0.5
#: Labelled rows and bytes of each language that training and calibration may use, in texts of at most so
#: many bytes, and the number of languages (the most frequent ones) that are learned.
ROWS_EACH, BYTES_EACH, TEXT_BYTES, LANGUAGES = 700, 8 << 20, 1 << 20, 200
#: Share of the kept rows' pieces that each band of lengths may reject.
LOST = 0.002
#: Bands of lengths: texts under so many bytes.
BANDS = (16, 32, 64, 128, 256, 512, float("inf"))
#: Noise texts for each text that is learned from.
NOISE = 0.7
UNKNOWN = "und"
# Where blocks of 96 signs begin in Greek, Cyrillic, Arabic, Devanagari, kana, Han and Hangul.
_SCRIPTS = (0x370, 0x400, 0x600, 0x900, 0x3040, 0x4E00, 0xAC00)

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.array([b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)], dtype=np.uint8)
_CHUNK = 1 << 20


def _codes(b: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram at each place of ``b`` but the last three; ``buckets`` where it isn't inside one word."""
    m = len(b) - 3
    letter = b != 0x20
    code = b[:m].astype(np.uint32)
    for i in range(1, n):
        code |= b[i : m + i].astype(np.uint32) << np.uint32(8 * i)
    inside = letter[1 : m + 1].copy()
    if n == 2:
        inside |= letter[:m]
    if n == 3:
        inside &= letter[:m] | letter[2 : m + 2]
    if n == 4:
        inside &= letter[2 : m + 2]
    code = (code * np.uint32(2654435761) ^ (code >> np.uint32(15)) * np.uint32(2246822519 + 2 * n)) >> np.uint32(32 - buckets.bit_length() + 1)
    return np.where(inside, code, np.uint32(buckets))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts lower-cased and folded, each between spaces, and where each begins."""
    low = [b"  " + t.decode("utf-8", "replace").lower().encode() + b"  " for t in texts]
    return _FOLD[np.frombuffer(b"".join(low) + b"   ", dtype=np.uint8)], np.cumsum([0, *(len(t) for t in low)])[:-1]


def sums(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``table`` over the n-grams of each text, in pieces of bounded size."""
    buckets = len(table) - 1
    columns = [np.ascontiguousarray(table[:, j]) for j in range(table.shape[1])]
    buf, first = _joined(texts)
    out = np.zeros((len(texts), table.shape[1]), dtype=np.float64)
    for a in range(0, len(buf) - 3, _CHUNK):
        part = buf[a : min(len(buf), a + _CHUNK + 3)]
        lo, hi = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, a + len(part) - 3, "left")
        cuts = np.maximum(first[lo:hi] - a, 0)
        for n in (2, 3, 4):
            codes = _codes(part, n, buckets)
            for j, column in enumerate(columns):
                out[lo:hi, j] += np.add.reduceat(column[codes], cuts)
    return out


def band_of(sizes: np.ndarray) -> np.ndarray:
    """Band of each number of bytes."""
    return np.searchsorted(np.array(BANDS), sizes, side="right")


@dataclass
class Model:
    """``table`` has a column for each label, one for what is in none of them, and one that counts n-grams."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: tuple[float, ...] = (0.0,) * len(BANDS)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        total = sums(texts, self.table)
        return total[:, :-1] / np.maximum(total[:, -1:], 1) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Chance of each label; what is left of 1 is the chance of none."""
        return softmax(self.logits(texts) / self.temperature)[:, :-1]

    def accepts(self, texts: list[bytes], scores: np.ndarray) -> np.ndarray:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        return scores.max(axis=1, initial=0.0) >= np.array(self.least)[band_of(sizes)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bags(texts: list[bytes], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for text in texts:
        buf, _ = _joined([text])
        codes = np.concatenate([_codes(buf, n, buckets) for n in (2, 3, 4)])
        ids, times = np.unique(codes[codes < buckets], return_counts=True)
        out.append((ids, (times / max(1, times.sum())).astype(np.float32)))
    return out


def noise(text: bytes, rng: np.random.Generator) -> bytes:
    """Words as long as those of a run of ``text``, of its own letters dealt anew, of random letters, or of another script."""
    words = text.decode("utf-8", "replace").split()
    n = int(rng.integers(1, 65))
    first = int(rng.integers(0, max(1, len(words) - n + 1)))
    words = words[first : first + n]
    letters = [c for w in words for c in w]
    kind = rng.integers(3)
    if kind == 0:
        rng.shuffle(letters)
    elif kind == 1:
        letters = [chr(97 + c) for c in rng.integers(0, 26, len(letters))]
    else:
        letters = [chr(rng.choice(_SCRIPTS) + c) for c in rng.integers(0, 96, len(letters))]
    ends = np.cumsum([len(w) for w in words]).tolist()
    return " ".join("".join(letters[e - len(w) : e]) for w, e in zip(words, ends, strict=True)).encode()


def pieces(text: bytes, rng: np.random.Generator) -> list[bytes]:
    """The text, and four runs of its words for each of the lengths 1, 2, 4, ... 128."""
    words = text.split()
    out = [text]
    for n in (1, 2, 4, 8, 16, 32, 64, 128):
        if n < len(words):
            out += [b" ".join(words[a : a + n]) for a in rng.integers(0, len(words) - n + 1, 4)]
    return out


def calibrate(model: Model, texts: list[bytes], truth: np.ndarray, lost: float, rng: np.random.Generator) -> None:
    """Fit the temperature and each band's least score on texts that were not learned from."""
    logits = model.logits(texts)
    # an error in n + 2 is allowed for, else rows that are all right would ask for certainty
    doubt = 1 / (len(texts) + 2)
    hope = np.full(logits.shape, doubt / len(model.labels))
    hope[np.arange(len(texts)), truth] = 1 - doubt
    line = 2.0 ** np.arange(-4, 4.01, 0.1)
    loss = [-(hope * np.log(softmax(logits / t) + 1e-300)).sum(axis=1).mean() for t in line]
    model.temperature = float(line[int(np.argmin(loss))])
    least: list[list[np.ndarray]] = [[] for _ in BANDS]
    for text in texts:
        parts = [p for p in pieces(text, rng) if _LETTER.search(p.decode("utf-8", "replace"))]
        if parts:
            score = model.scores(parts).max(axis=1)
            for s, band in zip(score, band_of(np.array([len(p) for p in parts])), strict=True):
                least[band].append(s)
    # the k-th least score; where the rows are too few to tell, half the least
    ranked = [np.sort(x) for x in least]
    model.least = tuple(float(x[int(lost * (len(x) + 1)) - 1]) if lost * (len(x) + 1) >= 1 else float(x[0]) / 2 if len(x) else 0.0 for x in ranked)


def train(
    texts: list[bytes], langs: list[str], held: np.ndarray, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS,
    rate: float = RATE, lost: float = LOST, share: float = NOISE, seed: int = 1,
) -> Model:
    """A model from labelled texts; those in ``held`` are kept from training and fit temperature and least scores."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    learned = np.flatnonzero(~held)
    other = [noise(texts[i], rng) for i in rng.permutation(learned)[: int(np.ceil(share * len(learned)))]]
    embed = (rng.standard_normal((buckets, dimensions)) / dimensions).astype(np.float32)
    weights = np.zeros((dimensions, len(labels) + 1), dtype=np.float32)
    bias = np.zeros(len(labels) + 1, dtype=np.float32)
    # a text is learned from as a whole and by one run of its words, so that short texts are known as well
    runs = [(i, p) for i in learned for p in rng.permutation(np.array(pieces(texts[i], rng)[1:], dtype=object))[:1]]
    truth = np.array([labels.index(x) for x in langs] + [labels.index(langs[i]) for i, _ in runs] + [len(labels)] * len(other))
    bags = _bags([*texts, *(p for _, p in runs), *other], buckets)
    used = np.concatenate((~held, np.ones(len(runs) + len(other), bool)))
    rows = np.flatnonzero(used & np.array([len(b[0]) > 0 for b in bags], bool))
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(rows):
            ids, part = bags[i]
            pace = rate * (1 - step / steps)
            step += 1
            mean = part @ embed[ids]
            error = softmax(mean @ weights + bias)
            error[truth[i]] -= 1
            back = weights @ error
            weights -= pace * np.outer(mean, error)
            bias -= 0.1 * pace * error
            embed[ids] -= pace * part[:, None] * back
    table = np.zeros((buckets + 1, len(labels) + 2), dtype=np.float32)
    table[:-1, :-1] = embed @ weights
    table[:-1, -1] = 1
    model = Model(labels, table, bias)
    own = np.flatnonzero(held)
    if len(own):
        calibrate(model, [texts[i] for i in own], truth[own], lost, rng)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0 (also without an id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def fit(docs: DataFrame, rows_each: int = ROWS_EACH, bytes_each: int = BYTES_EACH, text_bytes: int = TEXT_BYTES, languages: int = LANGUAGES, **options) -> Model | None:
    """Train on a bounded sample of labelled rows; None without any.

    Of each of the ``languages`` most frequent languages about ``rows_each`` rows and ``bytes_each`` bytes
    are taken, of texts of at most ``text_bytes``, chosen by a hash of id and text. Repeated rows count once.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= text_bytes))
    counted = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    counts = {r.lang: min(1.0, rows_each / r.n, bytes_each / max(1, r.bytes)) for r in counted.orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return None
    # rows of a language fall in [0, rate) of the hash, so their number is close to the bound and never far above
    rate = F.create_map(*[x for lang, share in sorted(counts.items()) for x in (F.lit(lang), F.lit(share))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = known.where(draw < rate[F.col("lang")]).select("doc_id", "lang", "text").distinct().collect()
    sample.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    ids = np.array([r.doc_id for r in sample], dtype=np.int64).view(np.uint64)
    held = np.array([h % 5 == 0 for h in hashing.mix(ids).tolist()], bool)
    return train([r.text.encode() for r in sample], [r.lang for r in sample], held, **options)


def _judge(model: Model | None, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the best label (-1 for none), its score, and whether the text is accepted."""
    lettered = np.array([bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in texts], bool)
    if model is None or not lettered.any():
        return np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
    given = model.scores(texts)
    best, score = given.argmax(axis=1), given.max(axis=1)
    return np.where(lettered, best, -1), np.where(lettered, score, 0.0), lettered & model.accepts(texts, given)


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch, texts in common.sliced(batches, "text", _CHUNK):
            best, score, fine = _judge(model, texts)
            names = [model.labels[b] if b >= 0 else UNKNOWN for b in best]
            own = [batch.column(c) for c in ("doc_id", "key", "held_out")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(names, pa.string()), pa.array(score), pa.array(~fine)], names=["doc_id", "key", "held_out", "lang_pred", "score", "rejected"]
            )

    return run


def identify(spark: SparkSession, docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """One row per document: doc_id, key, held_out, lang_pred, score, rejected.

    Without a model, one is trained on the labelled rows of ``docs``. Texts that are null or have no letter
    are ``und`` with score 0 and rejected; so are all if nothing is labelled. Other texts get a learned
    language, and ``rejected`` if the score is below the least one of their length. Texts are read whole,
    in pieces of bounded size. Repeated rows get equal answers; of other columns only ``lang`` is read, for
    training. An empty table gives an empty result.
    """
    ship(spark)
    model = model or fit(docs, **options)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key(F.col("text")).alias("key"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predict(sent), "doc_id long, key binary, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(spark: SparkSession, docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``identify`` does not reject.

    So rows whose text is null or has no letter go, repeated rows stay or go together, and without any
    labelled row none stays.
    """
    ship(spark)
    model = model or fit(docs, **options)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.sliced(batches, "text", _CHUNK):
            yield batch.filter(pa.array(_judge(sent.value, texts)[2]))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``; see ``identify``."""
    return identify(spark, common.load(spark, sf_dir, "documents")).drop("key")
