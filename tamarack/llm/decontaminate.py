"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of letters and digits (all that is not an ASCII separator). Documents and
test items are joined on shared runs of ``least`` tokens (seeds). For each pair so found, running
Karp-Rabin looks for the longest matches among tokens not yet marked, marks them, and goes on with
shorter ones down to ``least``; since tiles may lie in any order, reordered passages count as well.
A document is contaminated by an item if tiles cover ``threshold`` of the item's tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import common, hashing
from tamarack.scratch import Scratch
from tamarack.session import ship

LEAST, THRESHOLD = 5, 0.5
#: Benchmarks up to this many bytes of text are sent to every executor; larger ones are joined.
SENT_BYTES = 32 << 20

#: Items that share a seed with a text and are brought to it together, where the benchmark is joined.
ITEMS_BESIDE = 1000

SEPARATORS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def folded(texts: list[bytes]) -> list[bytes]:
    return [t.decode("utf-8", "replace").lower().encode() for t in texts]


def tile(item: np.ndarray, doc: np.ndarray, breaks: np.ndarray, least: int) -> int:
    """Tokens of ``item`` that greedy string tiling covers. ``breaks`` are the places in ``doc`` that no match may run over."""
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    edge = np.zeros(len(doc) + 1, bool)
    edge[breaks] = True

    def runs(free: np.ndarray, width: int, cut: np.ndarray | None) -> np.ndarray:
        """Starts of runs of ``width`` free tokens."""
        ok = np.convolve(free, np.ones(width, int), "valid") == width
        if cut is not None and width > 1:
            ok &= np.convolve(cut[1 : len(free)], np.ones(width - 1, int), "valid") == 0
        return np.flatnonzero(ok)

    width = max(least, min(len(item), 20))
    while width >= least and free_i.any():
        longest, found = 0, []
        if width <= min(len(item), len(doc)):
            at_i, at_d = runs(free_i, width, None), runs(free_d, width, edge)
            hash_i, hash_d = hashing.ngrams(item, width)[at_i], hashing.ngrams(doc, width)[at_d]
            order = np.argsort(hash_i, kind="stable")
            lo, hi = np.searchsorted(hash_i[order], hash_d, "left"), np.searchsorted(hash_i[order], hash_d, "right")
            for d in np.flatnonzero(hi > lo):
                q = int(at_d[d])
                if found and found[-1][2] < q < found[-1][2] + found[-1][0] - width and hi[d] - lo[d] == 1 and int(at_i[order[lo[d]]]) - q == found[-1][1] - found[-1][2]:
                    continue
                for p in at_i[order[lo[d] : hi[d]]]:
                    p, n = int(p), 0
                    while p + n < len(item) and q + n < len(doc) and free_i[p + n] and free_d[q + n] and item[p + n] == doc[q + n] and not (n and edge[q + n]):
                        n += 1
                    if n >= width:
                        found.append((n, p, q))
                        longest = max(longest, n)
        if longest > 2 * width:
            width = longest
            continue
        for n, p, q in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_i[p : p + n].all() and free_d[q : q + n].all():
                free_i[p : p + n] = free_d[q : q + n] = False
            elif n > width:  # part of it is taken: what is left may still be of this width
                keep = free_i[p : p + n] & free_d[q : q + n]
                part = np.flatnonzero(np.diff(np.concatenate(([0], keep.view(np.int8), [0]))))
                for s, e in part.reshape(-1, 2):
                    if e - s >= width:
                        free_i[p + s : p + e] = free_d[q + s : q + e] = False
        if width == least:
            break
        width = max(least, width // 2)
    return int((~free_i).sum())


class Items:
    """The items' tokens and a sorted list of their seeds."""

    def __init__(self, rows: list[tuple[int, bytes]], least: int):
        rows = sorted(rows)
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        _, _, hashes, counts = hashing.words(folded([r[1] for r in rows]), SEPARATORS)[1:] if rows else (0, 0, np.empty(0, np.uint64), np.empty(0, np.int64))
        ends = np.cumsum(counts)
        self.tokens = [hashes[e - n : e] for e, n in zip(ends, counts, strict=True)]
        grams = hashing.ngrams(hashes, least)
        inside = hashing.within(counts, least)
        pairs = np.unique(np.stack((grams[inside], hashing.owner(counts)[: len(grams)][inside].astype(np.uint64)), axis=1), axis=0) if inside.any() else np.empty((0, 2), np.uint64)
        self.grams, self.of = pairs[:, 0], pairs[:, 1].astype(np.int64)
        self.least = least

    def covered(self, hashes: np.ndarray) -> dict[int, float]:
        """Share of each item's tokens that tiles of one document cover, for items that share a seed."""
        grams = hashing.ngrams(hashes, self.least)
        lo, hi = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        hits = np.flatnonzero(hi > lo)
        if not len(hits):
            return {}
        n = hi[hits] - lo[hits]
        place = np.repeat(hits, n)
        which = self.of[np.repeat(lo[hits], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        out = {}
        for item in np.unique(which):
            own = place[which == item]
            inside = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(inside, own, 1)
            np.add.at(inside, own + self.least, -1)
            kept = np.flatnonzero(np.cumsum(inside)[:-1])
            breaks = np.flatnonzero(np.diff(kept) > 1) + 1
            out[int(item)] = tile(self.tokens[item], hashes[kept], breaks, self.least) / len(self.tokens[item])
        return out


def _verdict(found: dict[int, float], ids: np.ndarray, threshold: float) -> tuple[float, int, list[int]]:
    best = max(found.values(), default=0.0)
    over = sorted(int(ids[i]) for i, c in found.items() if c >= threshold)
    return best, len(over), over


SCHEMA = "doc_id long, key binary, contaminated boolean, coverage double, n_items long, item_ids array<long>"


def _judged(texts: list[bytes], items: Items, threshold: float) -> list[tuple[float, int, list[int]]]:
    """Best coverage, and number and list of the items over the threshold, of each text."""
    _, _, hashes, counts = hashing.words(folded(texts), SEPARATORS)[1:]
    grams = hashing.ngrams(hashes, items.least)
    at = np.searchsorted(items.grams, grams)
    hit = np.zeros(len(grams), bool)
    near = at < len(items.grams)
    hit[near] = items.grams[at[near]] == grams[near]
    hit &= hashing.within(counts, items.least)
    some = set(np.unique(hashing.owner(counts)[: len(grams)][hit]).tolist())
    ends = np.cumsum(counts)
    return [_verdict(items.covered(hashes[ends[i] - counts[i] : ends[i]]) if i in some else {}, items.ids, threshold) for i in range(len(texts))]


def _scan(sent, least: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value, least)
        for batch, texts in common.sliced(batches, "text", hashing.PIECE):
            rows = _judged(texts, items, threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array([r[1] > 0 for r in rows], pa.bool_()), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                names=["doc_id", "key", "contaminated", "coverage", "n_items", "item_ids"],
            )

    return run


def _seeds(column: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.sliced(batches, "text", hashing.PIECE):
            _, _, hashes, counts = hashing.words(folded(texts), SEPARATORS)[1:]
            inside = hashing.within(counts, least)
            grams = hashing.ngrams(hashes, least)[inside]
            row = pa.array(hashing.owner(counts)[: len(inside)][inside])
            yield pa.RecordBatch.from_arrays([batch.column(column).take(row), *([batch.column("key").take(row)] if column == "doc_id" else []), pa.array(hashing.signed(grams))], names=[column, *(["key"] if column == "doc_id" else []), "gram"])

    return run


def _against(least: int, threshold: float):
    """Best coverage of a text by the items beside it (``items``: id and text), and those over the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.sliced(batches, "text", hashing.PIECE):
            own = batch.column("items").to_pylist()
            rows = []
            for text, listed in zip(texts, own, strict=True):
                hashes = hashing.words(folded([text]), SEPARATORS)[3]
                items = Items([(i["item_id"], i["item"].encode()) for i in listed], least)
                rows.append(_verdict(items.covered(hashes), items.ids, threshold))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "key", "best", "over"])

    return run


def _sent(spark: SparkSession, benchmark: DataFrame, sent_bytes: int):
    """The items with id and text, and a broadcast of them if their measured size allows it, else None."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).head().n
    return items, spark.sparkContext.broadcast([(r.item_id, r.text.encode()) for r in items.collect()]) if size <= sent_bytes else None


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """One row per document: doc_id, key, contaminated, coverage (the best item's), n_items, item_ids (sorted).

    A benchmark of at most ``sent_bytes`` of text goes to every executor and each text is read once; a
    larger one is joined by seeds. Null and empty texts are clean with coverage 0. Items that are null or
    have fewer than ``least`` tokens match nothing; equal items are reported each; repeated rows get equal
    answers. Other columns are not read. An empty benchmark leaves all documents clean.
    """
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key(F.col("text")).alias("key"), "text")
    items, sent = _sent(spark, benchmark, sent_bytes)
    if sent is not None:
        return texts.mapInArrow(_scan(sent, least, threshold), SCHEMA)
    tables = Scratch(spark, "decontaminate")
    seeds = items.mapInArrow(_seeds("item_id", least), "item_id long, gram long").distinct()
    read = texts.where("text is not null").mapInArrow(_seeds("doc_id", least), "doc_id long, key binary, gram long").distinct()
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))
    pairs = tables.keep(read.join(seeds, "gram").select("doc_id", "key", "item_id").distinct(), "pairs")
    # a text comes once for each ``ITEMS_BESIDE`` of its items, not once for each
    parts = pairs.groupBy("doc_id", "key").agg(F.ceil(F.count("*") / F.lit(ITEMS_BESIDE)).alias("parts"))
    dealt = pairs.alias("p").join(parts.alias("n"), same("p", "n")).select("p.*", F.pmod(F.xxhash64("item_id"), "parts").alias("part"))
    beside = dealt.join(items.withColumnRenamed("text", "item"), "item_id").groupBy("doc_id", "key", "part").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    both = beside.alias("b").join(texts.dropDuplicates(["doc_id", "key"]).alias("t"), same("b", "t")).select("b.doc_id", "b.key", "t.text", "b.items")
    judged = tables.keep(both.mapInArrow(_against(least, threshold), "doc_id long, key binary, best double, over array<long>"), "judged")
    found = judged.groupBy("doc_id", "key").agg(F.max("best").alias("coverage"), F.array_sort(F.flatten(F.collect_list("over"))).alias("item_ids"))
    return texts.drop("text").alias("t").join(found.alias("p"), same("t", "p"), "left").select(
        "t.doc_id", "t.key", (F.coalesce(F.size("item_ids"), F.lit(0)) > 0).alias("contaminated"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.greatest(F.coalesce(F.size("item_ids"), F.lit(0)), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids")
    )


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``contaminated`` does not flag.

    Null and empty texts stay, repeated rows stay or go together, long texts are judged whole, and an empty
    benchmark leaves all rows. Columns of any name and type come through.
    """
    ship(spark)
    sent = _sent(spark, benchmark, sent_bytes)[1]
    if sent is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, least)
            for batch, texts in common.sliced(batches, "text", hashing.PIECE):
                yield batch.filter(pa.array([r[1] == 0 for r in _judged(texts, items, threshold)], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    found = contaminated(spark, docs, benchmark, least, threshold, sent_bytes).where("contaminated").select("doc_id", "key").distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (common.text_key(docs["text"]) == found["key"])
    return docs.join(found, same, "left_anti")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each whole text of ``documents`` against ``benchmark``; see ``contaminated``."""
    return contaminated(spark, common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark")).drop("key")
