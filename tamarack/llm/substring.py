"""Removal of passages that repeat across or within documents, by seed and extend.

Every window of ``window`` consecutive words is governed by one anchor: the smallest hash among its
``seed``-word n-grams (winnowing; the rightmost of equal ones). Equal windows have equal anchors, so
documents are joined on anchors. The windows that an anchor occurrence governs are consecutive: its
context, the words reached by extending the seed to the left and to the right. Two occurrences with
the same context match over all of it. Where the contexts of an anchor differ, each distinct context
is extended step by step: the seed extended by i words to the left and the rest to the right is
compared, by hash, with the same extension of all other contexts, all partners at once, so no pairs
are made. What matches is held against one partner, the least occurrence elsewhere (a star), and the
pieces that follow each other in both texts are joined to maximal repeats. Their words are removed.

Two windows are held equal if the hashes of their anchors and their own hashes, 64 bits each, agree:
windows around different seeds would have to agree in 128 bits, those around one seed in 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm import common, hashing
from tamarack.scratch import Scratch
from tamarack.session import ship

WINDOW, SEED = 35, 8


def _governed(hashes: np.ndarray, counts: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor occurrence: text, first window, windows, anchor, context hash."""
    span = window - seed + 1
    valid = hashing.within(counts, window)
    starts = np.flatnonzero(valid)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    grams = hashing.ngrams(hashes, seed)
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    packed = (grams & ~low) | (low - place)
    packed[~hashing.within(counts, seed)] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least, width = packed, 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < span:
        rest = span - width
        least = np.minimum(least[:-rest], least[rest:])
    at = (low - (least[starts] & low)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 0) | (np.diff(starts) != 1))))
    whole = hashing.ngrams(hashes, window)[starts]
    n = np.diff(np.concatenate((cut, [len(starts)])))
    step = np.arange(len(starts)) - np.repeat(cut, n)
    with np.errstate(over="ignore"):
        context = hashing.mix(np.add.reduceat(hashing.mix(whole + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), cut))
    of = hashing.owner(counts)[starts[cut]]
    first = starts[cut] - (np.cumsum(counts) - counts)[of]
    return of, first, n, hashing.signed(grams[at[cut]]), hashing.signed(context)


def _anchors(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.sliced(batches, "text", hashing.PIECE):
            _, _, hashes, counts = hashing.words(texts)[1:]
            of, first, n, anchor, context = _governed(hashes, counts, window, seed)
            if len(of):
                ids, keys = (batch.column(c).take(pa.array(of)) for c in ("doc_id", "key"))
                columns = [ids, keys, pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(context)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "start", "n", "anchor", "context"])

    return run


def _extended(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.sliced(batches, "text", hashing.PIECE):
            _, _, hashes, counts = hashing.words(texts)[1:]
            whole = hashing.signed(hashing.ngrams(hashes, window))
            base = np.cumsum(counts) - counts
            runs = batch.column("runs")
            per = np.asarray(pa.compute.list_value_length(runs))
            flat = runs.flatten()
            first, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            row = np.repeat(np.arange(len(texts)), per)
            total = int(n.sum())
            step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            of_run = np.repeat(np.arange(len(n)), n)
            start = first[of_run] + step
            take = pa.array(of_run)
            rows = pa.array(row[of_run])
            for lo in range(0, total, 200_000):
                part = slice(lo, min(total, lo + 200_000))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows[part]), batch.column("key").take(rows[part]), pa.array(start[part].astype(np.int32)), flat.field(2).take(take[part]), pa.array(whole[base[row[of_run[part]]] + start[part]]), flat.field(3).take(take[part])],
                    names=["doc_id", "key", "start", "anchor", "match", "single"],
                )

    return run


def _cut(with_text: bool):
    return lambda batches: _cut_spans(batches, with_text)


def _cut_spans(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch, texts in common.sliced(batches, "text", 4 * hashing.PIECE):
        spans = batch.column("spans")
        per = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(spans), 0))
        first, stop = (spans.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        ends = np.cumsum(per)
        out: tuple[list, ...] = ([], [], [], [])
        for text, n, end in zip(texts, per, ends, strict=True):
            words = text.split()
            gone = np.zeros(len(words) + 1, np.int32)
            np.add.at(gone, first[end - n : end], 1)
            np.add.at(gone, stop[end - n : end], -1)
            keep = np.cumsum(gone)[:-1] == 0
            kept = b" ".join([words[i] for i in np.flatnonzero(keep)] if n else words)
            out[0].append(len(words))
            out[1].append(int(len(words) - keep.sum()))
            out[2].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out[3].append(kept.decode())
        m = 3 + with_text
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out[:m], kinds[:m], strict=True))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 1 + m])


def _occurrence() -> Column:
    return F.struct(F.col("doc_id").alias("doc_id"), F.col("start").alias("start"))


def _partner() -> Column:
    """The least occurrence elsewhere: ``low`` of the group, and ``high`` for the least one itself."""
    return F.when(_occurrence().eqNullSafe(F.col("low")), F.col("high")).otherwise(F.col("low"))


def repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Word spans ``[start, stop)`` of each (doc_id, key) that windows found elsewhere cover, with the partner
    {doc_id, start} that each was found at; not yet merged.

    Whole texts and all documents take part. Anchors, contexts and extensions are counted with partial
    aggregation, so a passage or text that a third of the rows share meets in no single task.
    """
    if not 1 <= seed <= window:
        raise ValueError("the seed must fit the window")
    ship(spark)
    tables = Scratch(spark, "substring")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key(F.col("text")).alias("key"), "text").where(F.col("text").isNotNull())
    runs = tables.keep(texts.mapInArrow(_anchors(window, seed), "doc_id long, key binary, start int, n int, anchor long, context long"), "runs")
    ends = [F.min(_occurrence()).alias("low"), F.max(_occurrence()).alias("high")]
    # written before the join, which Spark can then split where one anchor has very many rows
    seen = runs.groupBy("anchor").agg(F.count("*").alias("seen"), (F.min("context") != F.max("context")).alias("mixed"), *ends)
    seen = tables.keep(seen.where("seen > 1").drop("seen"), "seen")
    again = tables.keep(runs.join(seen, "anchor").withColumn("other", F.when(~F.col("mixed"), _partner())).drop("low", "high"), "again")
    tables.drop("runs", "seen")
    mixed = again.where("mixed").drop("other")
    at = F.min(F.struct(F.coalesce("doc_id", F.lit(0)), "doc_id", "key", "start", "n")).alias("at")
    contexts = tables.keep(mixed.groupBy("anchor", "context").agg(F.count("*").alias("times"), at, *ends), "contexts")
    same = mixed.join(contexts.where("times > 1").select("anchor", "context", "low", "high"), ["anchor", "context"]).withColumn("other", _partner())
    wanted = contexts.select("at.doc_id", "at.key", F.struct("at.start", "at.n", "anchor", (F.col("times") == 1).alias("single")).alias("run")).groupBy("doc_id", "key").agg(F.collect_list("run").alias("runs"))
    alike = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.key") == F.col("w.key"))
    parts = texts.alias("t").join(wanted.alias("w"), alike).select("t.doc_id", "t.key", "t.text", "w.runs")
    grown = tables.keep(parts.mapInArrow(_extended(window), "doc_id long, key binary, start int, anchor long, match long, single boolean"), "grown")
    twice = tables.keep(grown.groupBy("anchor", "match").agg(F.count("*").alias("times"), *ends).where("times > 1").drop("times"), "twice")
    ragged = grown.where("single").join(twice, ["anchor", "match"]).withColumn("other", _partner())
    span = lambda df, n: df.select("doc_id", "key", "start", (F.col("start") + n + F.lit(window - 1)).cast("int").alias("stop"), "other")
    return span(again.where("not mixed"), F.col("n")).unionByName(span(same, F.col("n"))).unionByName(span(ragged, F.lit(1)))


def maximal_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, key, start, stop, other_id, other_start): spans of ``window`` words or more that are equal at a partner.

    Positions count words from 0. Matches of one document with one partner that go on at the same distance are
    one repeat, as long as possible. The partner of a match is the least occurrence, by (doc_id, start), with the
    same context (or, where contexts differ, the same window); where it changes, a repeat ends and the next one
    begins within it. Null and short texts have none; repeated rows match each other.
    """
    found = repeats(spark, docs, window, seed).select("doc_id", "key", "start", "stop", F.col("other.doc_id").alias("other_id"), (F.col("other.start") - F.col("start")).alias("shift")).distinct()
    # a group holds the matches of one text with one other
    group = Window.partitionBy("doc_id", "key", "other_id", "shift").orderBy("start", "stop")
    before = F.max("stop").over(group.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= before - F.lit(window - 1), 0).otherwise(1)
    numbered = found.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(group.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("doc_id", "key", "other_id", "shift", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return joined.select("doc_id", "key", "start", "stop", "other_id", (F.col("start") + F.col("shift")).alias("other_start"))


def dedup_substrings(spark: SparkSession, docs: DataFrame, window: int = WINDOW, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by a space).

    ``with_text=False`` leaves kept_text out.

    Null, empty and short texts lose nothing (0 words, the hash of nothing, for null). Repeated rows count
    as documents of their own, so all of a repeated row of 35 words or more goes. Other columns are not
    read. An empty table gives an empty result.
    """
    spans = maximal_repeats(spark, docs, window, seed).select("doc_id", "key", "start", "stop").distinct().groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    both = texts.alias("t").join(spans.alias("s"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.key") == F.col("s.key")), "left").select("t.doc_id", "t.key", "t.text", "s.spans")
    return both.mapInArrow(_cut(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each whole text of ``documents`` loses; see ``dedup_substrings``."""
    return dedup_substrings(spark, common.load(spark, sf_dir, "documents"), with_text=False)


OP4_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p : p + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM win SEMI JOIN rep USING (h)) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(qs), 0) AS removed,
  array_to_string(CASE WHEN qs IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(qs, i)) END, ' ') AS t FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, removed::BIGINT AS n_removed, sha256(t) AS kept_sha256 FROM kept
"""
