"""Documents whose word shingles have a Jaccard similarity of 0.8 or more, by MinHash with Bayesian pruning.

1. Each text gets ``bands`` x ``rows`` MinHash values of one byte. Texts of the same words are one class.
2. Classes that agree on all values of a band share a bucket. Each class goes to the block of its near: the
   least class that it shares a bucket with. Ids are dealt by hash, so large buckets tend to hold the least
   id and a hot group is one near; its block is cut into parts of bounded size.
3. A cell compares two parts of a near, or two parts whose classes share a bucket, and gets of the latter
   only the classes that do. So a pair meets in one cell at most, and classes without a common bucket meet
   only where their blocks are small or hot. Within a cell the MinHash values of each pair are compared
   some at a time; a pair is dropped as soon as the posterior probability (uniform prior) that its
   similarity reaches the threshold falls below ``tolerance``. All others are verified on their whole
   shingle sets. A cell returns its links as counts and a spanning forest, never as pairs.
4. Forests are joined into classes of near duplicates by their least labels.

Where only the classes are asked for, as in ``distinct``, a forest will do, and work follows the number of texts: each
class is held against its near alone first; what is linked by then needs no more. In buckets that still hold several
groups the few outside the largest one are held against it, and only the rest goes to cells as above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import common, hashing
from tamarack.llm.components import components
from tamarack.scratch import Scratch
from tamarack.session import ship

SHINGLE, THRESHOLD, BANDS, ROWS, TOLERANCE = 5, 0.8, 40, 6, 1e-7
#: Classes, and bytes of text, that a part of a block holds on average.
BLOCK, BLOCK_BYTES = 768, 4 << 20
#: Most classes of a bucket outside its largest group that are held against all of it.
FEW = 64
#: Bytes of the table of shared shingles that a cell builds at a time.
TABLE_BYTES = 32 << 20


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts in order (with repeats) and how many each has; a text of 1 to k-1 words has one, of all its words."""
    grams, inside = hashing.ngrams(hashes, k), hashing.within(counts, k)
    of = hashing.owner(counts)[: len(grams)][inside]
    grams = grams[inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        base = np.cumsum(counts) - counts
        extra = np.array([hashing.ngrams(hashes[base[i] : base[i] + counts[i]], int(counts[i]))[0] for i in short], dtype=np.uint64)
        of, grams = np.concatenate((of, short)), np.concatenate((grams, extra))
        order = np.argsort(of, kind="stable")
        of, grams = of[order], grams[order]
    return grams, np.bincount(of, minlength=len(counts))


def _families(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = hashing.mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return seeds[:n], seeds[n:] | np.uint64(1)


def minhashes(grams: np.ndarray, per: np.ndarray, n: int) -> np.ndarray:
    """One byte for each text with shingles and each of ``n`` hash functions."""
    flips, factors = _families(n)
    first = (np.cumsum(per) - per)[per > 0]
    out = np.empty((n, len(first)), dtype=np.uint64)
    work = np.empty_like(grams)
    with np.errstate(over="ignore"):
        for j in range(n):
            np.bitwise_xor(grams, flips[j], out=work)
            np.multiply(work, factors[j], out=work)
            out[j] = np.minimum.reduceat(work, first)
    return (hashing.mix(out).T & np.uint64(0xFF)).astype(np.uint8)


def _identity(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's sequence of words, for texts with words."""
    base = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(base, counts).astype(np.uint64)
        term = hashing.mix(hashes + place * np.uint64(0x9E3779B97F4A7C15))
        first = base[counts > 0]
        return np.add.reduceat(term, first), np.add.reduceat(hashing.mix(term ^ np.uint64(0x5851F42D4C957F2D)), first)


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.sliced(batches, "text", hashing.PIECE):
            _, _, hashes, counts = hashing.words(texts)[1:]
            some = np.flatnonzero(counts > 0)
            if not len(some):
                continue
            grams, per = shingle_hashes(hashes, counts, k)
            values = minhashes(grams, per, bands * rows).reshape(len(some), bands, rows).astype(np.int64)
            keys = np.full((len(some), bands), 0, dtype=np.int64) + (np.arange(bands, dtype=np.int64) << 48)
            for r in range(rows):
                keys += values[:, :, r] << (8 * r)
            c1, c2 = _identity(hashes, counts)
            take = pa.array(some)
            offsets = pa.array(np.arange(0, len(some) * bands + 1, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(hashing.signed(c1)), pa.array(hashing.signed(c2)), pa.array(np.array([len(texts[i]) for i in some], dtype=np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                names=["doc_id", "key", "c1", "c2", "size", "bands"],
            )

    return run


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest of ``n`` equal MinHash values with which P(similarity >= threshold) is not below ``tolerance``.

    Under a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def _prune(signs: np.ndarray, ii: np.ndarray, jj: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    equal, lo, width = np.zeros(len(ii), dtype=np.int32), 0, signs.shape[1]
    for hi in [x for x in (24, 48, 96, 168) if x < width] + [width]:
        equal += (signs[ii, lo:hi] == signs[jj, lo:hi]).sum(axis=1, dtype=np.int32)
        keep = equal >= least_matches(hi, threshold, tolerance)
        ii, jj, equal, lo = ii[keep], jj[keep], equal[keep], hi
    return ii, jj


def _links(texts: list[bytes], signs: np.ndarray, side: np.ndarray, k: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a cell; in a cell of two blocks (no side is -1) only pairs of one text of each, so none if one is empty."""
    n = len(texts)
    two = not (side == -1).any()
    left, right = (np.flatnonzero(side == s) for s in (0, 1)) if two else (np.arange(n), np.arange(n))
    if not len(left) or not len(right):
        return np.empty(0, dtype=int), np.empty(0, dtype=int)
    step = max(1, 100_000 // max(1, len(right)))
    found = []
    for lo in range(0, len(left), step):
        ii, jj = (x.ravel() for x in np.meshgrid(left[lo : lo + step], right, indexing="ij"))
        if not two:
            ii, jj = ii[ii < jj], jj[ii < jj]
        found.append(_prune(signs, ii, jj, threshold, tolerance))
    ii, jj = (np.concatenate([f[s] for f in found]) for s in (0, 1))
    if not len(ii):
        return ii, jj
    sets = []
    for lo, hi in hashing.slices([len(t) for t in texts]):
        _, _, hashes, counts = hashing.words(texts[lo:hi])[1:]
        grams, per = shingle_hashes(hashes, counts, k)
        ends = np.cumsum(per)
        sets += [np.unique(grams[e - p : e]) for p, e in zip(per, ends, strict=True)]
    sizes = np.array([len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    live = shared[place]
    of, rank = np.repeat(np.arange(n), sizes)[live], rank[place[live]]
    both = np.zeros(len(ii), dtype=np.int64)
    width = max(64, TABLE_BYTES * 8 // n // 64 * 64)
    order = np.argsort(rank, kind="stable")
    of, rank = of[order], rank[order]
    for first in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        lo, hi = np.searchsorted(rank, (first, first + width))
        bit = rank[lo:hi] - first
        bits = np.zeros((n, -(-min(width, int(bit[-1]) + 1) // 64) * 8), dtype=np.uint8)
        np.bitwise_or.at(bits, (of[lo:hi], bit // 8), (1 << (bit % 8)).astype(np.uint8))
        words = bits.view(np.uint64)
        step = max(1, 2_000_000 // words.shape[1])
        for at in range(0, len(ii), step):
            part = slice(at, at + step)
            both[part] += np.bitwise_count(words[ii[part]] & words[jj[part]]).sum(axis=1, dtype=np.int64)
    linked = both / (sizes[ii] + sizes[jj] - both) >= threshold
    return ii[linked], jj[linked]


def _roots(n: int, ii: np.ndarray, jj: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = np.minimum(root[ii], root[jj])
        now = root.copy()
        np.minimum.at(now, ii, low)
        np.minimum.at(now, jj, low)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _verify(k: int, bands: int, rows: int, threshold: float, tolerance: float):
    def cell(node: np.ndarray, copies: np.ndarray, side: np.ndarray, keys: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        signs = np.stack([(keys >> (8 * r)) & 0xFF for r in range(rows)], axis=2).astype(np.uint8).reshape(len(node), bands * rows)
        ii, jj = _links(texts, signs, side, k, threshold, tolerance)
        classes = np.bincount(ii, minlength=len(node)) + np.bincount(jj, minlength=len(node))
        docs = np.zeros(len(node), dtype=np.int64)
        np.add.at(docs, ii, copies[jj])
        np.add.at(docs, jj, copies[ii])
        root = _roots(len(node), ii, jj)
        some = np.flatnonzero(classes)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (node[some], node[root[some]], docs[some], classes[some])], names=["node", "root", "docs", "texts"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                node, copies, side, keys, texts = zip(*held, strict=True)
                yield cell(np.array(node), np.array(copies), np.array(side), np.array(keys), list(texts))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cell", "node", "copies", "side")]
            keys = batch.column("bands").flatten().to_numpy().reshape(-1, bands)
            for row, text in enumerate(common.encoded(batch.column("text"))):
                if columns[0][row] != at:
                    yield from done()
                    held, at = [], columns[0][row]
                if not held or held[-1][0] != columns[1][row]:
                    held.append((columns[1][row], columns[2][row], columns[3][row], keys[row].copy(), text))
        yield from done()

    return run


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that grow with the input. Neither is broadcast: Spark sizes a table by its compressed files, and takes an exploded list for one entry."""
    return left.join(right.hint("merge"), on, how)


def _cells(tables: Scratch, classes: DataFrame, block: int) -> DataFrame:
    """(cell, side, node): the classes that each cell compares; side 0 and 1 in a cell of two parts, else -1."""
    dealt = classes.select("node", F.explode("bands").alias("band"))
    heads = dealt.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1").drop("n")
    members = tables.keep(_met(dealt, heads, "band"), "members")
    near = members.groupBy("node").agg(F.min("head").alias("near"))
    near = tables.keep(_met(near, classes.select("node", "size"), "node"), "near")
    sizes = near.groupBy("near").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int")
    placed = _met(near, sizes.select("near", "n", parts.alias("parts")), "near").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    placed = tables.keep(placed.select("node", "near", "part", "parts", "n"), "placed")
    tables.drop("near")
    within = placed.where("n > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    within = within.select("node", "near", "part", F.col("near").alias("near2"), F.col("other").alias("part2"))
    # buckets that hold several nears: each class meets the parts of the other nears in the bucket
    seen = _met(members.select("band", "node"), placed.select("node", "near", "part"), "node")
    mixed = seen.groupBy("band").agg(F.min("near").alias("low"), F.max("near").alias("high")).where("low < high").select("band")
    seen = tables.keep(_met(seen, mixed, "band"), "mixed")
    others = seen.select("band", F.col("near").alias("near2"), F.col("part").alias("part2")).distinct()
    across = _met(seen, others, "band").where("near <> near2").select("node", "near", "part", "near2", "part2").distinct()
    own, other = F.struct("near", "part"), F.struct(F.col("near2").alias("near"), F.col("part2").alias("part"))
    side = F.when(own > other, 1).when(own < other, 0).otherwise(-1)
    low, high = F.least(own, other), F.greatest(own, other)
    return within.unionByName(across).select(F.concat_ws("/", low["near"], low["part"], high["near"], high["part"]).alias("cell"), side.alias("side"), "node")


def _classes(tables: Scratch, docs: DataFrame, k: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key, text); the rows with words and their signatures; and a row for each class of equal words."""
    ship(tables.spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key(F.col("text")).alias("key"), "text")
    signed = tables.keep(texts.where("text is not null").mapInArrow(_sign(k, bands, rows), "doc_id long, key binary, c1 long, c2 long, size long, bands array<long>"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    classes = signed.groupBy("c1", "c2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct(F.coalesce("doc_id", F.lit(0)), "doc_id", "key")).alias("at"), first, F.max("size").alias("size"), F.first("bands").alias("bands"))
    return texts, signed, tables.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")


def _linked(tables: Scratch, cells: DataFrame, classes: DataFrame, texts: DataFrame, verify, name: str) -> DataFrame:
    """(node, root, docs, texts) of the links in cells (cell, side, node): texts are fetched once for each class that is in one."""
    members = _met(cells.groupBy("node").agg(F.collect_list(F.struct("cell", "side")).alias("cells")), classes.select("node", "copies", "at", "bands"), "node")
    same = F.col("m.at.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("m.at.key") == F.col("t.key"))
    fetched = members.alias("m").hint("merge").join(texts.alias("t"), same).select("m.node", "m.copies", "m.bands", "t.text", F.explode("m.cells").alias("c"))
    dealt = fetched.select("c.cell", "c.side", "node", "copies", "bands", "text").repartition("cell").sortWithinPartitions("cell", "node")
    return tables.keep(dealt.mapInArrow(verify, "node long, root long, docs long, texts long"), name)


def _parts(n: Column, size: Column, block: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(block)), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("node"), parts).cast("int")


def _star_cells(members: DataFrame, block: int) -> DataFrame:
    """(cell, side, node): each class against its near, the least head of its buckets, in parts of the near's classes."""
    near = members.groupBy("node").agg(F.min("head").alias("near"), F.first("size").alias("size")).where("near <> node")
    parts = near.groupBy("near").agg(_parts(F.count("*"), F.sum("size"), block).alias("parts"))
    placed = _met(near, parts, "near").select("near", "node", _part(F.col("parts")).alias("part"), "parts")
    cell = F.concat_ws("/", F.lit("near"), "near", "part").alias("cell")
    heads = parts.select("near", F.col("near").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return placed.select(cell, F.lit(1).alias("side"), "node").unionByName(heads.select(cell, F.lit(0).alias("side"), "node"))


def _cells_between(tables: Scratch, members: DataFrame, labels: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """(cell, side, node) for buckets whose classes are in several groups by now.

    If few are outside the largest group of a bucket, each of them meets all of that group, and they meet each other.
    Buckets with the same few classes beside the same group count once. All other buckets go to ``_cells``.
    """
    labelled = tables.keep(_met(members, labels, "node", "left").select("band", "node", "size", F.coalesce("label", "node").alias("label")), "labelled")
    groups = labelled.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    by_band = groups.groupBy("band").agg(F.max_by(F.struct("label", "n", "bytes"), F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    mixed = tables.keep(by_band.where("n > main.n").withColumn("few", (F.col("n") - F.col("main.n") <= FEW) & (F.col("bytes") - F.col("main.bytes") <= BLOCK_BYTES)), "several")
    rest = _met(labelled, mixed.where("not few").select("band"), "band")
    rest = tables.keep(rest.groupBy("node").agg(F.collect_list("band").alias("bands"), F.first("size").alias("size")), "rest")
    own = _met(labelled, mixed.where("few").select("band", F.col("main.label").alias("main"), _parts(F.col("main.n"), F.col("main.bytes"), block).alias("parts")), "band")
    outside = own.where("label <> main")
    beside = outside.groupBy("band").agg(F.xxhash64(F.array_sort(F.collect_list("node"))).alias("beside"))  # at most ``FEW`` of a bucket
    one = tables.keep(_met(own, beside, "band").select("main", "beside", "parts", "node", (F.col("label") == F.col("main")).alias("inside")), "few")
    parts = one.groupBy("main", "beside").agg(F.max("parts").alias("parts"))
    one = one.select("main", "beside", "node", "inside").distinct().join(parts.hint("merge"), ["main", "beside"])
    cell = F.concat_ws("/", F.lit("few"), "main", "beside", "part").alias("cell")
    inside = one.where("inside").withColumn("part", _part(F.col("parts"))).select(cell, F.lit(1).alias("side"), "node")
    against = one.where("not inside").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(cell, F.lit(0).alias("side"), "node")
    among = one.where("not inside").select(F.concat_ws("/", F.lit("among"), "main", "beside").alias("cell"), F.lit(-1).alias("side"), "node")
    return inside.unionByName(against).unionByName(among).unionByName(_cells(Scratch(tables.spark, "jaccard-rest"), rest, block))


def similar(spark: SparkSession, docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, key, group (internal number), class_id, n_links, n_text_links.

    class_id is the least doc_id of the documents that links join, directly or through others; n_links
    counts all other documents at ``threshold`` or above, copies included; n_text_links counts different
    texts. Words are unchanged, sets are of ``k``-word shingles; a text of fewer words has one shingle, of
    all of them. Null and empty texts, and texts without words, link to nothing and keep their own doc_id.
    Repeated rows are copies of each other. Other columns are not read.
    """
    tables = Scratch(spark, "jaccard")
    texts, signed, classes = _classes(tables, docs, k, bands, rows)
    cells = _cells(tables, classes, block)
    links = _linked(tables, cells, classes, texts, _verify(k, bands, rows, threshold, tolerance), "links")
    labels = components(tables, links.select(F.col("root").alias("a"), F.col("node").alias("b")), "groups")
    counted = links.groupBy("node").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    grouped = _met(labels, classes.select("node", "least"), "node")
    least = grouped.groupBy("label").agg(F.min("least").alias("class_id"))
    found = tables.keep(_met(_met(grouped, least, "label"), counted, "node").select("node", "label", "class_id", "docs", "texts"), "found")
    every = _met(classes.select("c1", "c2", "node", "copies", "least"), found, "node", "left")
    out = _met(signed.select("doc_id", "key", "c1", "c2"), every, ["c1", "c2"]).select(
        "doc_id", "key", F.coalesce("label", "node").alias("group"), F.coalesce("class_id", "least").alias("class_id"), (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links")
    )
    wordless = texts.where(F.col("text").isNull() | ~F.col("text").rlike(common.WORD)).select("doc_id", "key", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"))
    return out.unionByName(wordless)


def distinct(spark: SparkSession, docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each group of ``similar``: that of the least doc_id.

    Of repeated rows one stays; rows without words (null and empty texts among them) all stay, as they are in no
    group. Ties in doc_id are broken by the text's hash. Very long texts are compared whole. Columns come through
    under any name but ``__tm_id``, ``__tm_none`` and ``__tm_key``. An empty table gives an empty result. Groups are
    found by a forest of links, so a group of near copies costs in proportion to its size.
    """
    tables = Scratch(spark, "jaccard")
    texts, _, classes = _classes(tables, docs, k, bands, rows)
    verify = _verify(k, bands, rows, threshold, tolerance)
    dealt = classes.select("node", "size", F.explode("bands").alias("band"))
    heads = dealt.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1").drop("n")
    members = tables.keep(_met(dealt, heads, "band"), "dealt")
    ends = lambda links: links.select(F.col("root").alias("a"), F.col("node").alias("b"))
    stars = ends(_linked(tables, _star_cells(members, block), classes, texts, verify, "stars"))
    between = _cells_between(tables, members, components(tables, stars, "star"), classes, block)
    labels = components(tables, stars.union(ends(_linked(tables, between, classes, texts, verify, "between"))), "groups")
    group = F.coalesce("label", "node")
    stay = _met(classes, labels, "node", "left").groupBy(group.alias("group")).agg(F.min("first").alias("first")).select("first.doc_id", "first.key")
    return common.matched(docs.where(F.col("text").rlike(common.WORD)), stay, common.text_key(F.col("text"))).unionByName(docs.where(F.col("text").isNull() | ~F.col("text").rlike(common.WORD)))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of each row of ``documents``; see ``similar``."""
    return similar(spark, common.load(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_text_links")


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p : p + 4], ' ')) END) AS g FROM w),
u AS (SELECT DISTINCT doc_id, md5(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.8),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
cls AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
text AS (SELECT doc_id, md5(array_to_string(ws, ' ')) AS t FROM w),
deg AS (SELECT l.a, count(*) AS n_links, count(DISTINCT CASE WHEN x.t <> y.t THEN y.t END) AS n_text_links FROM link l JOIN text x ON x.doc_id = l.a JOIN text y ON y.doc_id = l.b GROUP BY l.a)
SELECT d.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_text_links, 0)::BIGINT AS n_text_links FROM documents d JOIN cls ON cls.a = d.doc_id LEFT JOIN deg ON deg.a = d.doc_id
"""
