"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

Of the words of many texts at once only those are looked at that lie in a window which its text repeats, since a
run is covered by such windows. On these stretches, each closed by a sign of its own: (1) a Lempel-Ziv
factorisation, whose blocks give squares that cover the leftmost occurrence of every square; (2) the points of
these squares in the suffix tree; (3) walks along suffix links from these points, which find the points of all other
squares (a square's rotation is the suffix link of its point followed by its first word). The leaves below the points
are the occurrences; those of one period at consecutive words merge into a run. Squares whose half is itself a
repetition are left out, as the run has a shorter period then.

The suffix tree is held as an array of suffixes with their common prefixes: a point is an interval of suffixes and a
depth. Each step is done for all texts, blocks or walks at once in numpy. Beside the tree there are the names of all
blocks of 2^l words, by which common extensions to both sides are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import common, hashing
from tamarack.session import ship

LEAST = 24
TIMES = 3
#: Bytes of text read together, and words of stretches in one suffix tree (a longer stretch has its own).
SLICE = 8 << 20
TREE_WORDS = 1 << 19

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixTree:
    """Suffixes of a text of codes whose last one, as every separator in it, occurs once."""

    def __init__(self, text: np.ndarray):
        self.text = np.unique(text, return_inverse=True)[1].astype(np.int64)
        self.n = n = len(text)
        names = [self.text.copy()]
        while (last := names[-1]).max() + 1 < n:
            pair = last * (n + 1)
            width = 1 << (len(names) - 1)
            pair[: n - width] += last[width:] + 1
            order = np.argsort(pair)
            new = np.zeros(n, np.int64)
            new[1:] = pair[order][1:] != pair[order][:-1]
            names[-1] = last.astype(np.int32)
            names.append(np.empty(n, np.int64))
            names[-1][order] = np.cumsum(new)
        self.rank = names[-1]
        self.names = names[:-1]
        self.suffix = np.empty(n, np.int64)
        self.suffix[self.rank] = np.arange(n)
        common_prefix = np.zeros(n, np.int32)
        common_prefix[1:] = self.forward(self.suffix[:-1], self.suffix[1:])
        #: minima[l][r]: least common prefix of neighbours r - 1 and r, ..., r + 2^l - 2 and r + 2^l - 1
        self.minima = [common_prefix]
        while (step := 1 << (len(self.minima) - 1)) * 2 <= n:
            below = self.minima[-1]
            self.minima.append(np.minimum(below[:-step], below[step:]))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the suffixes at i and j agree, where i and j differ."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for level in range(len(self.names) - 1, -1, -1):
            names = self.names[level]
            step = (names[i] == names[j]).astype(np.int64) << level
            i += step
            j += step
        return i - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the prefixes that end before i and j agree, read from their ends, where i and j differ."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for level in range(len(self.names) - 1, -1, -1):
            names = self.names[level]
            a, b = i - (1 << level), j - (1 << level)
            step = ((np.minimum(a, b) >= 0) & (names[np.maximum(a, 0)] == names[np.maximum(b, 0)])).astype(np.int64) << level
            i -= step
            j -= step
        return begin - i

    def point(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last suffix that begin with the ``depth`` words at each place."""
        lo = self.rank[at]
        hi = lo.copy()
        for level in range(len(self.minima) - 1, -1, -1):
            least, width = self.minima[level], 1 << level
            a = lo - width + 1
            lo -= ((a >= 1) & (least[np.clip(a, 0, len(least) - 1)] >= depth)).astype(np.int64) << level
            b = hi + 1
            hi += ((b + width <= self.n) & (least[np.clip(b, 0, len(least) - 1)] >= depth)).astype(np.int64) << level
        return lo, hi

    def child(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, word: np.ndarray) -> np.ndarray:
        """First suffix of the point where its ``depth`` words are followed by ``word``; -1 for none."""
        a, b = lo.copy(), hi + 1
        while (open_ := a < b).any():
            middle = (a + b) // 2
            follows = np.minimum(self.suffix[np.minimum(middle, self.n - 1)] + depth, self.n - 1)
            less = open_ & (self.text[follows] < word)
            a, b = np.where(less, middle + 1, a), np.where(open_ & ~less, middle, b)
        found = a <= hi
        found[found] = self.text[self.suffix[a[found]] + depth[found]] == word[found]
        return np.where(found, a, -1)

    def blocks(self) -> np.ndarray:
        """Where the blocks of the Lempel-Ziv factorisation begin, and the end of the text."""
        suffix, n = self.suffix.tolist(), self.n
        before, after, stack = [-1] * n, [-1] * n, []
        for r, place in enumerate(suffix):
            while stack and suffix[stack[-1]] > place:
                after[stack.pop()] = r
            if stack:
                before[r] = stack[-1]
            stack.append(r)
        longest = np.zeros(n, np.int64)
        for near in (np.array(before), np.array(after)):
            has = np.flatnonzero(near >= 0)
            at = self.suffix[has]
            longest[at] = np.maximum(longest[at], self.forward(at, self.suffix[near[has]]))
        steps, at, out = longest.tolist(), 0, []
        while at < n:
            out.append(at)
            at += steps[at] or 1
        return np.array([*out, n])


def _upto(limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each limit the numbers 1 to it: whose they are, and the numbers."""
    limits = np.maximum(limits, 0)
    of = np.repeat(np.arange(len(limits)), limits)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(limits) - limits, limits) + 1


def _covering(tree: SuffixTree, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares (start, period) of periods up to ``most`` from which rotations to the right reach the leftmost occurrence of every such square."""
    begins = tree.blocks()
    sizes = np.diff(begins)
    starts, periods = [], []
    # centred in a block, with the right half going on behind it
    of, k = _upto(np.minimum(sizes[:-1], most))
    edge = begins[1:-1][of]
    q = edge - k
    right, left = tree.forward(edge, q), tree.backward(edge, q)
    ok = (right + left >= k) & (right > 0)
    starts.append(np.maximum(q - left, q - k + 1)[ok])
    periods.append(k[ok])
    # beginning before a block, with the centre in it
    of, k = _upto(np.minimum(sizes + np.append(sizes[1:], 0), most))
    edge, end = begins[:-1][of], begins[1:][of]
    q = edge + k
    of, k, edge, end, q = (x[q < tree.n] for x in (of, k, edge, end, q))
    right, left = tree.forward(edge, q), tree.backward(edge, q)
    start = np.maximum(edge - left, edge - k + 1)
    ok = (right + left >= k) & (right > 0) & (left > 0) & (start + k <= end)
    starts.append(start[ok])
    periods.append(k[ok])
    return np.concatenate(starts), np.concatenate(periods)


def _primitive(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the k words at each start are no repetition of fewer words: tried for k over each of its prime factors."""
    factor = np.arange(int(k.max(initial=0)) + 1)
    for p in range(2, int(len(factor) ** 0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, len(factor), p)] = p
    out, rest = np.ones(len(k), bool), k.copy()
    while (more := np.flatnonzero(out & (rest > 1))).size:
        d = k[more] // factor[rest[more]]
        out[more] = tree.forward(start[more], start[more] + d) < k[more] - d
        rest[more] //= factor[rest[more]]
    return out


def _vocabulary(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points (first suffix, last suffix, period) of all squares that the given ones lead to along suffix links.

    As long as a walk stays inside the run it began in, its next points are known to exist and are taken at once;
    then the suffix link's point is asked for the child by the square's first word. Walks end at points met before.
    """
    seen: set[int] = set()
    points: list[tuple[np.ndarray, ...]] = []
    while len(start):
        steps = np.minimum(k, tree.forward(start, start + k) - k + 1)
        of, step = _upto(steps)
        at, period = start[of] + step - 1, k[of]
        lo, hi = tree.point(at, 2 * period)
        keys, first = np.unique(lo * (tree.n + 1) + period, return_index=True)
        fresh = first[[key not in seen for key in keys.tolist()]]
        seen.update(keys.tolist())
        points.append((lo[fresh], hi[fresh], period[fresh]))
        last = start + steps - 1
        lo, hi = tree.point(last + 1, 2 * k - 1)
        child = tree.child(lo, hi, 2 * k - 1, tree.text[last])
        keys, first = np.unique(np.where(child >= 0, child * (tree.n + 1) + k, -1), return_index=True)
        first = first[[key >= 0 and key not in seen for key in keys.tolist()]]
        start, k = tree.suffix[child[first]], k[first]
    return tuple(np.concatenate(x) for x in zip(*points))


def runs_of(text: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs of at least ``least`` words and ``times`` periods, by period and start.

    ``text`` holds codes, of which the last and each separator occur once; ``times`` is at least 2.
    """
    tree = SuffixTree(text)
    once = np.flatnonzero(np.bincount(tree.text)[tree.text] == 1)
    longest = int(np.diff(once, prepend=-1).max()) - 1
    start, k = _covering(tree, longest // times)
    own = np.unique(start * (tree.n + 1) + k)
    start, k = own // (tree.n + 1), own % (tree.n + 1)
    whole = _primitive(tree, start, k)
    if not whole.any():
        return (np.empty(0, np.int64),) * 3
    lo, hi, k = _vocabulary(tree, start[whole], k[whole])
    of, nth = _upto(hi - lo + 1)
    found = np.sort(k[of] * (tree.n + 1) + tree.suffix[lo[of] + nth - 1])
    new = np.flatnonzero(np.diff(found, prepend=-2) != 1)
    last = np.append(new[1:], len(found)) - 1
    period, start = found[new] // (tree.n + 1), found[new] % (tree.n + 1)
    length = found[last] - found[new] + 2 * period
    ok = length >= np.maximum(least, times * period)
    return start[ok], length[ok], period[ok]


def _stretches(hashes: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that lie in windows which their text has twice or more."""
    of = hashing.owner(counts)
    at = np.flatnonzero(hashing.within(counts, window))
    with np.errstate(over="ignore"):
        keys = hashing.mix(hashing.ngrams(hashes, window)[at] + of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    twice = at[np.unique(np.concatenate((order[same], order[same + 1])))]
    change = np.zeros(len(of) + 1, np.int32)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + window, -1)
    inside = np.flatnonzero(np.cumsum(change)[:-1] > 0)
    if not len(inside):
        return inside, inside
    cut = np.flatnonzero((np.diff(inside) > 1) | (np.diff(of[inside]) > 0))
    return inside[np.append(0, cut + 1)], inside[np.append(cut, len(inside) - 1)] + 1


def runs_in(hashes: np.ndarray, counts: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of texts that are laid end to end: first word (over all texts), length and period, by first word and period.

    In a run of at least ``least`` words and ``times`` periods, every word lies in a window of ``least - least // times``
    words that recurs one period on or before, so only stretches of such windows are searched.
    """
    begins, ends = _stretches(hashes, counts, least - least // times)
    found = [np.empty((3, 0), np.int64)]
    for a, b in hashing.slices((ends - begins).tolist(), TREE_WORDS):
        begin, size = begins[a:b], ends[a:b] - begins[a:b]
        of, nth = _upto(size)
        place = np.cumsum(size + 1) - size - 1
        text = np.empty(int(size.sum()) + len(size), np.int64)
        codes = np.unique(hashes[begin[of] + nth - 1], return_inverse=True)[1]
        text[place[of] + nth - 1] = codes
        text[place + size] = len(codes) + np.arange(len(size))
        start, length, period = runs_of(text, least, times)
        stretch = np.searchsorted(place, start, "right") - 1
        found.append(np.stack((begin[stretch] + start - place[stretch], length, period)))
    out = np.concatenate(found, axis=1)
    return tuple(out[:, np.lexsort((out[2], out[0]))])


def _collapsed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """Of each text the kept words, joined by one space."""
    out, change = buf.copy(), np.zeros(len(buf) + 1, np.int8)
    out[ends[kept]] = 0x20
    change[starts[kept]] = 1
    np.add.at(change, ends[kept] + 1, -1)
    inside = np.cumsum(change, dtype=np.int8)[:-1] > 0
    size = np.bincount(hashing.owner(counts)[kept], (ends - starts + 1)[kept], len(counts)).astype(np.int64)
    whole, at, texts = out[inside].tobytes(), 0, []
    for n in size.tolist():
        texts.append(whole[at : at + max(n - 1, 0)])
        at += n
    return texts


def _find(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.sliced(batches, "text", SLICE):
            buf, starts, ends, hashes, counts = hashing.words(texts)
            start, length, period = runs_in(hashes, counts, least, times)
            first = np.cumsum(counts) - counts
            of = hashing.owner(counts)[start]
            change = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            kept = np.cumsum(change)[:-1] == 0
            runs = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(length), pa.array(period)], fields=list(_RUN))
            ends_at = np.cumsum(np.bincount(of, minlength=len(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends_at)), runs), pa.array(_collapsed(buf, starts, ends, counts, kept), pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per document: doc_id, n_words, ``runs`` (array of start, length, period, by start, then period) and ``collapsed``.

    A run is a stretch of words with a smallest period, of at least ``least`` words and ``times`` periods, that no
    neighbouring word extends. ``collapsed`` is the text without the words that lie in a run behind its first period,
    joined by one space. Null and empty texts have no words and no runs. Texts are read whole; memory follows the
    words of the longest text that lie in repeated windows, times the logarithm of their number. Runs may overlap; of
    equal words each counts where it stands. Repeated rows get equal answers; other columns are not read. An empty
    table gives an empty result.
    """
    if times < 2 or least < 2 * times:
        raise ValueError("a run has two periods at least, and twice as many words as periods")
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_find(least, times), "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def made_periodic(doc_id: Column, words: Column) -> Column:
    """The text of ``words`` in which, by the checksum h of doc_id, word i from a = h / 10 % n on is word a + (i - a) % p."""
    n, g = F.size(words), F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 10)
    a = (g % F.nullif(n, F.lit(0))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of ``documents``, of which one in ten is made periodic first; see ``periodic_runs``."""
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    docs = docs.withColumn("words", F.when(chosen, F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0))))
    docs = docs.select("doc_id", F.when(F.size("words") > 0, made_periodic(F.col("doc_id"), F.col("words"))).otherwise(F.col("text")).alias("text"))
    longer = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), longer)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = periodic_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
