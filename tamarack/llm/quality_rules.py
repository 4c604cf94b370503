"""Quality rules: counts per text, and compression bands over whole texts and fixed chunks.

Repetitive text compresses far better than prose, random text hardly at all. The ratio (bytes before /
after zstandard) depends on length, as short texts give the compressor little to refer to, and on the
script, as a sign of several bytes repeats its first ones. So each band of lengths has limits of its own,
for texts mostly in ASCII and for others. Fixed chunks find the same inside texts whose whole looks
ordinary.

Those limits are for any corpus, hence wide. A second, upper limit comes from the corpus itself: tables and text laden with
symbols compress somewhat better than the prose around them, which shows once length is taken out. For each quarter of an
octave of length the median ratio of the different texts is taken; how far a text lies above it, as a logarithm times the
root of its length, is held against the quartiles of the same over all lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import common, hashing
from tamarack.scratch import Scratch
from tamarack.session import ship


#: Limits of bytes / compressed bytes: (texts under this many bytes, least, most).
Limits = tuple[tuple[float, float, float], ...]


@dataclass(frozen=True)
class Bands:
    """Limits for texts of which most bytes but white space are ASCII, and for others; they hold for chunks too.

    The least ratios lie between those of random letters and digits (at most 1.14, 1.22, 1.32, 1.39 and
    1.41 in these bands; random Han signs 1.07, 1.16, 1.27, 1.37 and 1.40) and the least one of prose in
    English, German, French and Spanish (1.45, 1.35, 1.43, 1.65 and 2.0).
    """

    narrow: Limits = ((256, 1.2, 2.5), (512, 1.28, 2.5), (1024, 1.38, 3.0), (4096, 1.5, 3.5), (32768, 1.6, 4.5), (float("inf"), 1.6, 8.0))
    wide: Limits = ((256, 1.1, 2.5), (512, 1.2, 3.0), (1024, 1.32, 3.5), (4096, 1.42, 4.0), (32768, 1.46, 5.0), (float("inf"), 1.46, 8.0))
    chunk_bytes: int = 1024
    bad_share: float = 0.3
    level: int = 3
    #: How many spreads (upper less lower quartile) above the upper quartile a text may lie, and how far in any case, so that
    #: a corpus of near copies, with next to no spread, does not make its other texts stand out.
    spreads: float = 4.0
    least_far: float = 5.0
    #: Length in bytes beyond which texts are not expected to vary less.
    steady: int = 8192


SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _repeated(hashes: np.ndarray, counts: np.ndarray, k: int = 3) -> np.ndarray:
    """Of each text, the words inside k-word windows that the text has twice or more."""
    of = hashing.owner(counts)
    grams, inside = hashing.ngrams(hashes, k), hashing.within(counts, k)
    out = np.zeros(len(of) + 1, np.int32)
    if inside.any():
        at = np.flatnonzero(inside)
        with np.errstate(over="ignore"):
            keyed = hashing.mix(grams[at] + of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keyed)
        same = keyed[order][1:] == keyed[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(out, at[twice], 1)
        np.add.at(out, at[twice] + k, -1)
    return np.bincount(of[np.cumsum(out)[:-1] > 0], minlength=len(counts))


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.split(None, 1):
            seen.add(line)
    return n


def _is_wide(text: bytes) -> bool:
    bytes_ = np.frombuffer(text, dtype=np.uint8)
    return 2 * int((bytes_ >= 0x80).sum()) > int((~hashing.SPACES[bytes_]).sum())


def _ratios(text: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float | None, float, bool]:
    """Ratio of the whole, share of the bytes in chunks outside their limits, and whether both are within limits.

    The last chunk reaches back to the full size and counts for its own bytes only; a text shorter than a
    chunk is one.
    """
    if not text:
        return None, 0.0, False
    limits, size = bands.wide if _is_wide(text) else bands.narrow, bands.chunk_bytes

    def within(ratio: float, n: int) -> bool:
        least, most = next((lo, hi) for under, lo, hi in limits if n < under)
        return least <= ratio <= most

    whole, bad = len(text) / len(packer.compress(text)), 0
    for i in range(0, len(text), size):
        chunk = text[i : i + size] if i + size <= len(text) else text[-size:]
        if not within(len(chunk) / len(packer.compress(chunk)), len(chunk)):
            bad += min(size, len(text) - i)
    return whole, bad / len(text), within(whole, len(text)) and bad <= bands.bad_share * len(text)


def _measure(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch, texts in common.sliced(batches, "text", hashing.PIECE):
            buf, starts, ends, hashes, counts = hashing.words(texts)
            bounds = np.cumsum([len(t) + 1 for t in texts])
            first = np.concatenate(([0], bounds[:-1]))
            chars = np.add.reduceat((~hashing.SPACES[buf] & ((buf & 0xC0) != 0x80)).astype(np.int64), first)
            symbols = np.add.reduceat(SYMBOLS[buf].astype(np.int64), first)
            repeated = _repeated(hashes, counts)
            ratios = [_ratios(t, bands, packer) for t in texts]
            wide = [_is_wide(t) for t in texts]
            failed = (counts < 50) | (100 * repeated > 50 * counts)
            kept = ~failed & np.array([r[2] for r in ratios], bool)
            numbers = (counts, chars, symbols, np.array([_dup_lines(t) for t in texts]), repeated)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(failed), pa.array(kept),
                    pa.array([r[0] for r in ratios], pa.float64()), pa.array([r[1] for r in ratios], pa.float64()), batch.column("key"), pa.array([len(t) for t in texts], pa.int64()), pa.array(wide),
                ],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_share", "key", "size", "wide"],
            )

    return run


def _limits(measured: DataFrame, bands: Bands) -> DataFrame:
    """(wide, band, middle, far): of each script and quarter of an octave of bytes the median ratio, and how far above it texts may lie.

    Over the different texts that pass the base rules; medians and quartiles are exact, of ratios to three places and
    distances to two. A few hundred rows at most.
    """
    texts = measured.where("not base_failed").groupBy("key").agg(F.first("wide").alias("wide"), F.first("band").alias("band"), F.round(F.first("ratio"), 3).alias("ratio"), F.first("size").alias("size"))
    counted = texts.groupBy("wide", "band", "ratio", F.least("size", F.lit(bands.steady)).alias("size")).count()
    middles = counted.groupBy("wide", "band").agg(F.expr("percentile(ratio, 0.5D, count)").alias("middle"))
    away = counted.join(middles, ["wide", "band"]).select("wide", "count", F.round(F.log(F.col("ratio") / F.col("middle")) * F.sqrt("size"), 2).alias("away"))
    quartiles = away.groupBy("wide", "away").agg(F.sum("count").alias("n")).groupBy("wide").agg(F.expr("percentile(away, array(0.25D, 0.75D), n)").alias("q"))
    far = F.greatest(F.lit(bands.least_far), F.col("q")[1] + bands.spreads * (F.col("q")[1] - F.col("q")[0]))
    return middles.join(quartiles.select("wide", far.alias("far")), "wide")


def compression_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document with its counts, ``base_failed``, ``kept``, ``ratio``, ``bad_share`` and ``most_ratio``.

    Null and empty texts have counts of 0, fail the base rules and have no ratio. Texts are read whole, one
    after the other. ``most_ratio`` is the upper limit that the corpus sets for a text's length; of equal texts one
    counts for it, and where a length has one text alone, that text is its own median. Repeated rows get equal answers;
    other columns are not read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    schema = f"doc_id long, {counts}, base_failed boolean, kept boolean, ratio double, bad_share double, key binary, size long, wide boolean"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key(F.col("text")).alias("key"), "text").mapInArrow(_measure(bands), schema)
    measured = Scratch(docs.sparkSession, "quality-rules").keep(rows.withColumn("band", F.floor(4 * F.log2(F.greatest("size", F.lit(1)))).cast("int")), "measured")
    judged = measured.join(F.broadcast(_limits(measured, bands)), ["wide", "band"], "left")
    most = F.col("middle") * F.exp(F.col("far") / F.sqrt(F.least("size", F.lit(bands.steady))))
    kept = F.col("kept") & F.coalesce(F.round("ratio", 3) <= most, F.lit(True))
    return judged.select("doc_id", *[c.split(" ")[0] for c in counts.split(", ")], "base_failed", kept.alias("kept"), "ratio", "bad_share", most.alias("most_ratio"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every whole text of ``documents``; see ``compression_rules``."""
    return compression_rules(common.load(spark, sf_dir, "documents"))
