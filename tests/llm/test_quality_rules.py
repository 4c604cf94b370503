import base64
import math
import random
import re
import statistics
import string
from collections import Counter

import numpy as np
import pytest
import zstandard

from tamarack.llm import hashing, quality_rules

BANDS = quality_rules.Bands()


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
    again = {q for p in range(len(w) - 2) if grams[tuple(w[p : p + 3])] > 1 for q in range(p, p + 3)}
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_counts_against_brute_force(spark, docs):
    more = spark.createDataFrame([(900, "a b c\na b c\n\n  \n  \n#x* $%&|<> a b c\na b c", "k")], "doc_id long, text string, size string").unionByName(docs.select("doc_id", "text", "key").withColumnRenamed("key", "size"))
    want = sorted(((r.doc_id, *base(r.text)) for r in more.collect()), key=str)
    got = quality_rules.compression_rules(more).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_bands(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(words) for _ in range(800))
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(6)) for _ in range(400))
    # each word differs from the last by its number, so that no three-word window repeats, yet it compresses far too well
    counting = " ".join(f"customer{i:05d}" for i in range(1500))
    mixed = prose + " " + " ".join(f"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa{i}" for i in range(300))
    got = {r.doc_id: r for r in quality_rules.compression_rules(spark.createDataFrame([(1, prose), (2, noise), (3, counting), (4, mixed), (5, None), (6, "")], "doc_id long, text string")).collect()}
    assert got[1].kept and not got[1].base_failed
    assert not got[3].base_failed and not got[3].kept
    assert not got[4].base_failed and not got[4].kept
    assert not got[2].base_failed and not got[2].kept
    assert got[5].base_failed and got[5].ratio is None and not got[6].kept


def verdict(text):
    """The bands anew, in plain Python."""
    data, packer = text.encode(), zstandard.ZstdCompressor(level=3)
    solid = [b for b in data if b not in b" \t\n\x0b\x0c\r"]
    limits = BANDS.wide if 2 * sum(b >= 0x80 for b in solid) > len(solid) else BANDS.narrow

    def fine(piece):
        for under, least, most in limits:
            if len(piece) < under:
                return least <= len(piece) / len(packer.compress(piece)) <= most

    bad, left = 0, len(data)
    for i in range(0, len(data), 1024):
        own = min(1024, left)
        bad += 0 if fine(data[max(0, i + own - 1024) : i + own]) else own
        left -= own
    return fine(data) and bad <= 0.3 * len(data)


def random_words(rng, n, letters, low=2, high=8):
    out = []
    while sum(map(len, out)) + len(out) < n:
        out.append("".join(rng.choice(letters) for _ in range(rng.randint(low, high))))
    return " ".join(out)


@pytest.mark.parametrize("size", [300, 500, 700, 1100, 2500, 6000, 20_000, 80_000])
def test_incompressible_texts_are_rejected(spark, size):
    rng = random.Random(size)
    signs = string.ascii_letters + string.digits
    blob = base64.b64encode(rng.randbytes(size)).decode()
    rows = [
        random_words(rng, size, signs),
        " ".join(blob[i : i + 5] for i in range(0, size, 6)),
        random_words(rng, size // 3 + 60, [chr(c) for c in range(0x4E00, 0x9F00)], 2, 4),
        random_words(rng, size, [chr(c) for c in range(33, 127)], 1, 7),
    ]
    got = quality_rules.compression_rules(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert not any(r.base_failed and r.n_words >= 50 for r in got)
    assert not any(r.kept for r in got)


def most_ratios(texts):
    """The corpus's own limits anew: {text: most ratio} of texts that pass the base rules."""
    packer = zstandard.ZstdCompressor(level=3)
    rows = {}
    for t in {t for t in texts if t and not base(t)[5]}:
        data = t.encode()
        solid = [b for b in data if b not in b" \t\n\x0b\x0c\r"]
        rows[t] = (2 * sum(b >= 0x80 for b in solid) > len(solid), math.floor(4 * math.log2(len(data))), round(len(data) / len(packer.compress(data)), 3), min(len(data), 8192))
    middle = {k: statistics.median(r[2] for r in rows.values() if r[:2] == k) for k in {r[:2] for r in rows.values()}}
    out = {}
    for wide in (False, True):
        away = [round(math.log(r[2] / middle[r[:2]]) * math.sqrt(r[3]), 2) for r in rows.values() if r[0] == wide]
        if away:
            low, high = np.percentile(away, [25, 75])
            far = max(5, high + 4 * (high - low))
            out |= {t: middle[r[:2]] * math.exp(far / math.sqrt(r[3])) for t, r in rows.items() if r[0] == wide}
    return out, {t: r[2] for t, r in rows.items()}


def is_junk(text):
    w = text.split()
    return base(text)[2] > 0.25 * len(w)


def test_kept_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect() if r.text}
    most, ratio = most_ratios(t for t, _ in texts.values())
    got = [r for r in quality_rules.compression_rules(docs).collect() if r.doc_id in texts]
    for r in got:
        t = texts[r.doc_id][0]
        assert r.kept == (not r.base_failed and verdict(t) and ratio[t] <= most[t]), r.doc_id
    able = [(r, texts[r.doc_id]) for r in got if not r.base_failed]
    clean = [r for r, (t, _) in able if not is_junk(t)]
    assert all(r.kept for r in clean) and {g for _, (_, g) in able} == {"en", "de", "fr", "es"}
    junk = [r for r, (t, _) in able if is_junk(t)]
    assert sum(not r.kept for r in junk) > 0.2 * len(junk)


def test_copies_do_not_set_the_limits(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    near = prose(300).split()
    rows = [prose(rng.randint(80, 900)) for _ in range(200)] + [" ".join(near)] * 100 + [" ".join(near[:i] + ["other"] + near[i + 1 :]) for i in range(200)]
    got = quality_rules.compression_rules(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert all(r.kept for r in got)


def test_a_long_word_is_read_in_pieces():
    word = b"ab" * 3_000_000
    one, two = hashing.words([word + b" x"]), hashing.words([word[:-1] + b"c x"])
    assert one[4].tolist() == [2] and one[2].tolist()[0] == len(word) and one[3][0] != two[3][0] and one[3][1] == two[3][1]


def test_empty(empty):
    assert quality_rules.compression_rules(empty).count() == 0
