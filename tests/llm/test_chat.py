import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.llm import chat

TALKS = [
    (1, 0, "system", "be <|im_start|> good"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "a\\b </s>"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "é漢\n<|im_end|>\n"),
    (2, 0, "user", "only"), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (3, 0, None, "null role"), (None, 0, "assistant", "no id"), (4, None, "user", "null turn"), (4, 2, "assistant", "y"), (5, 0, "we\nird<s>\\", "r"), (5, 1, "assistant", "<<<SYS>>>" + "z" * 50_000),
]


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*t, "extra", 1) for t in TALKS], "conv_id long, turn long, role string, text string, formatted string, loss_start int")


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_round_trip(talks):
    by = {}
    for c, n, r, t in TALKS:
        by.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    want = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        want[c] = (len(turns), digest("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), digest(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.examples(talks)).collect()}
    assert got == want


def test_examples(talks):
    rows = {(r.conv_id, r.turn): r for r in chat.examples(talks).collect()}
    assert {k for k in rows if k[0] == 1} == {(1, 2), (1, 4), (1, 5)}
    assert not rows[(2, 0)].trained and rows[(2, 0)].loss_length == 0
    one = rows[(1, 2)]
    assert one.formatted[one.loss_start : one.loss_start + one.loss_length] == "a\\\\b <\\/s>"
    assert one.formatted.count("<|im_start|>") == 3 and one.formatted.endswith("<|im_end|>\n")
    assert rows[(1, 5)].formatted.startswith(one.formatted)


@given(st.lists(st.text(alphabet="\\<>[]|/sINST_imendart\n é", max_size=40), min_size=1, max_size=20))
@settings(max_examples=15, deadline=None)
def test_escape_is_reversible_and_total(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(c in r.e for c in chat.CONTROL)


def test_empty(spark, talks):
    assert chat.read_back(chat.examples(talks.limit(0))).count() == 0
