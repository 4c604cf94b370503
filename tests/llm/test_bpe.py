import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def test_queue_gives_least_rank_then_leftmost():
    rng, queue, waiting = random.Random(1), bpe.RankQueue(300_000), []
    for _ in range(20_000):
        if rng.random() < 0.55 or not waiting:
            entry = (rng.choice([rng.randrange(300_000), rng.randrange(70), 299_999]), rng.randrange(1000))
            queue.push(*entry)
            waiting.append(entry)
        else:
            assert queue.pop() == min(waiting)
            waiting.remove(min(waiting))
    while len(waiting) > 500:
        assert queue.pop() == min(waiting)
        waiting.remove(min(waiting))
    queue.clear()
    assert queue.top == 0 and not any(queue.low) and not any(queue.middle) and not queue.buckets


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab'stre \n19é漢 ", max_size=200))
def test_as_the_library(ranks, library, text):
    assert ids(bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(text)) == library.encode_ordinary(text)


@pytest.mark.parametrize("piece", ["a" * 5000, "ab" * 3001, "the" * 4000, "漢字" * 1500, "".join(random.Random(5).choice("abcdeinorst") for _ in range(40_000))])
def test_long_pre_tokens(ranks, library, piece):
    assert bpe.Encoder(ranks, public_tokenizers.PATTERN).merge(piece.encode()) == library.encode_ordinary(piece)


def test_stretches_change_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 7)
    text = "it's  a  long\n\n text,   with 12 34 spaces \t and   ends " * 20
    assert ids(bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(text)) == library.encode_ordinary(text)


def test_remembered_pieces_are_bounded(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder, text = bpe.Encoder(ranks, public_tokenizers.PATTERN), "one two three four five six seven one two " * 5
    assert ids(encoder.encode(text)) == library.encode_ordinary(text) and len(encoder.packed) <= 3


def test_rows(spark, docs, plain, empty, library):
    got = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in plain), key=repr)
    assert sorted(((r.doc_id, ids(r.ids), bytes(r.decoded)) for r in got), key=repr) == want
    assert bpe.decode(bpe.encode(empty, PATH, public_tokenizers.PATTERN), PATH).collect() == []
    assert spark.createDataFrame([(1, None)], "doc_id long, ids binary").transform(bpe.decode, PATH).head().decoded is None


def test_no_symbols_for_a_byte(tmp_path):
    (tmp_path / "few").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="byte"):
        bpe.read_ranks(str(tmp_path / "few"))


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    want = set()
    for i, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        found = library.encode_ordinary(text or "")
        packed = b"".join(x.to_bytes(4, "little") for x in found)
        want.add((i, len(found), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op11_byte_bpe(spark, sf).collect()} == want
