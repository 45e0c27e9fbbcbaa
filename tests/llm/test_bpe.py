"""BPE against tiktoken, on the test texts and on awkward ones."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from geoloom.llm.bpe import Encoder, RankQueue, decode, encode, load_ranks, merge, round_trip
from geoloom.llm.bpe_query import VOCABULARY, op1_bpe
from tests.conftest import SF_DIR

RANKS = load_ranks(public_tokenizers.path(VOCABULARY))
ENCODER = Encoder(RANKS, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_queue_gives_ranks_in_order():
    queue = RankQueue(100_000)
    for rank in (77_777, 5, 64, 63, 5):
        queue.bucket(rank).append(rank)
    seen = []
    while (rank := queue.first()) is not None:
        seen.append((rank, len(queue.buckets[rank])))
        queue.drop(rank)
    assert seen == [(5, 2), (63, 1), (64, 1), (77_777, 1)] and not any(map(any, queue.levels))


def test_merges_by_rank_then_from_the_left():
    # Here a new pair has a smaller rank than the one it came from, and runs overlap.
    ranks = {bytes([b]): b for b in range(256)} | {b"aba": 300, b"ab": 301, b"aa": 302, b"abab": 303}
    own = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    encoder = Encoder(ranks, r"\S+")
    texts = ["abab", "ababab", "aaaaa", "aabab" * 9, "babaab", "ab" * 200, "a" * 301]
    for text, ids in zip(texts, encoder.encode_all(texts)):
        assert np.frombuffer(ids, np.int32).tolist() == own.encode_ordinary(text)
        assert merge(text.encode(), ranks, encoder.queue) == own.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aabbct eéß中 \n'sll0!?"), max_size=60) | st.text(max_size=40))
def test_like_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ENCODER.encode(text).tolist() == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_000, "abcab" * 9_000, "ththe" * 8_000 + " ", "=-" * 5_000, ""])
def test_very_long_matches(text):
    assert ENCODER.encode(text).tolist() == REFERENCE.encode_ordinary(text)


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = op1_bpe(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = REFERENCE.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_awkward_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (2, "the the", None), (2, "the the", None)],
                               "doc_id long, text string, ids string")
    both = decode(encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    assert both.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.doc_id, bytes(r.decoded)) for r in both.collect()) == [
        (1, b""), (1, b""), (2, b"the the"), (2, b"the the")]
    assert sorted(map(str, round_trip(df, RANKS, public_tokenizers.PATTERN).collect())) == sorted(map(str, both.collect()))
    assert round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    assert encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
