"""Repeated word sequences against a dictionary of all windows, the index against scans, and the defined cases."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest

from geoloom.llm import substrings
from geoloom.llm.fmindex import Index, suffix_order
from geoloom.llm.substrings import remove_repeats, segments, without_words
from geoloom.llm.substrings_query import op11_substrings


def expected(rows, window=13):
    """(id, words, removed, kept) of all rows."""
    split = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    least = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            if i is not None:
                w = tuple(words[k: k + window])
                least[w] = min(least.get(w, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and least[tuple(words[k: k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def run(spark, rows, window=13, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    out = remove_repeats(df, window)
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()], key=str)


@pytest.fixture(params=[False, True], ids=["whole", "overfull"])
def small(monkeypatch, request):
    """Small pieces and many shards, as they are or with every bucket overfull."""
    monkeypatch.setattr(substrings, "PIECE", 600)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 3_000)
    if request.param:
        monkeypatch.setattr(substrings, "SENT", 1e-9)


def test_random_texts(spark, small):
    draw = random.Random(4)
    passages = [[draw.choice("abcdefgh") * draw.randrange(1, 3) for _ in range(draw.randrange(8, 60))] for _ in range(12)]
    rows = []
    for i in range(160):
        words = []
        for _ in range(draw.randrange(1, 5)):
            words += [draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(0, 30))]
            cut = draw.randrange(0, 9)
            words += draw.choice(passages)[cut:]
        rows.append((draw.randrange(120), draw.choice([" ", "\n", " \t"]).join(words)))
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows, 3) == expected(rows, 3)


def test_defined_cases(spark, small):
    passage = " ".join(f"w{k}" for k in range(13))
    rows = [(1, None), (2, ""), (3, " \n "), (4, passage), (5, passage.upper()), (6, "x " + passage + " y"), (None, passage),
            (None, "z " + passage), (7, "w0 " * 12), (8, "w0 " * 12), (9, "a " * 500), (9, "a " * 500), (10, "a " * 400),
            (11, "é　ü " * 20), (12, "é　ü " * 20), (4, passage), (4, passage + " more")]
    rows += [(100 + i, f"{i} {passage} tail{i}") for i in range(60)]
    got = run(spark, rows)
    assert got == expected(rows)
    assert (6, 15, 13, "x y") in got and (None, 13, 0, passage) in got and (10, 400, 400, "") in got


def test_long_text_and_clashing_columns(spark):
    long = " ".join(f"{k}" for k in range(60_000))
    rows = [(2, long + " end"), (1, long), (3, "q " + " ".join(f"{k}" for k in range(29_000, 29_020)) + " r")]
    assert [r[2] for r in run(spark, rows, parts=1)] == [0, 60_000, 20]
    df = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, kept string, id long")
    out = remove_repeats(df)
    assert out.columns == ["doc_id", "text", "id", "n_words", "n_removed", "kept", "removed"]
    assert [tuple(r) for r in out.collect()] == [(1, "a b", 5, 2, 0, "a b", [])]


def test_query_and_empty_table(spark, tmp_path):
    rows = [(2, "k " * 13), (1, "k " * 14)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op11_substrings(spark, f"{tmp_path}/a").collect()}
    assert got[2] == (13, 13, sha256(b"").hexdigest())
    assert got[1] == (14, 0, sha256(b" ".join([b"k"] * 14)).hexdigest())
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op11_substrings(spark, f"{tmp_path}/b").collect() == []


def test_segments_hold_every_window_once():
    words = np.random.default_rng(2).integers(0, 9, 400).astype(np.uint64)
    first = np.array([0, 5, 18, 18, 200, 400])
    begin, end, _ = segments(words, first, 13)
    windows = [(k) for a, b in zip(begin, end) for k in range(a, b - 12)]
    assert windows == [k for a, b in zip(first, first[1:]) for k in range(a, b - 12)]
    assert (end - begin).max() <= 2 * 13 - substrings.GRAM


def test_index_against_scans():
    rng = np.random.default_rng(8)
    for alphabet in (1, 2, 5, 300):
        sequences = [rng.integers(1, alphabet + 1, rng.integers(1, 22)) for _ in range(60)]
        labels = rng.integers(0, 20, 60)
        first = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
        index = Index(np.concatenate(sequences), first, labels)
        suffixes = [tuple(index.text[i:].tolist()) for i in suffix_order(index.text, 21)]
        upto_separator = [s[: s.index(0)] for s in suffixes]
        assert upto_separator == sorted(upto_separator)
        ends = np.concatenate([first[k] + k + np.arange(1, len(s) + 1) for k, s in enumerate(sequences)])
        limit = rng.integers(0, 21, len(ends))
        length, least = index.matching(ends, limit, 13)
        for end, most, n, found in zip(ends[::7], limit[::7], length[::7], least[::7]):
            for size in range(13, -1, -1):
                run = index.text[end - size: end].tolist()
                holders = [int(b) for s, b in zip(sequences, labels) if size <= end and 0 not in run
                           and any(s[j: j + size].tolist() == run for j in range(len(s) - size + 1))]
                if size == 0 or holders and min(holders) < most:
                    assert n == size and (size == 0 or found == min(holders))
                    break


def test_least_over_long_ranges():
    labels = np.random.default_rng(0).integers(0, 10 ** 6, 5000)
    index = Index(np.ones(5000, np.int64), np.arange(5001), labels)
    at = np.random.default_rng(1).integers(0, 9_990, 300)
    end = np.minimum(at + np.random.default_rng(2).integers(1, 9000, 300), 10_000)
    assert index.least(at, end).tolist() == [int(index.labels[a:b].min()) for a, b in zip(at, end)]


def test_spans_are_joined():
    spans = [{"first_word": 2, "end_word": 4}, {"first_word": 0, "end_word": 3}, {"first_word": 5, "end_word": 6}]
    assert without_words(b"a b c d e f g", spans) == (7, 5, b"e g", [
        {"first_word": 0, "end_word": 4}, {"first_word": 5, "end_word": 6}])
