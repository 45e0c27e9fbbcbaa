"""Held-out accuracy of language identification, and its defined cases."""

import math
import zlib

from geoloom.llm.langid import BUCKETS, PIECE, SMOOTHING, learn, ngrams, predict
from geoloom.llm.langid_query import op9_langid
import numpy as np


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op9_langid(spark, folder).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    asked = [r for r in rows if r.held_out and truth[r.doc_id].lang is not None]
    right = sum(r.lang_pred == truth[r.doc_id].lang for r in asked)
    assert right / len(asked) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_predictions_by_plain_python(spark):
    """Counts, smoothing and posterior of every document of a small table, by dictionaries and floats."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    grams = {r.doc_id: [int(g) for part in ngrams(r.text or "") for g in part] for r in docs}
    counts = {}
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.text is not None and r.lang is not None:
            mine = counts.setdefault(r.lang, {})
            for g in grams[r.doc_id]:
                mine[g] = mine.get(g, 0) + 1
    totals = {lang: sum(c.values()) + SMOOTHING * BUCKETS for lang, c in counts.items()}
    got = {r.doc_id: r for r in op9_langid(spark, folder).collect()}
    for r in docs:
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        sums = {lang: sum(math.log((c.get(g, 0) + SMOOTHING) / totals[lang]) for g in grams[r.doc_id]) for lang, c in counts.items()}
        best = max(sorted(sums), key=sums.get)
        assert got[r.doc_id].lang_pred == best
        assert math.isclose(got[r.doc_id].score, 1 / sum(math.exp(s - sums[best]) for s in sums.values()), abs_tol=1e-3)


def test_ties_repeats_and_long_texts(spark):
    """Languages that learned the same are equally likely, the first by name wins; equal rows get equal answers."""
    rows = [("xx", "ab ab"), ("aa", "ab ab"), (None, "ab"), ("xx", None)]
    names, matrix = learn(spark.createDataFrame(rows, "lang string, text string"))
    asked = spark.createDataFrame([(1, "ab"), (1, "ab"), (2, "ab " * 200_000), (3, ""), (4, None), (5, "12 !")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, round(r.score, 6)) for r in predict(asked, names, matrix).collect()]
    assert got == [(1, "aa", 0.5), (1, "aa", 0.5), (2, "aa", 0.5), (3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0)]


def test_pieces_count_every_ngram_once():
    text = "abcdefg hij" * 7
    whole = np.sort(np.concatenate(list(ngrams(text))))
    from geoloom.llm import langid
    langid.PIECE, before = 10, PIECE
    try:
        parts = np.sort(np.concatenate(list(ngrams(text))))
    finally:
        langid.PIECE = before
    assert (whole == parts).all() and len(whole) == 3 * len(text) - 3


def test_defined_cases(spark):
    rows = [(1, "guten tag der die das", "de"), (2, "the of and to", "en"), (3, None, "en"), (4, "the", None),
            (5, "12 ½ !", "en"), (6, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "1 AS lang_pred")
    names, matrix = learn(df)
    assert names == ["de", "en"]
    out = predict(df, names, matrix)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    found = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert found[1][0] == "de" and found[2][0] == "en" and found[4][0] == "en"
    assert found[3] == found[5] == found[6] == ("und", 0.0)
    nothing = learn(df.limit(0))
    assert nothing[0] == [] and {r.lang_pred for r in predict(df, *nothing).collect()} == {"und"}
    assert predict(df.limit(0), names, matrix).count() == 0
