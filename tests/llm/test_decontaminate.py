"""Leaks against brute force over whole texts, recall at the largest distance, exact verification, defined cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from geoloom.llm import decontaminate
from geoloom.llm.decontaminate import RECALL, Exact, Index, add_leaks, closest
from geoloom.llm.decontaminate_query import op7_leaks
from geoloom.llm.words import word_hashes
from tests.conftest import SF_DIR


def plain_closest(item, words):
    """Edit distance to the best run of words, by the whole table."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.lists(st.integers(0, 4), max_size=60))
def test_exact_distance(item, words):
    distance, start, end = closest(item, words)
    assert distance == plain_closest(item, words) == plain_distance(item, words[start:end])


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toArrow()
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").toArrow()
    words, first = word_hashes(docs["text"])
    parts, starts = word_hashes(items["text"])
    want = {}
    for j, item_id in enumerate(items["item_id"].to_pylist()):
        item = parts[starts[j]: starts[j + 1]].tolist()
        for i, doc_id in enumerate(docs["doc_id"].to_pylist()):
            distance = closest(item, words[first[i]: first[i + 1]].tolist())[0]
            if distance <= int(decontaminate.EDITS * len(item)) and len(item) >= decontaminate.MIN_WORDS:
                want[doc_id, item_id] = distance
    got = {(r.doc_id, r.item_id): r.distance for r in op7_leaks(spark, SF_DIR).collect()}
    assert want and got == want


def test_recall_at_the_largest_distance():
    rng = random.Random(11)
    items = [np.array([rng.getrandbits(64) for _ in range(rng.randrange(5, 60))], np.uint64) for _ in range(120)]
    index, docs = Index(items), []
    for i, item in enumerate(items):
        words = item.tolist()
        for _ in range(index.edits[i]):
            at = rng.randrange(len(words))
            words[at: at + rng.randrange(2)] = [rng.getrandbits(64)] * rng.randrange(2)
        docs.append([rng.getrandbits(64) for _ in range(20)] + words + [rng.getrandbits(64) for _ in range(20)])
    found = index.leaks(np.array(sum(docs, []), np.uint64), np.cumsum([0, *map(len, docs)]))
    assert np.mean([(i, i) in {x[:2] for x in found} for i in range(len(items))]) >= RECALL
    assert all(x[0] == x[1] for x in found)


def edited(item, edits, rng, mixed):
    """The item's words after edits that leave it at exactly that distance."""
    for _ in range(100):
        words, last = list(item), (0, "")
        for at in sorted(rng.sample(range(1, len(item) - 1), edits), reverse=True):
            kind = rng.choice("sdi") if mixed else "s"
            if at + 1 == last[0] and {kind, last[1]} == {"d", "i"}:  # together they would be one substitution
                kind = "s"
            words[at: at + 1] = {"s": [rng.getrandbits(64)], "d": [], "i": [item[at], rng.getrandbits(64)]}[kind]
            last = at, kind
        if closest(item, words)[0] == edits:
            return words
    raise AssertionError("no such edits")


@pytest.mark.parametrize("size", [5, 6, 7, 8, 10, 15, 24, 40, 59, 60, 89, 100, 150, 200, 300, 500])
@pytest.mark.parametrize("mixed", [False, True])
def test_recall_does_not_fall_with_the_length(size, mixed):
    rng = random.Random(size)
    items = [np.array([rng.getrandbits(64) for _ in range(size)], np.uint64) for _ in range(60)]
    index, docs = Index(items), []
    for i, item in enumerate(items):
        pad = [rng.getrandbits(64) for _ in range(rng.randrange(60))]
        docs.append(pad + edited(item.tolist(), index.edits[i], rng, mixed) + pad[::-1])
    found = index.leaks(np.array(sum(docs, []), np.uint64), np.cumsum([0, *map(len, docs)]))
    assert {x[2] for x in found} == {int(decontaminate.EDITS * size)}
    assert np.mean([(i, i) in {x[:2] for x in found} for i in range(len(items))]) >= RECALL
    assert all(x[0] == x[1] for x in found)


def test_defined_cases(spark):
    passage = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, passage, "x"), (1, passage, "x"), (2, "too short", "x"), (3, None, "x"),
                                   (None, "A B C D E F G H", "x"), (4, "", "x")], "item_id long, text string, extra string")
    docs = spark.createDataFrame([
        (1, None, "c"), (2, "", "c"), (3, passage.upper(), "c"), (3, passage.upper(), "c"), (None, f"x {passage} y", "c"),
        (5, "one two three 4 five six seven eight nine ten " + passage, "c"), (6, "too short", "c"),
        (7, "one two 3 four five 6 seven eight 9 ten", "c"), (8, ("word " * 50_000) + "a b c d e f g h", "c")],
        "doc_id long, text string, leaks string")
    out = add_leaks(docs, items)
    assert out.columns == ["doc_id", "text", "leaks"]
    got = sorted((r.doc_id or 0, [(x.item_id, x.distance, x.first_word, x.end_word) for x in r.leaks]) for r in out.collect())
    same = [(1, 0, 0, 10)] * 2
    assert got == [(0, [(1, 0, 1, 11)] * 2), (1, []), (2, []), (3, same), (3, same), (5, [(1, 0, 10, 20)] * 2), (6, []),
                   (7, []), (8, [(None, 0, 50_000, 50_008)])]
    assert add_leaks(docs.limit(0), items).count() == 0
    assert all(not r.leaks for r in add_leaks(docs, items.limit(0)).collect())


def test_short_items_are_found_exactly(spark, monkeypatch, tmp_path):
    long = "one two three four five six seven eight nine ten"
    items = [(1, "What is the capital of Australia?"), (2, "\u65e5\u672c\u306e\u9996\u90fd\u306f\u3069\u3053\u3067\u3059\u304b\u3002"), (3, "Yes"), (4, " \t"), (5, None), (6, long)]
    docs = [(1, "Q:  what is\nTHE capital of Australia? Canberra"), (2, "x \u306f\u3044\u3001" + items[1][1] + "\u6771\u4eac\u3067\u3059 y"),
            (3, "yesterday, yes"), (4, "What is the capital of Austria?"), (5, None), (6, long + " YES"),
            (7, "What is the capital"), (8, "of Australia?"), (9, "word " * 60_000 + items[1][1]), (10, "yes")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.item_id, r.distance, r.first_word, r.end_word) for r in op7_leaks(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 0, 1, 7), (2, 2, 0, 1, 2), (3, 3, 0, 1, 2), (4, 1, 1, 0, 5), (6, 3, 0, 10, 11), (6, 6, 0, 0, 10),
                   (9, 2, 0, 60_000, 60_001), (10, 3, 0, 0, 1)]
    texts = [t for _, t in docs]
    want = sorted(Exact([(i, t) for i, t in items[:3]]).leaks(texts))
    monkeypatch.setattr(decontaminate, "PLACES", 7)
    assert sorted(Exact([(i, t) for i, t in items[:3]]).leaks(texts[:8])) == [x for x in want if x[0] < 8]


def test_pieces_of_a_batch_do_not_matter(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 10)
    assert word_hashes(pa.array(["a b", None, "A"]))[0][0] == word_hashes(pa.array(["A"]))[0][0]


def test_many_items_are_searched_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(rng.randrange(5, 30))) for _ in range(60)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{t} x {texts[i - 1]}") for i, t in enumerate(texts)], "doc_id long, text string")
    whole = {r.doc_id: r.leaks for r in add_leaks(docs, items).collect()}
    assert all({x.item_id for x in leaks} >= {i, (i - 1) % 60} for i, leaks in whole.items())
    monkeypatch.setattr(decontaminate, "MAX_ITEM_BYTES", 500)
    assert {r.doc_id: r.leaks for r in add_leaks(docs, items).collect()} == whole


def test_short_items_of_scripts_without_blanks(spark):
    """Five words or more may hold an edit, and may still begin or end inside a longer run."""
    item = "日本 a b c d e首都"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x東" + item + "京 y"), (2, "日本 a b z d e首都")], "doc_id long, text string")
    got = {r.doc_id: [(x.distance, x.first_word, x.end_word) for x in r.leaks] for r in add_leaks(docs, items).collect()}
    assert got == {1: [(0, 0, 6)], 2: [(1, 0, 6)]}


def test_items_of_odd_white_space(spark):
    """Characters that only some languages count as blank are words here, and no item stops the search."""
    items = spark.createDataFrame([(1, "\u00a0"), (2, "\u3000\u3000"), (3, "\x1c"), (4, " \t"), (5, "plain words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a \u3000\u3000 b"), (2, "with plain  words in it"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: [x.item_id for x in r.leaks] for r in add_leaks(docs, items, least_words=1).collect()}
    assert found == {1: [2], 2: [5], 3: []}
