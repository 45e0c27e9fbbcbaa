"""The Jaccard join against brute force: groups, set sizes, completeness of signatures, defined cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from geoloom.llm import jaccard, signatures as signs
from geoloom.llm.components import components
from geoloom.llm.jaccard import shingle_sets, similar_groups
from geoloom.llm.jaccard_query import op3_jaccard


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i: i + 5]) for i in range(len(words) - 4))


def plain_groups(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_token = {}
    for i, s in enumerate(sets):
        for t in s:
            by_token.setdefault(t, []).append(i)
    seen = set()
    for i, s in enumerate(sets):
        for j in {j for t in s for j in by_token[t] if j > i}:
            n = len(s & sets[j])
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), key), key)
    assert not seen
    return sorted((key, len(sets[i]), smallest[find(i)]) for i, (key, _) in enumerate(rows))


def test_query_against_brute_force(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op3_jaccard(spark, folder).collect())
        assert got == plain_groups(rows)


def near_texts(seed, n):
    """Chains of near copies, common passages and short texts, so that many pairs lie close to the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.choice([4, 6, 12, 40, 90, 260]))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            at = rng.randrange(len(words))
            words[at: at + rng.randrange(2)] = [word() for _ in range(rng.randrange(3))]
            words = words or [word()]
        if rng.random() < 0.3:
            words = words + passage[: rng.choice([10, 60])]
        rows.append((i + 100, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_close_texts(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "frequent_level", lambda total, bits: 6)  # many frequent tokens at this size
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 3_000)
    rows = near_texts(seed, 400)
    out = similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == plain_groups(rows)


def test_every_link_has_a_common_signature():
    rows = near_texts(7, 300)
    values, first = shingle_sets(pa.array([t for _, t in rows]))
    sets = [set(values[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    rng = np.random.default_rng(3)
    for table, frequent in ((rng.integers(0, 12, 1 << 10, dtype=np.uint8), 6), (np.zeros(1 << 10, np.uint8), 0)):
        sig, owner, _, _ = signs.signatures(values, first, table, frequent)
        held = [set(sig[owner == i].tolist()) for i in range(len(rows))]
        links = 0
        for i in range(len(rows)):
            for j in range(i):
                n = len(sets[i] & sets[j])
                if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    links += 1
                    assert held[i] & held[j]
        assert links > 200


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 9), (6, 6)] + [(100, i) for i in range(101, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in range(1, 6)} == {1} and {got[i] for i in (7, 8, 9)} == {7}
    assert {got[i] for i in range(100, 300)} == {100} and 6 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(3, None), (4, ""), (5, " \t\n"), (7, "One two"), (6, "one\x0btwo"), (6, "one two"), (8, "one two three"),
            (None, "one two"), (9, long), (2, long + " x"), (10, "a b c d e"), (10, "f g h i j")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in similar_groups(df).collect())
    assert got == [(0, 1, None), (2, 29_997, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (6, 1, 6), (7, 1, 6), (8, 1, 8),
                   (9, 29_996, 2), (10, 1, 10), (10, 1, 10)]
    assert similar_groups(df.limit(0)).count() == 0
