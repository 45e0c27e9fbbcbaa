"""License scans against brute-force alignment, winnowing's guarantee, defined cases."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from geoloom.llm.licenses import (
    EDITS, Templates, add_licenses, align, fingerprint_form, grams, intact_run, template_words, winnow,
)
from geoloom.llm.licenses_query import TEMPLATES, op6_licenses
from tests.conftest import SF_DIR

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def best_match(template, body):
    """Most matched words of an alignment of least edit distance between the template and any run of the body."""
    row = [(0, 0)] * (len(body) + 1)
    for i, t in enumerate(template, 1):
        new = [(i, 0)]
        for j, b in enumerate(body, 1):
            new.append(min((row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1]),
                           (row[j - 1][0] + (t != b), row[j - 1][1] - (t == b))))
        row = new
    return min(row)


def test_query_against_brute_force(spark):
    got = {}
    for r in op6_licenses(spark, SF).collect():
        got.setdefault((r.doc_id, r.license), []).append(r)
    listed = {n: words(t) for n, t in TEMPLATES.items()}
    want = set()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for doc_id, text in docs.items():
        if not re.search("icen[sc]e", text):
            continue
        body = words(text)
        for name, template in listed.items():
            distance, matched = best_match(template, body)
            if distance <= int(EDITS * len(template)):
                want.add((doc_id, name))
                best = min(got[doc_id, name], key=lambda r: r.distance)
                assert best.distance == distance and best.matched_words == -matched
    assert want and set(got) == want
    for rows in got.values():
        for r in rows:
            part = docs[r.doc_id].encode()[r.first_byte: r.end_byte].decode()
            assert best_match(listed[r.license], words(part))[0] == r.distance


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=20))
def test_wide_bands_align_exactly(template, body):
    found = align(np.array(template, np.uint64), np.array(body, np.uint64), -100, 100)
    distance, matched, start, end = min(found, key=lambda x: (x[0], -x[1]))
    assert (distance, -matched) == best_match(template, body)
    assert best_match(template, body[start:end])[0] == distance


@pytest.mark.parametrize("name", TEMPLATES)
def test_one_changed_or_added_word(name):
    """At every place, so that every run of words is broken somewhere."""
    listed = [(name, template_words(TEMPLATES[name]))]
    held, n = Templates(listed), len(listed[0][1])
    pad = np.arange(1, 40, dtype=np.uint64)
    for at in range(n):
        for changed in (True, False):
            if n < 5 or not changed and at == 0:
                continue
            body = np.concatenate([pad, listed[0][1][:at], pad[:1], listed[0][1][at + changed:], pad])
            ((_, _, _, matched, distance),) = held.matches(body)
            assert (matched, distance) == (n - changed, 1)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=4, max_size=12), st.lists(st.integers(1, 9), max_size=40))
def test_no_match_is_missed(template, body):
    distance, matched = best_match(template, body)
    got = Templates([("x", np.array(template, np.uint64))]).matches(np.array(body, np.uint64))
    if distance <= int(EDITS * len(template)):
        assert min((d, -m) for _, _, _, m, d in got) == (distance, matched)
    for _, start, end, m, d in got:
        assert best_match(template, body[start:end]) == (d, -m)


def test_reworded_notice_without_common_run(spark):
    df = spark.createDataFrame([(1, "Released under the open MIT License")], "doc_id long, text string")
    ((found,),) = add_licenses(df, TEMPLATES).select("licenses").collect()
    assert [(x.license, x.matched_words, x.distance) for x in found] == [("MIT", 5, 1)]


def test_common_runs_share_a_fingerprint():
    rng = random.Random(4)
    for n in range(4, 200):
        size, window = fingerprint_form(n)
        assert size + window - 1 == intact_run(n)
        run = [rng.getrandbits(64) for _ in range(intact_run(n))]
        sides = []
        for _ in range(2):
            text = np.array([rng.getrandbits(64) for _ in range(9)] + run + [rng.getrandbits(64) for _ in range(9)], np.uint64)
            hashes = grams(text, size)
            sides.append(set(hashes[winnow(hashes, window)].tolist()))
        assert sides[0] & sides[1]


def test_the_index_decides():
    """Without its entries nothing is found, and only words around hits are aligned."""
    listed = [(n, template_words(t)) for n, t in TEMPLATES.items()]
    assert max(len(w) for _, w in listed) > 150
    body = np.concatenate([np.arange(500, dtype=np.uint64), *[w for _, w in listed], np.arange(500, dtype=np.uint64)])
    held = Templates(listed)
    assert {held.names[m[0]] for m in held.matches(body)} == set(TEMPLATES)
    held.index = [(size, window, keys[:0], entries[:0]) for size, window, keys, entries in held.index]
    assert held.matches(body) == []


def test_many_copies_take_linear_time():
    template = template_words(TEMPLATES["BSD text"])
    held = Templates([("x", template)])
    near = template.copy()
    near[5] = 1
    seconds = []
    for copies in (5_000, 20_000):
        started = time.perf_counter()
        assert len(held.matches(np.tile(near, copies))) == copies
        seconds.append(time.perf_counter() - started)
    assert seconds[1] < 8 * seconds[0] + 1
    scrambled = np.tile(template[::-1], 600)
    assert held.matches(scrambled) == []


def test_changed_and_repeated_notices(spark):
    long = TEMPLATES["GPL text"].replace("modify", "alter").replace("published by", "issued lately by")
    rows = [(1, f"x {long} y. RELEASED, under the MIT\nlicense! And released under the mit license", "c"), (2, None, "c"),
            (3, "", "c"), (4, "Released under the license of MIT", "c"), (4, "Released under the license of MIT", "c"),
            (5, "word " * 100_000 + "Licensed under CC BY NC 4 0", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    out = add_licenses(df, TEMPLATES)
    assert out.columns == ["doc_id", "text", "licenses"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append([(x.license, x.distance) for x in r.licenses])
    assert got[1] == [[("GPL text", 3), ("MIT", 0), ("MIT", 0)]] and got[2] == got[3] == [[]]
    assert len(got[4]) == 2 and got[5] == [[("CC-BY-NC-4.0", 0)]]
    assert add_licenses(df.limit(0), TEMPLATES).count() == 0
    with pytest.raises(ValueError):
        add_licenses(df, {"x": "too short"})
    assert Templates([]).matches(np.zeros(5, np.uint64)) == []
    assert SF_DIR
