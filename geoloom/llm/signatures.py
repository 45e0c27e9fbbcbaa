"""Signatures of sets of shingle hashes for the Jaccard join: single rare tokens and pairs of frequent ones.

Tokens are in one global order: by the frequency level of their hash bucket, then by hash. A set's prefix is the
shortest run of its tokens in that order from which more than ``missing`` signatures must survive when ``missing``
tokens are lost, where ``missing`` is what the set can lack in a partner at the threshold. Rare tokens are signatures
alone. Frequent tokens are dealt into small classes by hash, and a class gives all pairs of its tokens, so it needs two
shared tokens and adds one to the prefix. If two sets reach the threshold, then of the two the one whose prefix ends
first lacks at most ``missing`` tokens, so some rare token or some pair of one class is left in both prefixes: no link
is lost, whatever the levels are.

How finely tokens are dealt depends on the size level of the smaller set of a pair, so a set is indexed at its own
size level and at that of the smallest partner it can have.
"""

from __future__ import annotations

import numpy as np

from geoloom.llm.words import mix

#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Size level from which frequent tokens are paired; below it all are rare.
PAIRED_FROM = 3


def least_partner(size: np.ndarray) -> np.ndarray:
    """Size of the smallest set that can link with one of this size; also the least overlap."""
    return -(-size * PERCENT // 100)


def distinct_sets(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, ascending, and each text's first (one more entry at the end)."""
    values = shingles.copy()
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        values[lo:hi].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    counted = np.concatenate([[0], np.cumsum(new)])
    return values[new], counted[first]


def digests(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number per set, the same for equal sets (and 0 for empty ones)."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    size = np.diff(first).astype(np.uint64)
    return np.where(size > 0, mix(sums[first[1:]] - sums[first[:-1]] + size * np.uint64(0x9E3779B97F4A7C15)), 0).astype(np.uint64)


def size_level(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)


def signatures(values: np.ndarray, first: np.ndarray, levels: np.ndarray,
               frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of all sets: hashes, the number of their set, and what each is: 1 a single token at the set's own
    size level, 2 a single token at the level of its smallest partner (where that is another one), 0 a pair. And, for
    every set, the places in the global order where its prefixes at these two levels end. ``levels`` holds the
    frequency level of every hash bucket (a power of two of them), ``frequent`` the least level of frequent tokens."""
    bits = len(levels).bit_length() - 1
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    level = levels[(values >> np.uint64(64 - bits)).astype(np.int64)]
    # The order within sets: frequency level, then hash (values ascend within their set).
    order = np.argsort(owner * 256 + level, kind="stable")
    values, level = values[order], level[order]
    own_level, low_level = size_level(size), size_level(least_partner(size))
    out_hash, out_owner, out_own = [], [], []
    ends = np.zeros((len(size), 2), np.int64)
    for at_level in np.unique(np.concatenate([own_level, low_level])).tolist():
        texts = np.flatnonzero(((own_level == at_level) | (low_level == at_level)) & (size > 0))
        if not len(texts):
            continue
        n = size[texts]
        row = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = first[texts][row] + place
        token = values[at]
        paired = (level[at] >= frequent) & (at_level >= PAIRED_FROM)
        classes = max(1, (1 << at_level) // 16)
        own_class = (token & np.uint64(classes - 1)).astype(np.int64)
        # A paired token adds to what must survive unless it is the first of its class.
        key = row * (classes + 1) + np.where(paired, own_class, classes)
        by_class = np.argsort(key, kind="stable")
        leads = np.zeros(len(key), bool)
        starts = np.ones(len(key), bool)
        starts[1:] = key[by_class][1:] != key[by_class][:-1]
        leads[by_class[starts]] = True
        adds = ~(paired & leads)
        total = np.cumsum(adds)
        before = (total - adds)[np.cumsum(n) - n][row]
        missing = (n - least_partner(n))[row]
        inside = (total - adds - before) <= missing
        last = np.flatnonzero(inside & np.append(~inside[1:] | (row[1:] != row[:-1]), True))
        place = (level[at[last]].astype(np.int64) << 56) | (token[last] >> np.uint64(8)).astype(np.int64)
        for which, levels_of in enumerate((own_level, low_level)):
            mine = levels_of[texts[row[last]]] == at_level
            ends[texts[row[last[mine]]], which] = place[mine]
        salt = np.uint64(at_level * 2 + 1)
        single = inside & ~paired
        out_hash.append(mix(token[single] + salt))
        out_owner.append(texts[row[single]])
        out_own.append(np.where(own_level[out_owner[-1]] == at_level, 1, 2))
        both = np.flatnonzero(inside[by_class] & paired[by_class])
        token, row, key = token[by_class][both], row[by_class][both], key[by_class][both]
        reach = 1
        while len(token) > reach:
            same = np.flatnonzero(key[reach:] == key[:-reach])
            if not len(same):
                break
            a, b = token[same], token[same + reach]
            out_hash.append(mix(mix(np.minimum(a, b) + salt) ^ np.maximum(a, b)))
            out_owner.append(texts[row[same]])
            out_own.append(np.zeros(len(same), np.int64))
            reach += 1
    if not out_hash:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), ends
    return np.concatenate(out_hash), np.concatenate(out_owner), np.concatenate(out_own), ends
