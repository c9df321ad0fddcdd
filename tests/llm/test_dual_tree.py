"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from webcorpus.llm import dual_tree

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(t.translate(LOWER) for t in TERM.findall(text or ""))


def by_hand(docs, items, k):
    counted = [(doc_id, terms(text)) for doc_id, text in docs]
    documents, length = sum(1 for _, t in counted if t), sum(t.total() for _, t in counted)
    df = Counter(x for _, t in counted for x in t)
    out = []
    for item_id, text in set(items):
        found = []
        for doc_id, t in counted:
            m = 25 + (75 * t.total() * documents) // length if length else 25
            score = sum(
                q * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[x] + 1))) * ((10**9 * t[x]) // (1000 * t[x] + 8 * m))
                for x, q in terms(text).items() if t[x])
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, **options):
    return sorted((tuple(r) for r in dual_tree.search(docs, items, **options).collect()), key=str)


@pytest.fixture(scope="module")
def items(awkward_rows):
    rng = random.Random(8)
    rows = [(k, " ".join((awkward_rows[rng.randrange(len(awkward_rows))][1] or "x").split()[:rng.randint(1, 30)])) for k in range(40)]
    return rows + [rows[0], (50, None), (51, ""), (52, "zzzz none here"), (None, rows[3][1]), (53, "É é 日本 A-b Ab aB"), (54, "one " * 300)]


def test_against_every_pair(spark, awkward, awkward_rows, items):
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, item int, doc_id int").repartition(3)
    want = by_hand([(i, t) for i, t, *_ in awkward_rows], items, 10)
    assert found(awkward, asked) == want
    # Small blocks, many seeds, other k: the same scores.
    assert found(awkward, asked, block_terms=60, seed_every=2) == want
    assert found(awkward, asked, k=3) == by_hand([(i, t) for i, t, *_ in awkward_rows], items, 3)


def test_ties_by_id(spark):
    docs = [(k, "same text here") for k in random.Random(2).sample(range(1000), 300)] + [(None, "same text here")]
    got = found(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([("q", "here")], "item_id string, text string"), k=5)
    assert got == by_hand(docs, [("q", "here")], 5)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [None, *sorted(d for d, _ in docs if d is not None)[:4]]


def test_whole_batches_are_pruned():
    rng = np.random.default_rng(1)
    width, count = 400, 4000
    weights = np.full(width, 1000)
    # Documents of 40 themes of ten terms each, and a few terms that all share.
    theme = rng.integers(0, 38, count)
    cols = np.concatenate([np.sort(np.unique(np.concatenate([20 + 10 * t + rng.integers(0, 10, 5), rng.integers(0, 20, 3)]))) for t in theme])
    sizes = [len(np.unique(c)) for c in np.split(cols, np.flatnonzero(np.diff(cols) < 0) + 1)]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    impacts = rng.integers(1, 10**6, len(cols)) * np.where(cols < 20, 1, 50)
    items = [(np.sort(rng.choice(10, 4, replace=False)) + 20 + 10 * t, np.ones(4, np.int64)) for t in range(30)]
    tree = dual_tree.ItemTree(items, weights)
    search = dual_tree.Search(tree, 10, np.zeros(30, np.int64))
    docs = dual_tree.DocTree(np.arange(len(sizes)), rows, cols, impacts, width)
    search.add(docs)
    dense = np.zeros((len(sizes), width), np.int64)
    dense[rows, cols] = impacts
    scores = dense @ tree.counts.T
    for item in range(30):
        want = np.lexsort([np.arange(len(sizes)), -scores[:, item]])[:10]
        want = want[scores[want, item] > 0]
        assert search.ids[item].tolist() == want.tolist()
        assert search.scores[item].tolist() == scores[want, item].tolist()
    assert search.scored < scores.size / 4


def test_long_texts_and_lengths_beyond_64_bits(spark, monkeypatch):
    monkeypatch.setattr(dual_tree, "SLICE_BYTES", 64)
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice("abcde") * rng.randint(1, 40) for _ in range(300))) for k in range(5)]
    items = [(1, "aaa bb c"), (2, "d" * 40)]
    got = found(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert got == by_hand(docs, items, 10)
    n = np.array([2**40, 5])
    rows = np.array([0, 1])
    got = dual_tree._impacts(n, rows, rows, np.array([3, 1]), np.array([7, 9]), 2**30, 2**41)
    assert got.tolist() == [w * ((10**9 * tf) // (1000 * tf + 8 * (25 + (75 * x * 2**30) // 2**41))) for x, tf, w in ((2**40, 3, 7), (5, 1, 9))]


def test_nothing(spark, nothing):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert found(nothing, items) == []
    assert found(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)) == []
