"""The cube method: targets by hand, totals that stay, reruns that agree."""

import random
from collections import defaultdict

import numpy as np
import pytest

from webcorpus.llm import mixing


def targets_of(sizes, weights, cap):
    """Share by weight, hold what is too much, share the rest again."""
    total, held = sum(sizes), {}
    while True:
        free = [k for k in range(len(sizes)) if k not in held]
        left = total - sum(held.values())
        shares = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = {k: cap * sizes[k] for k in free if shares[k] > cap * sizes[k]}
        if not over:
            return [held.get(k, shares.get(k)) for k in range(len(sizes))]
        held |= over


def test_targets_and_totals(awkward, awkward_rows):
    rows = mixing.mix(awkward).collect()
    sizes = defaultdict(int)
    for _, text, _, source in awkward_rows:
        sizes[source] += len((text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets_of([sizes[s] for s in order], [k % 3 + 1 for k in range(len(order))], 3)
    assert {(r.source, r.source_size) for r in rows} == {(s, sizes[s]) for s in order}
    for r in rows:
        assert r.target == pytest.approx(want[order.index(r.source)])
        assert 0 <= r.copies <= 3
    assert sum(r.rows for r in rows) == len(awkward_rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(awkward.repartition(2)).collect()))


def test_taken_words_come_near_the_target(spark):
    rng = random.Random(2)
    data = [(k, "w " * int(rng.lognormvariate(4, 1)), "abc"[min(k % 4, 2)]) for k in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    taken, target = defaultdict(int), {}
    for r in mixing.mix(docs, block=100).collect():  # several levels
        taken[r.source] += r.copies * r.size * r.rows
        target[r.source] = r.target
    for source in target:
        assert taken[source] == pytest.approx(target[source], rel=0.01)


def test_flight_keeps_both_sums_until_two_are_left():
    rng = random.Random(3)
    sizes = [float(rng.choice([1, 1, 2, 5, 50, 400])) for _ in range(300)]
    chances = [rng.random() for _ in sizes]
    out = mixing.flight(sizes, chances, random.Random(1), land=False)
    assert sum(0 < x < 1 for x in out) <= 2
    assert sum(out) == pytest.approx(sum(chances))
    assert np.dot(out, sizes) == pytest.approx(np.dot(chances, sizes))
    assert all(x in (0, 1) for x in mixing.flight(sizes, chances, random.Random(1), land=True))
    assert mixing.flight([], [], random.Random(1), land=True) == []


def test_chances_are_kept_on_average():
    runs = np.mean([mixing.flight([3.0, 1.0, 7.0, 2.0, 2.0], [0.3, 0.5, 0.2, 0.9, 0.6], random.Random(k), True) for k in range(4000)], axis=0)
    assert runs == pytest.approx([0.3, 0.5, 0.2, 0.9, 0.6], abs=0.04)


def test_landing_comes_as_near_as_the_chances_allow():
    sizes = [float(s) for s in (40, 37, 33, 30, 26, 21, 19, 14, 9, 5, 3, 2)]
    chances = [random.Random(5).random() for _ in sizes]
    runs = np.array([mixing.landing(sizes, chances, random.Random(k)) for k in range(600)])
    assert runs.mean(axis=0) == pytest.approx(chances, abs=0.08)
    assert np.abs(runs @ sizes - np.dot(chances, sizes)).max() <= 2
    # Nothing balances one document: it is drawn.
    assert np.mean([mixing.landing([9.0], [0.25], random.Random(k))[0] for k in range(2000)]) == pytest.approx(0.25, abs=0.04)
    assert mixing.landing([5.0, 5.0, 0.0], [0.5, 0.5, 0.5], random.Random(1))[:2] in ([0.0, 1.0], [1.0, 0.0])


def test_small_sources_come_near_their_targets(spark):
    rng = random.Random(4)
    data = [(k, "w " * min(20_000, int(rng.lognormvariate(5, 1.3))), f"s{k % 20}") for k in range(1000)]  # 50 documents each
    taken, target = defaultdict(int), {}
    for r in mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect():
        taken[r.source] += r.copies * r.size * r.rows
        target[r.source] = r.target
    assert len(target) == 20
    for source in target:
        assert taken[source] == pytest.approx(target[source], rel=0.02)


def test_take_repeats_rows(awkward):
    copies = {(r.doc_id, r.source, r.tie): r.copies for r in mixing.mix(awkward).collect()}
    taken = mixing.take(awkward)
    assert taken.columns == awkward.columns
    assert taken.count() == sum(r.copies * r.rows for r in mixing.mix(awkward).collect())
    assert copies


def test_empty_table(nothing):
    assert mixing.mix(nothing).collect() == []
    assert mixing.take(nothing).collect() == []
