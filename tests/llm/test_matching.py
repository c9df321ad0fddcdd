"""Decontamination, near duplicates and language-model scores against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from webcorpus.llm import backoff, chosen_path, decontaminate

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def hits_of(rows, items):
    windows = {}
    for name, text in items:
        w = words(text)
        for k in range(max(0, len(w) - min(10, len(w)) + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + min(10, len(w))]), set()).add(name)
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        yield str(i), len(w), sorted(hit), sorted(str(n) for n in found if n is not None)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])  # one block, and several
def test_decontamination(spark, awkward, awkward_rows, block_bytes):
    texts = [t for _, t, *_ in awkward_rows]
    items = [(1, texts[4]), (2, texts[13]), (2, "three"), (11, texts[9][:200].upper()), (3, None), (4, "..."), (5, "nowhere to be found " * 4), (None, texts[11][500:700])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(awkward, bench, block_bytes=block_bytes).select("doc_id", "n_words", "hit_words", "items").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(hits_of([(i, t) for i, t, *_ in awkward_rows], items))


def test_empty_benchmark_and_documents(spark, awkward, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(awkward, none).filter("size(hit_words) > 0").isEmpty()
    assert decontaminate.decontaminate(nothing, none).collect() == []


@pytest.mark.parametrize("block_bytes", [150, 40])  # several items a block, and one larger than a block
def test_repeated_items_are_sent_once_in_bounded_blocks(spark, monkeypatch, block_bytes):
    blocks, build = [], decontaminate.Benchmark.__init__
    monkeypatch.setattr(decontaminate.Benchmark, "__init__", lambda self, rows, *a: blocks.append(rows) or build(self, rows, *a))
    common = "one two three four five six seven eight nine ten eleven"
    items = [(1, common)] * 60 + [(None, common)] * 5 + [(k, f"item {k} of the test") for k in range(2, 20)]
    rows = [(1, f"x {common} y"), (2, "here is item 7 of the test"), (3, "nothing"), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.decontaminate(docs, bench, block_bytes=block_bytes).select("doc_id", "n_words", "hit_words", "items").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(hits_of(rows, items))
    assert all(len(b) == 1 or sum(len(t.encode()) for _, t in b) <= block_bytes for b in blocks)
    assert sorted(r for b in blocks for r in b if r[0] is not None) == sorted({(str(i), t) for i, t in items if i is not None})
    assert [r for b in blocks for r in b if r[0] is None] == [(None, common)]


def near_of(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    n = len(rows)
    linked = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        group = [min([group[i], *(group[j] for j in linked[i])]) for i in range(n)]
    for i, (doc_id, text) in enumerate(rows):
        members = [rows[j] for j in range(n) if group[j] == group[i]] if sets[i] else [rows[i]]
        least = min(members, key=lambda r: (r[0] is None, r[0] or 0))
        yield (str(doc_id), str(least[0]), len({rows[j][1] for j in linked[i]} - {text}), sum(t == text for _, t in rows) - 1), least


def check_near(docs, rows):
    got = chosen_path.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_copies) for r in got) == sorted(row for row, _ in near_of(rows))


def test_near_duplicates(awkward, awkward_rows):
    rows = [(i, t) for i, t, *_ in awkward_rows]
    check_near(awkward, rows)
    kept = chosen_path.keep_one(awkward)
    assert kept.columns == awkward.columns
    got = [(r.doc_id, r.text) for r in kept.collect() if words(r.text)]
    assert sorted(got, key=str) == sorted({least for _, least in near_of(rows) if words(least[1])}, key=str)


def test_large_groups_are_split_and_compared_in_blocks(spark, monkeypatch):
    for name, value in (("SMALL", 4), ("COMPARED", 16), ("BLOCK_CLASSES", 16)):
        monkeypatch.setattr(chosen_path, name, value)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(60):  # near copies, and documents that share half of their text
        changed = list(base)
        changed[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(changed)))
        rows.append((100 + k, " ".join(base[:100] + [f"y{k}-{j}" for j in range(100)])))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_no_documents(nothing):
    assert chosen_path.near_duplicates(nothing).collect() == []
    assert chosen_path.keep_one(nothing).collect() == []


def scores_of(rows, order, alpha, own):
    split = [(i, (t or "").encode().split()) for i, t in rows]

    def grams(w):
        return Counter(tuple(w[k:k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))

    every = sum((grams(w) for _, w in split), Counter())
    for i, w in split:
        counts = every if own else every - grams(w)
        total, sum_of = sum(len(x) for _, x in split) - (0 if own else len(w)), 0.0
        for k in range(len(w)):
            longest = min(k + 1, order)
            n = next(n for n in range(longest, 0, -1) if n == 1 or counts[tuple(w[k - n + 1:k + 1])] > 0)
            gram = tuple(w[k - n + 1:k + 1])
            one = counts[gram] / (counts[gram[:-1]] if n > 1 else total) if counts[gram] else 1 / (total + 1)
            sum_of += math.log(one) + math.log(alpha) * (longest - n)
        yield str(i), len(w), sum_of


@pytest.mark.parametrize("order, bucket, own", [(1, 1 << 24, False), (2, 1 << 24, False), (3, 3000, False), (4, 1 << 24, False), (3, 3000, True)])
def test_scores(awkward, awkward_rows, monkeypatch, order, bucket, own):
    monkeypatch.setattr(backoff, "PARTITION_BYTES", bucket)
    got = sorted((str(r.doc_id), r.n_words, r.log_score) for r in backoff.score(awkward, order=order, own=own).collect())
    want = sorted(scores_of([(i, t) for i, t, *_ in awkward_rows], order, 0.4, own))
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2]
        assert g[2] == pytest.approx(w[2], abs=1e-6)


def test_a_document_is_scored_by_the_others(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "a d"), (4, "only here")], "doc_id long, text string")
    got = {r.doc_id: r.log_score for r in backoff.score(docs).collect()}
    # a: 2 of the 7 other words; "a b" 1 of the 2 others; "a b c" 1 of 1
    assert got[1] == got[2] == pytest.approx(math.log(2 / 7) + math.log(1 / 2) + math.log(1 / 1))
    assert got[3] == pytest.approx(math.log(2 / 8) + math.log(0.4 / 9))
    assert got[4] == pytest.approx(math.log(1 / 9) + math.log(0.4 / 9))
    alone = backoff.score(docs.limit(1)).first()
    assert alone.log_score == pytest.approx(3 * math.log(1 / 1) + math.log(0.4) * 3)


def test_no_scores(nothing):
    assert backoff.score(nothing).collect() == []
