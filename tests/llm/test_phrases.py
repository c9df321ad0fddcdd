"""Collocations against counting by hand."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from webcorpus.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, longest, least, share, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        scored = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(
                100 * b >= share * a for q, b in found.items()
                if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def found(docs, **options):
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())


def test_against_counting(spark, awkward_rows, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["of", "the", "New", "york", "é", "x-ray", "New", "x.y", "a\tb", "日本", "#1", "of"]
    rows = [(" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ". ", "\n", "\x0b"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None, ""])) for _ in range(150)]
    rows += [(t, lang) for _, t, lang, _ in awkward_rows] + rows[:20]
    docs = spark.createDataFrame([(t, lang, 1, "w") for t, lang in rows], "text string, lang string, id long, words string").repartition(4)
    want = by_hand(rows, 4, 5, 80, 40)
    assert len(want) > 80
    assert found(docs, least=5, top=40) == want


def test_spills_and_bursts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD_BYTES", 2000)
    monkeypatch.setattr(phrases, "BURST", 4)
    monkeypatch.setattr(phrases, "KNOWN", 3)
    monkeypatch.setattr(phrases, "MERGE_BYTES", 256)
    rng = random.Random(4)
    rows = [(" ".join(rng.choice("abcdefghij") if k % 3 else "a" for k in range(rng.randint(1, 40))), "en") for _ in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert found(docs, least=3, top=None) == by_hand(rows, 4, 3, 80, None)


def test_very_long_texts_are_cut_at_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 64)
    rng = random.Random(5)
    rows = [("".join(rng.choice("abc") + rng.choice("   .") for _ in range(4000)), "en"), ("x y " * 500, "en"), ("", "en"), (None, None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert found(docs, least=2, top=50) == by_hand(rows, 4, 2, 80, 50)


def test_a_full_bitmap_changes_nothing(spark):
    rows = [("one two three one two four", "en")] * 3 + [("one two", "en")] * 2
    docs = spark.createDataFrame(rows, "text string, lang string")
    want = by_hand(rows, 4, 3, 80, None)
    from webcorpus.llm.scratch import Scratch

    got = phrases.count_phrases(Scratch(spark), spark, docs, 4, 3, bits=6)[2].collect()
    assert sorted(r.f for r in got if r.n == 2) == sorted(f for f in (8, 3, 3, 3))
    assert found(docs, least=3, top=None) == want


def test_a_trie_counts_and_spills_its_largest_subtrees(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 8)
    rng = random.Random(7)
    trie, want = phrases.Trie(3), Counter()
    for _ in range(40):
        grams = list({(rng.choice([1 << 60, 1 << 60 | 1, 7 << 56]), rng.randrange(0, 2**64, 2**56), rng.randrange(3)) for _ in range(rng.randint(1, 30))})
        counts = [rng.randint(1, 5) for _ in grams]
        want.update(dict(zip(grams, counts)))
        hashes = np.array([hash(g) % 2**64 for g in grams], np.uint64)
        trie.add(hashes, np.array(grams, np.uint64), np.array(counts))
    largest = max((0x10, 0x07), key=lambda top: sum(g[0] >> 56 == top for g in want))
    grams, counts = trie.spill(trie.bytes - 1)
    got = {tuple(g): c for g, c in zip(grams.tolist(), counts.tolist())}
    assert got == {g: c for g, c in want.items() if g[0] >> 56 == largest}
    grams, counts = trie.spill(0)
    got.update({tuple(g): c for g, c in zip(grams.tolist(), counts.tolist())})
    assert got == want and trie.bytes == 0


def test_prefixes_split_hot_words():
    prefixes = phrases.Prefixes(4, {5 << 60: 8})
    grams = np.array([[5 << 60, k] for k in range(64)] + [[5 << 60 | 1, k] for k in range(64)], np.uint64)
    found = prefixes(grams)
    assert len(set(found[:64].tolist())) == 8 and set(found[64:].tolist()) == {5}


def test_nothing(nothing):
    assert phrases.collocations(nothing).collect() == []
