"""Repeated passages of words and bytes against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from webcorpus.llm import blocks, factors, suffix_merge


def key(doc_id):
    return (doc_id is not None, doc_id or 0)


def words_left(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    starts = Counter(tuple(w[k:k + window]) for _, w in split for k in range(len(w) - window + 1))
    for i, words in split:
        gone = {k + j for k in range(len(words) - window + 1) if starts[tuple(words[k:k + window])] > 1 for j in range(window)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        yield i, len(words), len(gone), hashlib.sha256(kept).hexdigest()


def bytes_left(rows, window):
    first = {}
    for i, text in sorted(rows, key=lambda r: key(r[0])):
        raw = (text or "").encode()
        for k in range(len(raw) - window + 1):
            first.setdefault(raw[k:k + window], i)
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            if key(first[raw[k:k + window]]) < key(i):
                gone[k:k + window] = b"\1" * window
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        yield i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


def pairs(rows):
    return [(i, t) for i, t, *_ in rows]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (key(r[0]), r[1:]))


@pytest.mark.parametrize("window", [35, 12])
def test_words(awkward, awkward_rows, window):
    got = factors.remove_repeats(awkward, window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert in_order(got) == in_order(words_left(pairs(awkward_rows), window))


def test_bytes(awkward, awkward_rows):
    got = suffix_merge.remove_repeats(awkward).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "kept_sha256").collect()
    assert in_order(got) == in_order(bytes_left(pairs(awkward_rows), 50))


def test_bytes_over_many_key_ranges_and_runs(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(suffix_merge, "BUCKET_BYTES", 3000)
    passages = ["".join(rng.choice("ab ") for _ in range(90)) for _ in range(6)]
    rows = [(k, "".join(rng.choice([rng.choice(passages), "xyz" * rng.randint(1, 9), "".join(rng.choice("abc") for _ in range(60))]) for _ in range(4))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_merge.remove_repeats(docs).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "kept_sha256").collect()
    assert in_order(got) == in_order(bytes_left(rows, 50))


def test_empty_tables(nothing):
    assert factors.remove_repeats(nothing).collect() == []
    assert suffix_merge.remove_repeats(nothing).collect() == []


def test_anchors_cut_all_windows_into_blocks():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 3, 500).astype(np.uint64)
    firsts = np.array([0, 0, 7, 120, 121, 160, 500])
    low, high, at, _ = blocks.anchors(values, firsts, 12, 4)
    windows = [k for a, b in zip(firsts[:-1], firsts[1:]) for k in range(a, b - 11)]
    assert [k for a, b in zip(low, high) for k in range(a, b + 1)] == windows
    assert all(h <= p <= lo + 8 for lo, h, p in zip(low, high, at))


def test_loser_trees_merge_runs():
    rng = random.Random(6)
    for runs in (1, 2, 3, 7):
        lists = [sorted({"".join(rng.choice("ab") for _ in range(20)).encode() for _ in range(rng.randint(0, 80))}) for _ in range(runs)]
        every = [k for run in lists for k in run]
        if not every:
            continue
        raw = np.zeros((len(every), 24), np.uint8)
        raw[:, :20] = np.frombuffer(b"".join(every), np.uint8).reshape(-1, 20)
        keys = raw.view(">u8").astype(np.uint64)
        shared, rest = suffix_merge.front_code(keys[:len(lists[0])], 20)
        assert (suffix_merge.front_decode(shared, rest, 20) == keys[:len(lists[0])]).all()
        firsts = np.cumsum([0, *map(len, lists)])
        begin, end = suffix_merge.lane_bounds(keys, firsts, 5)
        order, prefix = suffix_merge.merge_runs(keys, suffix_merge.prefixes_before(keys, 20), begin, end, 20)
        merged = [every[k] for k in order]
        assert merged == sorted(every)
        assert [p == 20 for p in prefix[1:]] == [a == b for a, b in zip(merged, merged[1:])]


def test_windows_of_an_anchor_with_many_blocks(spark, monkeypatch):
    """No window becomes a row before it is known to be repeated, but for those of anchors with very many blocks."""
    monkeypatch.setattr(blocks, "HOT", 4)
    monkeypatch.setattr(blocks, "BUCKET_WINDOWS", 200)
    plans, keep = [], blocks.Scratch.keep
    monkeypatch.setattr(blocks.Scratch, "keep", lambda self, df, free=True: plans.append(df._jdf.queryExecution().toString()) or keep(self, df, free))
    rng = random.Random(3)
    line = "".join(rng.choice("abcdef ") for _ in range(70))
    rows = [(k, "".join(rng.choice("uvwxyz") for _ in range(k % 40)) + line[:60 + k % 11] + "".join(rng.choice("uvwxyz") for _ in range(30))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_merge.remove_repeats(docs).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "kept_sha256").collect()
    assert in_order(got) == in_order(bytes_left(rows, 50))
    assert not any("posexplode" in plan for plan in plans)


def test_key_ranges_answer_once_per_document(spark, monkeypatch):
    monkeypatch.setattr(suffix_merge, "BUCKET_BYTES", 3000)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(k % 30, "".join(rng.choice("klmnop") for _ in range(40)) + passage[k:]) for k in range(60)] + [(None, passage), (3, passage), (3, passage)]
    texts = blocks.keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = suffix_merge.repeated_suffixes(texts).collect()
    assert len(found) == len({(r.doc_id, r.tie) for r in found}) == 62
    assert all(len(r.spots) > 10 for r in found)


def test_trees_of_many_runs_stay_small(monkeypatch):
    """Hundreds of runs meet in one key range of a large corpus; a tree over all of them leaves no lanes to work in step."""
    monkeypatch.setattr(suffix_merge, "RUN", 50)
    widths, merge = [], suffix_merge.merge_runs
    monkeypatch.setattr(suffix_merge, "merge_runs", lambda keys, shared, begin, end, depth: widths.append(begin.shape[1]) or merge(keys, shared, begin, end, depth))
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcd ") for _ in range(120)) for _ in range(40)]
    texts = ["".join(rng.choice([rng.choice(passages), "".join(rng.choice("abcdefgh") for _ in range(90))]) for _ in range(20)) for _ in range(90)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [t], "tie": [k], "slot": pa.array([0], pa.int32())}) for k, t in enumerate(texts)]
    runs = pa.Table.from_batches(list(suffix_merge._runs(np.empty((0, 3), np.uint64), 50, 20)(iter(batches))))
    assert runs.num_rows > 70
    (row,) = suffix_merge._merge(20)(runs).to_pylist()
    assert max(widths) <= 32
    grams, at = Counter(), {}
    for k, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        at[k] = sorted(blocks.anchors(*suffix_merge.byte_units(data, np.array([0, len(data)])), 50, 20)[2].tolist())
        grams.update(text[p:p + 20] for p in at[k])
    wanted = {k: [p for p in places if grams[texts[k][p:p + 20]] > 1] for k, places in at.items()}
    bounds = np.cumsum([0, *row["sizes"]])
    got = {k: sorted(row["spots"][a:b]) for k, a, b in zip(row["ids"], bounds, bounds[1:])}
    assert got == {k: places for k, places in wanted.items() if places}
