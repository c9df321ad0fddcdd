"""Media round trips, and languages of rows that were held out."""

import hashlib
import zlib

import numpy as np
import pytest

from webcorpus.llm import language, media


def test_media_hold_every_text(awkward, awkward_rows):
    want = []
    for doc_id, text, *_ in awkward_rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((str(doc_id), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(media.to_wav(payload)).hexdigest()))
    rows = media.media_round_trip(awkward).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in rows) == sorted(want)
    assert len({tuple(r.codes) for r in rows if r.payload_sha256 == want[4][3]}) == 1


def test_fingerprints_find_tones():
    t = np.arange(192 * 40)
    tone = (128 + 60 * np.sin(2 * np.pi * 10 * t / 192) * (1 + np.sin(2 * np.pi * t / 3000)) / 2).astype(np.uint8)
    at, bins = media.peaks(tone)
    assert (bins == 10).any() and set(bins[(bins >= 6) & (bins < 14)]) == {10}
    codes = media.fingerprint(tone)
    assert (np.diff(codes >> 20) >= 0).all() and len(codes)
    assert len(media.fingerprint(np.full(192 * 5, 32, np.uint8))) == 0


def test_no_media(nothing):
    assert media.media_round_trip(nothing).collect() == []


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 4, (6, 5)).astype(np.uint16)
    windows[4:, 2] = language.PAD
    labels, importance = np.array([0, 1, 2, 0, 1]), np.array([1.0, 0.5, 2.0, 1.0, 0.5])

    def normal(*shape):
        return rng.standard_normal(shape) * 0.4

    size = 3
    net = language.Network(["a", "b", "c"], tuple(language.Direction(normal(9, 257), normal(9, size)) for _ in range(2)), normal(3, 6), normal(3, 1))
    weights = [net.layers[0].bytes, net.layers[0].state, net.layers[1].bytes, net.layers[1].state, net.out, net.bias]

    def loss():
        on, back = net.states(windows)
        real = windows != language.PAD
        return sum(-(np.log(net.position_chances(on[t], back[t])[labels, np.arange(5)]) * importance * real[t]).sum() for t in range(6)) / real.sum()

    grads = language.gradients(net, windows, labels, importance)
    for w, g in zip(weights, grads):
        for _ in range(6):
            spot = tuple(rng.integers(0, s) for s in w.shape)
            if w.shape[1] == 257:
                spot = (spot[0], int(rng.choice([0, 1, 2, 3])))
            kept = w[spot]
            w[spot] = kept + 1e-2
            up = loss()
            w[spot] = kept - 1e-2
            down = loss()
            w[spot] = kept
            assert g[spot] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_windows_hold_every_byte():
    raw = [b"", b"a" * 64, b"b" * 65, b"c"]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    windows, firsts = language.cut_windows(data, offsets)
    assert firsts.tolist() == [0, 0, 1, 3, 4]
    assert [bytes(w[w != language.PAD].astype(np.uint8)) for w in windows.T] == [b"a" * 64, b"b" * 64, b"b", b"c"]


def test_languages_of_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = language.identify(docs).withColumn("out", language.held_out())
    rows = judged.filter("out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_predictions_of_odd_rows(awkward, awkward_rows):
    got = language.identify(awkward).collect()
    assert len(got) == len(awkward_rows)
    unknown = {r.text for r in got if r.lang_pred == language.UNKNOWN}
    assert unknown == {None, "", " \n\t ", "%%% *** 123"}
    same = {r.lang_pred for r in got if r.text == awkward_rows[4][1]}
    assert len(same) == 1


def test_without_labels(spark, nothing):
    assert language.identify(nothing).collect() == []
    rows = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify(rows).collect()] == [language.UNKNOWN]
