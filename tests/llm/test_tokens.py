"""Token counts and ORC files against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from webcorpus.llm import orc_tokens, token_counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.vocabulary_path(token_counts.VOCABULARY))


def test_counts_of_odd_strings(library):
    rng = random.Random(1)
    signs = " \n\t'srtvemld a1é#!　\x1c\x85.<|endoftext|>'ll 've"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "aaaaaaaaa", "don't", "''s", " 's", "\n's", "x'llama", "日本語𝒜🙂🙂", "՘֋"]
    merges = token_counts.Merges(token_counts.vocabulary_path(token_counts.VOCABULARY))
    got = token_counts.count_batch(texts, merges, token_counts.Known())
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_of_rows(awkward, awkward_rows, library):
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in awkward_rows)
    rows = token_counts.count_tokens(awkward).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want


def test_orc_files_hold_every_id_in_order(spark, awkward, awkward_rows, library, tmp_path):
    path = str(tmp_path / "tokens")
    orc_tokens.write_tokens(awkward, path)
    got = sorted(orc_tokens.checksums(orc_tokens.read_tokens(spark, path)).collect(), key=lambda r: r.start)
    start = 0
    for row, (doc_id, text, *_) in zip(got, sorted(awkward_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = orc_tokens.lookup(spark, path, [13, 4]).collect()
    assert sorted(r.doc_id for r in found) == [4, 4, 4, 13]


def test_empty_tables(nothing):
    assert token_counts.count_tokens(nothing).collect() == []
    assert orc_tokens.tokens_round_trip(nothing).collect() == []
