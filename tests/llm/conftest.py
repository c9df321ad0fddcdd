import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tie long, size int, path string, score double, covers string, target string, ids string"


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows and ids."""
    rng = random.Random(5)
    passage, base = sentence(rng, 60), sentence(rng, 150)
    near = base.split()
    near[75] = "other"
    texts = [
        None, "", " \n\t ", "é" * 70 + " 日本 🙂", base, base, " ".join(near), base.upper(),
        sentence(rng, 20) + " " + passage, passage + "\n" + sentence(rng, 25), sentence(rng, 40) + " " + passage + " " + sentence(rng, 3),
        sentence(rng, 4000), "a " * 300, "one two three", "%%% *** 123", "<|endoftext|> x<|endoftext|>", "aaaaaaa" * 40,
    ]
    rows = [(k, t, "en" if k % 2 else "fr", ["b", "a", None, "c"][k % 4]) for k, t in enumerate(texts)]
    rows += [rows[4], rows[1], (4, passage, "en", "a"), (None, base, None, "a"), (None, passage + " end", "en", None)]
    rows += [(100 + k, sentence(rng, rng.randint(1, 80), "ab" if k % 5 == 0 else "qrstuvw"), "de" if k % 5 == 0 else "en", f"s{k % 3}") for k in range(40)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    full = [(i, t, lang, source, len(t or ""), 1, 2, "p", 0.5, "c", "t", "i") for i, t, lang, source in awkward_rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
