import random
import time

import pytest
from pyspark.sql import functions as F

from webcorpus.functions import pii, responses, text, vectors

# (text, [(start, end, kind)], masked text): every piece is known before anything is detected.
CASES = [
    ("", [], ""), ("   ", [], "   "), ("2024 and $1.200.000", [], "2024 and $1.200.000"),
    ("ana@x.com", [(0, 9, "EMAIL")], "«EMAIL_1»"),
    ("ana@x.com, bo@y.org, ana@x.com", [(0, 9, "EMAIL"), (11, 19, "EMAIL"), (21, 30, "EMAIL")], "«EMAIL_1», «EMAIL_2», «EMAIL_1»"),
    ("foo.bar@baz.co.uk.", [(0, 17, "EMAIL")], "«EMAIL_1»."),
    ("é.ana@x.com", [(1, 11, "EMAIL")], "é«EMAIL_1»"), ("x@y.z1", [], "x@y.z1"),
    ("at 10.0.0.1;", [(3, 11, "IP")], "at «IP_1»;"), ("é10.0.0.1 256.1.1.1", [], "é10.0.0.1 256.1.1.1"),
    ("id 20-12345678-9.", [(3, 16, "CUIT")], "id «CUIT_1»."), ("id 20123456789.", [(3, 14, "CUIT")], "id «CUIT_1»."),
    # a card takes the blank behind its last digit along if a word follows
    ("card 4111111111111111 ok", [(5, 22, "TARJETA")], "card «TARJETA_1»ok"), ("card 4111111111111111.", [(5, 21, "TARJETA")], "card «TARJETA_1»."),
    ("card 4111111111111112 no", [], "card 4111111111111112 no"),
    ("call (011) 4444-5555 now", [(5, 20, "TEL")], "call «TEL_1» now"), ("call +54 11 4444-5555 now", [(5, 21, "TEL")], "call «TEL_1» now"),
    ("😀 ñandú ana@x.com", [(8, 17, "EMAIL")], "😀 ñandú «EMAIL_1»"),
    # touching spans stay apart, overlapping ones become one of the first's kind
    ("a@10.0.0.1.com", [(0, 14, "EMAIL"), (2, 10, "IP")], "«EMAIL_1»"),
    # sixteen digits are a card and too many for a telephone
    ("5500-0000-0000-0004.", [(0, 19, "TARJETA")], "«TARJETA_1»."), ("4111 1111 1111 1111.", [(0, 19, "TARJETA")], "«TARJETA_1»."),
]


def test_spans_and_masks(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "doc_id int, text string")
    rows = pii.mask_text(df.withColumn("spans", pii.rule_spans("text")), "text", "spans").collect()
    for r in rows:
        text, spans, masked = CASES[r.doc_id]
        assert sorted((s.start, s.end, s.type) for s in r.spans) == sorted(spans), text
        assert r.masked == masked, text


def test_dense_texts_agree_with_sparse_ones(spark, monkeypatch):
    rng = random.Random(11)
    kinds = ["EMAIL", "IP", "DATO"]
    rows = []
    for doc in range(60):
        text = "".join(rng.choice("abé 😀") for _ in range(rng.randint(0, 80)))
        spans = []
        for k in range(rng.randint(0, 12) if text else 0):
            start = rng.randrange(len(text))
            spans.append((start, min(len(text), start + rng.randint(1, 6)), k % 3, rng.choice(kinds)))
        rows.append((doc, text, spans))
    df = spark.createDataFrame(rows, f"doc_id int, text string, spans {pii.SPAN_TYPE}")
    sparse = {r.doc_id: (r.masked, r.tokens, r.entities) for r in pii.mask_text(df, "text", "spans").collect()}
    monkeypatch.setattr(pii, "DENSE", 1)
    dense = {r.doc_id: (r.masked, r.tokens, r.entities) for r in pii.mask_text(df, "text", "spans").collect()}
    assert dense == sparse and any(t[2] > 3 for t in sparse.values())


def test_time_is_linear_in_the_spans_of_a_text(spark):
    def masked(n):
        text = " ".join(f"user{k % 5000}@mail.example 10.1.{k % 256}.7" for k in range(n // 2))
        df = spark.createDataFrame([(text,)], "text string").withColumn("spans", pii.rule_spans("text"))
        began = time.perf_counter()
        row = pii.mask_text(df, "text", "spans").select("masked", "entities", F.size("spans").alias("n")).first()
        return row, time.perf_counter() - began

    masked(1000)
    (row, short), (many, long) = masked(10_000), masked(100_000)
    assert (row.n, many.n, many.entities) == (10_000, 100_000, 5000 + 256)
    assert many.masked.startswith("«EMAIL_1» «IP_1» «EMAIL_2» «IP_2»") and many.masked.count("«") == 100_000
    assert long < 20 * max(short, 0.5), (short, long)


def test_texts_of_known_pieces(spark):
    rng = random.Random(3)
    pieces = [("EMAIL", lambda k: f"user{k}@mail.example"), ("IP", lambda k: f"10.1.{k % 256}.7"), ("CUIT", lambda k: f"27-{10_000_000 + k}-1"),
              ("TEL", lambda k: f"(011) {4000 + k % 1000}-{5000 + k % 1000}"), (None, lambda k: f"plain{k}x words")]
    texts = []
    for doc in range(150):
        text, want, tokens, counts = "", [], {}, {}
        masked = ""
        for _ in range(rng.randint(1, 15)):
            kind, make = rng.choice(pieces)
            value = make(rng.randrange(6))
            if kind:
                want.append((len(text), len(text) + len(value), kind))
                if value not in tokens:
                    counts[kind] = counts.get(kind, 0) + 1
                    tokens[value] = f"«{kind}_{counts[kind]}»"
            text, masked = text + value + " / ", masked + tokens.get(value, value) + " / "
        texts.append((doc, text, want, masked, len(tokens)))
    df = spark.createDataFrame([t[:2] for t in texts], "doc_id int, text string").withColumn("spans", pii.rule_spans("text"))
    for r in pii.mask_text(df, "text", "spans").collect():
        _, _, want, masked, entities = texts[r.doc_id]
        assert sorted((s.start, s.end, s.type) for s in r.spans) == want
        assert (r.masked, r.entities) == (masked, entities)


def test_very_many_spans_of_one_text(spark):
    text = " ".join(f"u{k % 700}@mail.example" for k in range(6000))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string").withColumn("spans", pii.rule_spans("text"))
    row = pii.mask_text(df, "text", "spans").first()
    assert row.entities == 700 and row.masked.split()[:2] == ["«EMAIL_1»", "«EMAIL_2»"] and row.masked.split()[705] == "«EMAIL_6»"


def test_restore_goes_longest_first(spark):
    tokens = [(f"«EMAIL_{i}»", f"v{i}@x.io") for i in range(1, 13)]
    df = spark.createDataFrame([("«EMAIL_12» «EMAIL_1» «EMAIL_2»", tokens)],
                               "c string, t array<struct<token:string,value:string>>")
    assert df.select(pii.restore_tokens("c", "t")).first()[0] == "v12@x.io v1@x.io v2@x.io"


def test_markdown_functions(spark):
    prose = "# Heading\n" + "word " * 20 + "\n" + "[a](b) " * 10 + "\nshort"
    df = spark.createDataFrame([(1, "\n\n  ## Ti tle \nbody"), (2, "body\n# no"), (3, ""), (4, prose), (5, "#\nx")],
                               "i int, md string")
    rows = {r.i: r for r in df.select("i", text.title_from_markdown("md").alias("t"), text.prose_score("md").alias("p"),
                                      text.heading_title("md").alias("h")).collect()}
    assert [rows[i].t for i in (1, 2, 3, 5)] == ["Ti tle", None, None, None]
    assert rows[4].p == len("# Heading") + 99
    assert rows[2].h == "no" and rows[3].h is None


def test_llms_and_entities(spark):
    df = spark.createDataFrame([("b ", " T ", "http://u"), ("b", None, "")], "b string, t string, u string")
    got = [r[0] for r in df.select(text.llms_txt("b", "t", "u")).collect()]
    assert got == ["# T\n\n> Fuente: http://u\n\nb\n", "# Documento\n\nb\n"]
    df = spark.createDataFrame([("a&amp;lt;&#233;&#x1F600;&bogus;&copy;",), ("plain",)], "s string")
    assert [r[0] for r in df.select(text.unescape_entities("s")).collect()] == ["a&lt;é😀&bogus;©", "plain"]


@pytest.mark.parametrize("digits, ok", [("4111111111111111", True), ("4111111111111112", False), ("5500000000000004", True), ("123", False), ("0" * 20, False), ("0" * 19, True)])
def test_luhn(spark, digits, ok):
    assert spark.range(1).select(pii.luhn_ok(F.lit(digits))).first()[0] == ok


def test_classifier_order(spark):
    rows = [
        (403, {}, "<title>Just a moment...</title>"), (200, {}, "<div class='h-captcha'></div>" + "x" * 99),
        (200, {"X-Px-Vid": "1"}, "x" * 99), (403, {}, "no"), (429, {}, "no"), (503, {}, "no"),
        (200, {}, " short "), (200, {"Server": "nginx"}, "x" * 99),
    ]
    df = spark.createDataFrame(rows, "s int, h map<string,string>, t string")
    got = [tuple(r[0]) for r in df.select(responses.classify_response("s", "h", "t", 64)).collect()]
    assert got == [("captcha", "cloudflare"), ("captcha", "hcaptcha"), ("blocked", "waf:perimeterx"),
                   ("blocked", "status:403"), ("blocked", "status:429"), ("blocked", "status:503"),
                   ("blocked", "empty_body"), ("ok", "")]


def test_auth_walls(spark):
    df = spark.createDataFrame([("Sign in to confirm you’re not a bot",), ("404",), (None,)], "m string")
    assert [r[0] for r in df.select(responses.media_auth_wall("m")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(responses.comment_auth_wall("m")).collect()] == [True, False, False]


def test_cosine(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([], []),
            (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(vectors.cosine("a", "b")).collect()] == [0, 1, 0, 0, 0, 0]


def test_places_in_arrays_shorter_and_longer_than_a_block(spark):
    lengths = [list(range(n)) for n in (0, 1, 3, pii.BLOCK, pii.BLOCK + 1, 3 * pii.BLOCK)]
    df = spark.createDataFrame([(x,) for x in lengths], "lengths array<int>")
    for r in df.select("lengths", pii._running(F.col("lengths")).alias("before")).collect():
        assert r.before == [sum(r.lengths[:k]) for k in range(len(r.lengths))]


def test_walk_and_array_functions_agree_on_odd_rows(spark, monkeypatch):
    rows = [(0, "ab", []), (1, None, None), (2, "x😀yzx", [(0, 2, 1, "A"), (1, 3, 1, "B"), (4, 5, 1, "B")]), (3, "", []), (4, "aa", [(0, 1, 1, "A"), (1, 2, 2, "B")])]
    df = spark.createDataFrame(rows, f"doc_id int, text string, spans {pii.SPAN_TYPE}").coalesce(1)

    def masked():
        return {r.doc_id: (r.masked, r.tokens, r.entities) for r in pii.mask_text(df, "text", "spans").collect()}

    assert pii.DENSE == 2  # two pieces go the cheaper way already
    walked = masked()
    monkeypatch.setattr(pii, "DENSE", 1000)
    assert masked() == walked and walked[2][0] == "«A_1»z«B_1»" and walked[4][2] == 1
