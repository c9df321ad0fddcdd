import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from webcorpus import fixed
from webcorpus.operators import policy, privacy

KEY = "0123456789abcdef"
NOW = datetime(2024, 5, 1, 12, 0)


def test_merging(spark):
    rows = [(1, 0, 5, "A", 1), (1, 3, 8, "B", 2), (1, 8, 9, "C", 3), (1, 20, 30, "D", 4), (1, 22, 24, "E", 5), (2, 4, 6, "B", 2), (2, 4, 6, "A", 1)]
    df = spark.createDataFrame(rows, "doc_id int, start int, end int, type string, seq int")
    got = [tuple(r) for r in privacy.merge_spans(df).orderBy("doc_id", "start").select("doc_id", "start", "end", "type").collect()]
    assert got == [(1, 0, 8, "A"), (1, 8, 9, "C"), (1, 20, 30, "D"), (2, 4, 6, "A")]


def test_merged_spans_cover_the_same_offsets_apart(spark, monkeypatch):
    monkeypatch.setattr(privacy, "_OFFSETS_PER_SLICE", 16)
    rng = random.Random(5)
    rows = [(doc, start := rng.randint(0, 120), start + rng.randint(1, 25 if doc % 3 else 4), rng.choice("ABC"), seq)
            for doc in range(60) for seq in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "doc_id int, start int, end int, type string, seq int")
    merged = privacy.merge_spans(df).orderBy("doc_id", "start").collect()
    for doc in range(60):
        spans, out = [r for r in rows if r[0] == doc], [r for r in merged if r.doc_id == doc]
        assert {k for _, a, b, *_ in spans for k in range(a, b)} == {k for r in out for k in range(r.start, r.end)}
        assert all(a.end <= b.start for a, b in zip(out, out[1:]))
        assert all(not (a < r.end <= b - 1 or a < r.start < b) for r in out for _, a, b, *_ in spans)
        for r in out:
            first = min((s for s in spans if s[1] == r.start), key=lambda s: (s[1], s[2], s[4]))
            assert r.type == first[3]


def test_external_spans(spark):
    docs = spark.createDataFrame([(1, "Ana vive en Lugo, ana@x.com")], "doc_id int, text string")
    outside = [(1, 0, 0, 3, None, "<PRIVATE_PERSON>"), (1, 1, 50, 60, "Lugo", "<PRIVATE_ADDRESS>"),
               (1, 2, 0, 3, "nowhere", "<SECRET>"), (1, 3, 4, 8, "vive", "<ODD>"), (1, 4, 16, 22, None, "<PRIVATE_EMAIL>")]
    ext = spark.createDataFrame(outside, "doc_id int, seq int, start int, end int, text string, placeholder string")
    rows = privacy.locate_external_spans(docs, ext).orderBy("start").collect()
    assert [(r.start, r.end, r.type) for r in rows] == [(0, 3, "PERSONA"), (4, 8, "DATO"), (12, 16, "DOMICILIO"), (16, 22, "EMAIL")]
    masked = privacy.mask(docs, ext).first()
    assert masked.masked == "«PERSONA_1» «DATO_1» en «DOMICILIO_1»«EMAIL_1»"


def test_reversible_round_trip(spark):
    emails = " ".join(f"u{i}@x.io" for i in range(12))
    docs = spark.createDataFrame([(1, "angel", emails), (2, "dios", "nothing"), (3, "angel", "a@b.io")],
                                 "doc_id int, role string, text string")
    masked, maps = privacy.mask_reversible(docs, KEY, NOW)
    masked, maps = masked.cache(), maps.cache()
    by_doc = {r.doc_id: r for r in masked.collect()}
    assert by_doc[2].ref is None and "«EMAIL_12»" in by_doc[1].masked and by_doc[1].entities == 12
    assert maps.filter(F.col("value_enc").cast("string").contains("u1@x.io")).count() == 0
    one, three = by_doc[1], by_doc[3]
    requests = spark.createDataFrame(
        [("r1", NOW, one.ref, "humano", one.masked), ("r2", NOW + timedelta(seconds=1), one.ref, "angel", one.masked),
         ("r3", NOW + timedelta(seconds=2), one.ref, "angel", one.masked), ("r4", NOW, three.ref, "dios", "x"),
         ("r5", NOW + timedelta(seconds=9), three.ref, "angel", "x"), ("r6", NOW, "unknown", "dios", "x")],
        "request_id string, asked_at timestamp, ref string, role string, content string")
    none = spark.createDataFrame([], "ref string")
    answers, spent = privacy.revert(requests, maps, none, KEY, NOW)
    got = {r.request_id: (r.status, r.content) for r in answers.collect()}
    assert got == {"r1": ("role_not_allowed", None), "r2": ("ok", emails), "r3": ("gone", None),
                   "r4": ("wrong_owner", None), "r5": ("gone", None), "r6": ("gone", None)}
    again, _ = privacy.revert(requests, maps, spent, KEY, NOW)
    assert {r.status for r in again.collect()} == {"role_not_allowed", "gone"}
    late, _ = privacy.revert(requests, maps, none, KEY, NOW + timedelta(days=2))
    assert {r.status for r in late.collect()} == {"role_not_allowed", "gone"}


def test_modes_and_failure(spark):
    docs = spark.createDataFrame([(1, "a@b.io", m) for m in (fixed.MODE_DIRECT, fixed.MODE_OPAQUE, fixed.MODE_REVERSIBLE)],
                                 "doc_id int, text string, mode string")
    got = {r.mode: (r.text, r.anonymised, r.entities) for r in privacy.apply_privacy(docs).collect()}
    assert got == {"directo": ("a@b.io", False, 0), "opaco": ("«EMAIL_1»", True, 1), "reversible": ("«EMAIL_1»", True, 1)}
    env = spark.createDataFrame(
        [("x", "raw", None, True, "ok", None, {"records": "[]", "bytes": "3"}, "down"), ("y", "fine", None, True, "ok", None, {"files": "1"}, None)],
        "job_id string, content_md string, content_json string, anonymised boolean, status string, error string, meta map<string,string>, mask_error string")
    rows = {r.job_id: r for r in privacy.fail_closed(env).collect()}
    assert rows["x"].content_md is None and rows["x"].status == "error" and rows["x"].meta == {"bytes": "3"} and not rows["x"].anonymised
    assert rows["y"].content_md == "fine" and rows["y"].meta == {"files": "1"}


def test_masking_of_derived_fields(spark):
    recs = spark.createDataFrame([("j", 0, "write a@b.io", "5"), ("j", 1, "a@b.io c@d.io", None)],
                                 "job_id string, pos long, title string, price string")
    rows = privacy.mask_records(recs).orderBy("pos").collect()
    assert [(r.title, r.price) for r in rows] == [("write «EMAIL_1»", "5"), ("«EMAIL_1» «EMAIL_2»", None)]
    broken = spark.createDataFrame([("j", 0, 4111111111111111)], "job_id string, pos long, price long")
    assert privacy.mask_records(broken).count() == 0
    urls = spark.createDataFrame([("j", 0, "http://h/?m=a@b.io"), ("j", 1, None), ("j", 2, "http://h/2")], "job_id string, pos int, url string")
    assert [r.url for r in privacy.mask_urls(urls).orderBy("pos").collect()] == ["http://h/?m=«EMAIL_1»", "http://h/2"]
    many = spark.createDataFrame([("j", k, f"http://h/{k}") for k in range(50)], "job_id string, pos int, url string")
    assert privacy.mask_urls(many).count() == 50
    files = spark.createDataFrame(
        [("j", "document", 1, "http://h/a@b.io.pdf", "c@d.io"), ("j", "image", 1, "http://h/i.png", ""),
         ("k", "document", 1, "http://h/1.pdf", "acta 2023"), ("k", "document", 2, "http://h/2.pdf", "1234 x")],
        "job_id string, kind string, pos int, url string, name string")
    rows = privacy.mask_assets(files).orderBy("kind").collect()
    assert [(r.job_id, r.url, r.name) for r in rows] == [("j", "http://h/«EMAIL_1»", "«EMAIL_1»"), ("j", "http://h/i.png", "")]


def test_numbers_over_a_job_do_not_depend_on_its_slices(spark, monkeypatch):
    rng = random.Random(6)
    values = [f"u{k}@m.example" for k in range(40)] + [f"10.0.0.{k}" for k in range(30)]
    rows, want = [], []
    for job in ("a", "b", None):
        numbers, tokens = {}, {}
        for pos in range(300 if job == "a" else 5):
            found = rng.choices(values, k=rng.randint(0, 3))
            for value in found:
                kind = "EMAIL" if "@" in value else "IP"
                if value not in tokens:
                    numbers[kind] = numbers.get(kind, 0) + 1
                    tokens[value] = f"«{kind}_{numbers[kind]}»"
            rows.append((job, pos, " / ".join(found), pos))
            want.append((job, pos, " / ".join(tokens[v] for v in found), pos))
    df = spark.createDataFrame(rows, "job_id string, pos long, title string, price long").repartition(5)
    monkeypatch.setattr(privacy, "LINES_PER_SLICE", 7)
    got = sorted(((r.job_id, r.pos, r.title, r.price) for r in privacy.mask_records(df.filter("job_id IS NOT NULL")).collect()))
    assert got == sorted(w for w in want if w[0])
    listed = df.select("job_id", "pos", F.col("title").alias("url")).filter("job_id IS NOT NULL")
    urls = {}
    for r in privacy.mask_urls(listed).orderBy("pos").collect():
        urls.setdefault(r.job_id, []).append(r.url)
    assert urls == {job: [t for j, _, t, _ in want if j == job and t] for job in ("a", "b")}


def test_a_huge_job_is_masked_in_bounded_tasks(spark):
    rows = 200_000
    df = spark.range(rows).select(F.lit("j").alias("job_id"), F.col("id").alias("pos"), F.concat(F.lit("u"), F.col("id") % 1000, F.lit("@m.example")).alias("title"))
    out = privacy.mask_records(df)
    assert out.filter(F.col("title") != F.concat(F.lit("«EMAIL_"), F.col("pos") % 1000 + 1, F.lit("»"))).isEmpty() and out.count() == rows
    assert "collect_list(struct(pos" not in out._jdf.queryExecution().toString()


def test_names_torn_by_line_ends_empty_the_job(spark):
    def left(*names):
        files = spark.createDataFrame([("j", "document", k, f"http://h/{k}.pdf", n) for k, n in enumerate(names, 1)], "job_id string, kind string, pos int, url string, name string")
        return privacy.mask_assets(files).count()

    assert left("call 011", "4444", "5555 x") == 0 and left("call (011)", "4444-5555") == 0 and left("11", "22", "33", "4444") == 0
    assert left("call 011", "x", "4444 5555") == 3 and left("2023", "word") == 2 and left("a@b.io", None) == 2


def test_private_extraction(spark):
    docs = spark.createDataFrame([(i, "mail a@b.io", m) for i, m in enumerate(("directo", "opaco", "reversible"))],
                                 "doc_id int, text string, mode string")

    def complete(systems, users):
        return [json.dumps({"mail": u.split("mail ")[1].split("\n")[0]}, ensure_ascii=False) for u in users]

    got = {r.doc_id: (json.loads(r.json)["mail"], r.anonymised) for r in
           privacy.private_extract(docs, {"type": "object"}, complete).collect()}
    assert got == {0: ("a@b.io", False), 1: ("«EMAIL_1»", True), 2: ("a@b.io", True)}


def test_private_extraction_masks_once_and_holds_one_python_worker_per_task(spark, capsys):
    rows = [(1, "mail a@b.io, c@d.io", "reversible"), (1, "mail a@b.io", "opaco"), (None, "mail a@b.io", "reversible"), (2, None, "reversible"), (3, "mail e@f.io", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, mode string")

    def complete(systems, users):
        return [json.dumps({"mail": u.split("mail ")[1].split("\n")[0]}, ensure_ascii=False) if u else None for u in users]

    done = privacy.private_extract(docs, {"type": "object"}, complete)
    done.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInPandas") == 1 and "EvalPython" not in plan
    stored = [str(r) for path in done.inputFiles() for r in spark.read.parquet(path).collect()]
    assert stored and not any("a@b.io" in r or "c@d.io" in r for r in stored)
    got = sorted(((r.doc_id, r.json and json.loads(r.json)["mail"], r.error is None, r.entities) for r in done.collect()), key=str)
    # A repeated key meets its answers in all pairs, a null one in none.
    assert got == [(1, "a@b.io", True, 2), (1, "a@b.io, c@d.io", True, 2), (1, "«EMAIL_1»", True, 1), (1, "«EMAIL_1», «EMAIL_2»", True, 1), (2, None, False, 0)]


def test_policy(spark):
    rows = [("humano", "directo"), ("humano", None), ("angel", None), ("dios", None), ("angel", "reversible"), ("nobody", None)]
    df = spark.createDataFrame(rows, "role string, requested string")
    got = [tuple(r[0]) for r in df.select(policy.resolve_mode("role", "requested")).collect()]
    assert got == [(None, True), ("opaco", False), ("opaco", False), ("directo", False), ("reversible", False), (None, True)]
    df = spark.createDataFrame([("angel", "dios"), ("angel", "humano"), ("dios", None)], "session string, requested string")
    assert [r[0] for r in df.select(policy.effective_role("session", "requested")).collect()] == ["angel", "humano", "dios"]


def test_capabilities(spark):
    base = dict(role="humano", tier_hint=None, capture_api=False, proxy=None, captcha_api_url=None, captcha_api_key=None,
                crawl_depth=0, paginate=False, data_tree=False, cookies_browser=None)
    wishes = [{}, {"tier_hint": 2}, {"capture_api": True}, {"proxy": "p"}, {"captcha_api_url": "u", "captcha_api_key": "k"},
              {"crawl_depth": 1}, {"paginate": True}, {"data_tree": True}, {"cookies_browser": "x"}, {"captcha_api_url": "u"}]
    schema = ("role string, tier_hint int, capture_api boolean, proxy string, captcha_api_url string, captcha_api_key string, "
              "crawl_depth int, paginate boolean, data_tree boolean, cookies_browser string")
    df = spark.createDataFrame([tuple({**base, **w}.values()) for w in wishes], schema)
    got = [r.denials for r in policy.check_capabilities(df).collect()]
    assert got == [[], ["tier"], ["capture"], ["proxy"], ["solver"], ["crawl"], [], ["data_tree"], ["browser_cookies"], []]
    admin = spark.createDataFrame([tuple({**base, "role": "dios", "data_tree": True, "tier_hint": 3, "cookies_browser": "x"}.values())], schema)
    assert policy.check_capabilities(admin).first().allowed
    assert policy.check_capabilities(admin, sidekick=True).first().denials == ["data_tree", "browser_cookies"]


def test_maps_of_a_reversible_run_are_not_searched_for_again(spark):
    docs = spark.createDataFrame([(1, "dios", "a@x.example or b@x.example"), (2, "dios", "nothing"), (3, "angel", None)], "doc_id int, role string, text string")
    masked, maps = privacy.mask_reversible(docs, "sixteen byte key", datetime(2024, 1, 1))
    for rows in (masked, maps):
        assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert masked.columns == ["doc_id", "role", "masked", "entities", "ref"] and masked.count() == 3
    back = privacy.rehydrate(masked.withColumnRenamed("masked", "content"), privacy.open_maps(maps, "sixteen byte key"))
    assert {r.doc_id: r.content for r in back.collect()} == {1: "a@x.example or b@x.example", 2: "nothing", 3: None}
    assert sorted(r.token for r in maps.collect()) == ["«EMAIL_1»", "«EMAIL_2»"]
