import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from webcorpus.functions import pii, responses, sql, urls, vectors
from webcorpus.operators import robots
from webcorpus.plans import jobs
from webcorpus.sources import endpoints, envelopes, pages, sinks
from webcorpus.streaming import state, streams
from webcorpus.streaming.keyed_table import KeyedTable

T0 = datetime(2024, 1, 1)


def test_sql_functions_equal_the_column_functions(spark, sf_dir):
    names = sql.register(spark)
    assert len(names) == len(sql.SCALARS)
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("sql_pages")
    for name, column in {"url_host": urls.url_host, "url_path": urls.url_path, "url_query": urls.url_query, "url_ext": urls.url_ext,
                         "redact_url": urls.redact_url, "is_chrome": urls.is_chrome, "is_telemetry": urls.is_telemetry,
                         "video_provider": urls.video_provider, "url_scheme": urls.url_scheme}.items():
        both = spark.table("sql_pages").select(F.expr(f"wc_{name}(url)").alias("a"), column("url").alias("b"))
        assert both.filter("NOT a <=> b").count() == 0, name
    row = spark.sql("""SELECT wc_luhn_ok('4111111111111111') l, wc_luhn_ok('4111111111111112') m, wc_phone_ok('11 2222-3333') p,
        wc_cosine(array(float(1), float(0)), array(float(1), float(1))) c, wc_cosine(array(float(0)), array(float(1))) z,
        wc_same_domain('http://A/x', 'https://a') s, wc_reg_domain('a.b.c') r, wc_asset_kind('pdf') k,
        wc_detect_captcha('<div class="g-recaptcha">') v, wc_in_scope('http://h/a/b', '/a') i""").first()
    assert (row.l, row.m, row.p, round(row.c, 6), row.z, row.s, row.r, row.k, row.v, row.i) == (
        True, False, True, 0.707107, 0.0, True, "b.c", "document", "recaptcha", True)
    tags = spark.sql("SELECT p.page_id, e.tag FROM sql_pages p, LATERAL wc_html_elements(p.html) e WHERE e.tag = 'h1'")
    assert tags.count() == spark.table("sql_pages").count()
    nodes = spark.sql("""SELECT n.key, n.scalar FROM VALUES ('{"k": 1}') AS d(b), LATERAL wc_json_nodes(d.b) n WHERE n.key IS NOT NULL""")
    assert [tuple(r) for r in nodes.collect()] == [("k", "1")]
    assert pii and responses and vectors


def test_decoding(spark):
    rows = [(1, "text/html; charset=utf-8", "é".encode()), (2, "text/html; charset=ISO-8859-1", b"\xe9"), (3, None, b"a\xffb"),
            (4, "text/html;charset=shift_jis", "日本".encode("shift_jis")), (5, "text/html; charset=nonsense", "ñ".encode()),
            (6, "text/plain; charset=us-ascii", b"a\xe9"), (7, "text/html", b"x" * 50)]
    df = spark.createDataFrame(rows, "page_id int, content_type string, content binary")
    got = {r.page_id: r.text for r in pages.decode_body(df, max_bytes=40).collect()}
    assert got == {1: "é", 2: "é", 3: "a�b", 4: "日本", 5: "ñ", 6: "a�"}


def test_files_in_and_out(spark, tmp_path, sf_dir):
    df = pages.read_pages(spark, f"{sf_dir}/pages.parquet")
    df.select("page_id", "url").limit(3).write.json(str(tmp_path / "j"))
    assert pages.read_pages(spark, str(tmp_path / "j"), "json").count() == 3
    assert pages.read_pages(spark, str(tmp_path / "j" / "*.json"), "binaryFile").columns == ["url", "content", "bytes"]
    recs = spark.createDataFrame([(1, 'a "q"\nb'), (2, None)], "id int, title string")
    sinks.export_records(recs, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert sorted((r.id, r.title) for r in back.collect()) == [("1", 'a "q"\nb'), ("2", None)]
    env = spark.createDataFrame([("j", "markdown", "# x\ny", {"proxy": "p", "ok": "1"}), ("k", "json", None, {})],
                                "job_id string, output_format string, content_md string, meta map<string,string>")
    sinks.write_results(env, str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r")).orderBy("job_id").collect()
    assert stored[0].meta == {"ok": "1"} and stored[0].content_md == "# x\ny" and stored[1].output_format == "json"


def test_upsert_and_embeddings(spark):
    schema = "job_id string, source_url string, status string, content_md string, tier int, meta map<string,string>"
    old = spark.createDataFrame([("a", "u1", "pendiente", None, None, {}), ("b", "u2", "ok", "x", 1, {})], schema)
    new = spark.createDataFrame([("a", "CHANGED", "ok", "md", 2, {"cookies": "s", "n": "1"}), ("c", "u3", "ok", "z", 0, {})], schema)
    rows = {r.job_id: r for r in envelopes.upsert_envelopes(old, new).collect()}
    assert rows["a"].source_url == "u1" and rows["a"].status == "ok" and rows["a"].meta == {"n": "1"} and rows["a"].tier == 2
    assert rows["b"].content_md == "x" and rows["c"].source_url == "u3"
    vecs = spark.createDataFrame([("a", [1.0]), ("zz", [2.0])], "job_id string, embedding array<float>")
    got = {r.job_id: r.embedding for r in envelopes.attach_embeddings(old, vecs).collect()}
    assert got == {"a": [1.0], "b": None}


PAGES = [
    ("http://h.org/", "<h1>Root</h1><p>Write to ana@x.com now</p><a href='/a'>a</a><a href='/f.pdf'>the file</a>"),
    ("http://h.org/a", "<h1>Leaf</h1><p>Plain text</p>"),
    ("http://h.org/l?page=1", "<p>one</p>"), ("http://h.org/l?page=2", "<p>two</p>"),
    ("http://h.org/empty", "<nav></nav>"),
]


def request(job, url, role="dios", mode="directo", fmt="markdown", depth=0, most=1, paginate=False):
    return (job, url, role, mode, fmt, depth, most, paginate, "domain")


def test_jobs_end_to_end(spark):
    corpus = spark.createDataFrame(PAGES, "url string, html string")
    rows = [
        request("one", PAGES[0][0]), request("opaque", PAGES[0][0], "humano", None, "llms_txt"), request("denied", PAGES[0][0], "humano", "directo"),
        request("crawl", PAGES[0][0], depth=1, most=5), request("sweep", PAGES[2][0], paginate=True, most=9),
        request("gone", "http://h.org/none"), request("nocrawl", "http://h.org/none", depth=2, most=3), request("empty", PAGES[4][0]),
        request("json", PAGES[0][0], "angel", "reversible", "json"),
    ]
    reqs = spark.createDataFrame(rows, "job_id string, url string, role string, privacy_mode string, output_format string, "
                                       "crawl_depth int, max_pages int, paginate boolean, crawl_scope string")

    def complete(systems, users):
        return [json.dumps({"mail": u.split("Write to ")[1].split(" now")[0]}, ensure_ascii=False) for u in users]

    got = {r.job_id: r for r in jobs.run_jobs(reqs, corpus, {"type": "object", "required": ["mail"]}, complete).collect()}
    assert got["one"].status == "ok" and "ana@x.com" in got["one"].content_md and got["one"].content_md.startswith("# Root")
    assert got["opaque"].content_md.startswith("# Root\n\n> Fuente: http://h.org/\n\n# Root") and "«EMAIL_1»" in got["opaque"].content_md
    assert got["opaque"].anonymised and got["opaque"].privacy_mode == "opaco" and got["opaque"].meta["entities"] == "1"
    assert got["denied"].status == "error" and got["denied"].content_md is None
    assert got["crawl"].content_md.startswith("## http://h.org/\n\n# Root") and "\n\n---\n\n## http://h.org/a" in got["crawl"].content_md
    assert [p["url"] for p in json.loads(got["crawl"].content_json)["pages"]] == ["http://h.org/", "http://h.org/a"]
    assert json.loads(got["crawl"].meta["files"])[0]["name"] == "the file" and got["crawl"].meta["pages"] == "2"
    assert "one" in got["sweep"].content_md and "two" in got["sweep"].content_md
    assert got["gone"].error == jobs.FETCH_ERROR and got["nocrawl"].error == jobs.crawl.EMPTY_CRAWL_ERROR and got["empty"].error == jobs.EMPTY_ERROR
    assert json.loads(got["json"].content_json) == {"mail": "ana@x.com"} and got["json"].anonymised and got["json"].content_md is None


def test_reversible_jobs_keep_their_maps(spark, tmp_path):
    corpus = spark.createDataFrame(PAGES, "url string, html string")
    rows = [request("rev", PAGES[0][0], "dios", "reversible"), request("llms", PAGES[0][0], "angel", "reversible", "llms_txt"), request("direct", PAGES[0][0]),
            request("opaque", PAGES[0][0], "humano", "opaco"), request("json", PAGES[0][0], "angel", "reversible", "json"), request("plain", PAGES[2][0], "dios", "reversible"),
            request("gone", "http://h.org/none", "dios", "reversible")]
    reqs = spark.createDataFrame(rows, "job_id string, url string, role string, privacy_mode string, output_format string, "
                                       "crawl_depth int, max_pages int, paginate boolean, crawl_scope string")
    secret, base = "0123456789abcdef", str(tmp_path / "store")
    done = jobs.run_reversible_jobs(reqs, corpus, secret, T0, schema={"type": "object"}, complete=lambda s, u: ["{}" for _ in u])
    jobs.store_version(base, 1, dict(zip(("envelopes", "maps"), done)))
    jobs.store_version(base, 2, dict(zip(("envelopes", "maps"), done)))
    got = {r.job_id: r for r in jobs.stored_version(spark, base, "envelopes").collect()}
    assert {k for k, r in got.items() if r.mapping_ref} == {"rev", "llms"} and got["gone"].status == "error"
    maps = jobs.stored_version(spark, base, "maps")
    assert {r.ref for r in maps.collect()} == {got["rev"].mapping_ref, got["llms"].mapping_ref} and "ana@x.com" not in str(maps.collect())
    asked = spark.createDataFrame([(k, T0, got[k].mapping_ref, got[k].role, got[k].content_md) for k in ("rev", "llms")], "request_id string, asked_at timestamp, ref string, role string, content string")
    answers = {r.request_id: r for r in jobs.privacy.revert(asked, maps, spark.createDataFrame([], "ref string"), secret, T0)[0].collect()}
    assert answers["rev"].content == got["direct"].content_md and "ana@x.com" in answers["llms"].content and "«EMAIL_1»" in got["llms"].content_md


def test_jobs_read_only_pages_they_can_reach(spark):
    pages = spark.createDataFrame([(f"http://{h}/{k}", "x") for h in ("a", "b") for k in range(3)], "url string, html string")

    def reached(*rows):
        reqs = spark.createDataFrame(rows, "job_id string, url string, crawl_depth int, max_pages int, paginate boolean")
        return sorted(r.url for r in jobs._within_reach(pages, reqs).collect())

    assert reached(("s", "http://a/1", 0, 1, False), ("t", "http://none/", None, None, None)) == ["http://a/1"]
    assert reached(("s", "http://a/1", 0, 1, False), ("c", "http://b/0", 2, 5, False)) == ["http://a/1", "http://b/0", "http://b/1", "http://b/2"]
    assert reached(("c", "http://b/0", 2, 5, False), ("s", "http://b/1", 0, 1, False)) == ["http://b/0", "http://b/1", "http://b/2"]
    assert len(reached(("p", "http://b/0", 0, 5, True))) == 6


def test_repeated_urls_and_missing_limits(spark):
    captures = [("http://h.org/", f"<h1>Root</h1><p>{'the first text ' * 9}</p>", T0), ("http://h.org/", f"<h1>Root</h1><p>{'the second text ' * 9}</p>", T0 + timedelta(days=1)),
                ("http://h.org/", f"<h1>Root</h1><p>{'the second text ' * 9}</p>", T0 + timedelta(days=1))]
    corpus = spark.createDataFrame(captures, "url string, html string, fetched_at timestamp")
    rows = [("single", "http://h.org/", "dios", None, "md", None, None, None, None), ("crawl", "http://h.org/", "dios", None, "md", None, 5, None, None)]
    reqs = spark.createDataFrame(rows, "job_id string, url string, role string, privacy_mode string, output_format string, "
                                       "crawl_depth int, max_pages int, paginate boolean, crawl_scope string")
    for r in jobs.run_jobs(reqs, corpus).collect():
        assert r.status == "ok" and "second text" in r.content_md and "first" not in r.content_md, r
        assert r.meta["pages"] == "1" and r.content_md.count("# Root") == 1


def test_data_tree(spark):
    corpus = spark.createDataFrame(PAGES[:2], "url string, html string")
    rows = [("http://h.org/a", 0, "http://h.org/api/i", 200, "application/json", json.dumps({"r": [{"title": "T", "id": 1}]})),
            ("http://h.org/a", 1, "http://z.io/big", 200, "application/json", json.dumps({"r": [{"title": "B" * 90}]}))]
    captured = endpoints.read_endpoints(spark.createDataFrame(rows, "page_url string, seq int, url string, status int, content_type string, body string"))
    seeds = spark.createDataFrame([("j", "http://h.org/")], "job_id string, url string")
    nodes, recs = jobs.data_tree(corpus, captured, seeds)
    got = {r.url: r for r in nodes.collect()}
    assert got["http://h.org/a"].endpoints_count == 2 and got["http://h.org/a"].records_count == 1 and got["http://h.org/"].depth == 0
    assert [r.title for r in recs.collect()] == ["B" * 90]
    total = jobs.crawl.tree_summary(nodes).first()
    assert (total.nodes, total.api_endpoints, total.records, total.roots) == (2, 2, 1, 1) and robots


def stream_of(spark, tmp_path, rows, schema, name, files=2):
    folder = str(tmp_path / name)
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streams_match_batches(spark, tmp_path):
    rows = [(f"k{i % 3}", T0 + timedelta(seconds=i * 7), i) for i in range(60)]
    attempts = stream_of(spark, tmp_path, rows, "key string, ts timestamp, seq bigint", "rl")
    out = streams.run_available(state.stream_rate_limit(attempts, 2)).collect()
    windows = {}
    for key, ts, _ in rows:
        windows[(key, int((ts - datetime(1970, 1, 1)).total_seconds() // 60))] = windows.get((key, int((ts - datetime(1970, 1, 1)).total_seconds() // 60)), 0) + 1
    assert len(out) == 60 and sum(r.allowed for r in out) == sum(min(2, n) for n in windows.values())

    ups = [(f"j{i % 4}", T0 + timedelta(hours=i), i, f'{{"v": {i}}}') for i in range(20)]
    updates = stream_of(spark, tmp_path, ups, "job_id string, ts timestamp, seq bigint, envelope string", "env")
    latest = streams.run_available(state.stream_latest_envelope(updates), "update")
    newest = {r.key: r.payload for r in latest.groupBy("key").agg(F.max_by("payload", "at").alias("payload")).collect()}
    assert newest == {f"j{i % 4}": f'{{"v": {i}}}' for i in range(16, 20)}

    pushes = [("c", f"u{i % 5}", i) for i in range(20)]
    urls_stream = stream_of(spark, tmp_path, pushes, "crawl_id string, url string, seq bigint", "fr")
    assert streams.run_available(streams.stream_frontier(urls_stream)).count() == 5

    maps = [("r1", "put", T0, 0, "angel", T0 + timedelta(days=1)), ("r1", "get", T0 + timedelta(seconds=1), 1, "humano", None),
            ("r1", "get", T0 + timedelta(seconds=2), 2, "angel", None), ("r1", "get", T0 + timedelta(seconds=3), 3, "angel", None),
            ("r2", "put", T0, 4, "angel", T0 + timedelta(days=1)), ("r2", "get", T0 + timedelta(days=2), 5, "angel", None),
            ("r3", "get", T0, 6, "dios", None), ("r4", "put", T0, 7, "angel", T0 + timedelta(days=1)), ("r4", "get", T0, 8, "dios", None)]
    entries = stream_of(spark, tmp_path, maps, "ref string, kind string, ts timestamp, seq bigint, role string, expires_at timestamp", "tm", 1)
    got = {r.seq: r.status for r in streams.run_available(state.stream_token_maps(entries)).collect()}
    assert got == {1: "role_not_allowed", 2: "ok", 3: "gone", 5: "gone", 6: "gone", 8: "wrong_owner"}

    wins = [("d", 1, "ok", T0, 0), ("d", 3, "blocked", T0 + timedelta(hours=2), 1), ("d", 2, "ok", T0 + timedelta(hours=1), 2)]
    cache = stream_of(spark, tmp_path, wins, "domain string, tier int, outcome string, ts timestamp, seq bigint", "tc", 1)
    row = streams.run_available(state.stream_tier_cache(cache), "update").first()
    assert row.payload == "2" and row.expires - row.at == 7 * 24 * 3600 * 1_000_000


def held_states(spark, folder, name):
    rows = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", name).load()
    return {r.key[0] for r in rows.select("key").collect()}


def fed(spark, tmp_path, name, schema, batches, make, mode="append"):
    """What a stream has written after each batch, one run per batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name / "in"))
        yield streams.run_available(make(stream), mode, str(tmp_path / name / "run"))


def test_expired_values_leave_output_and_state(spark, tmp_path):
    def at(hours):
        return T0 + timedelta(hours=hours)

    batches = [
        [("a", at(0), 1, "a1"), ("b", at(1), 2, "b1")],
        [("a", at(20), 3, "a2"), ("b", at(0.5), 4, "late: dropped, the watermark is at 50 minutes")],
        [("c", at(26), 5, "c1")],  # ends b, which expired at hour 25
        [("b", at(30), 6, "b2")],  # b comes back
        [("d", at(51), 7, "d1")],  # ends a and c; b lives until hour 54
    ]
    want = [{"a": "a1", "b": "b1"}, {"a": "a2", "b": "b1"}, {"a": "a2", "c": "c1"}, {"a": "a2", "b": "b2", "c": "c1"}, {"b": "b2", "d": "d1"}]
    schema = "job_id string, ts timestamp, seq bigint, envelope string"
    for out, left in zip(fed(spark, tmp_path, "life", schema, batches, state.stream_latest_envelope, "update"), want, strict=True):
        assert {r.key: r.payload for r in state.current(out).collect()} == left
        assert held_states(spark, tmp_path / "life" / "run", "newest") == set(left)


def test_windows_and_maps_do_not_stay(spark, tmp_path):
    attempts = [[("k", T0 + timedelta(seconds=s), s) for s in (0, 1, 70)], [("k", T0 + timedelta(minutes=30), 9)], [("k", T0 + timedelta(seconds=2), 10)]]
    seen = []
    for out in fed(spark, tmp_path, "rate", "key string, ts timestamp, seq bigint", attempts, lambda s: state.stream_rate_limit(s, 1)):
        seen.append((sorted((r.seq, r.n, r.allowed) for r in out.collect()), len(held_states(spark, tmp_path / "rate" / "run", "count"))))
    assert [n for _, n in seen] == [1, 1, 1] and len(held_states(spark, tmp_path / "rate" / "run", "count")) == 1
    assert seen[-1][0] == [(0, 1, True), (1, 2, False), (9, 1, True), (70, 1, True)]  # the last attempt is late

    day = T0 + timedelta(days=1)
    entries = [[("r1", "put", T0, 0, "angel", day), ("r2", "put", T0, 1, "angel", day), ("r1", "get", T0, 2, "angel", None)],
               [("r3", "put", T0 + timedelta(days=2), 3, "angel", T0 + timedelta(days=3))], [("r2", "get", T0 + timedelta(days=2), 4, "angel", None)]]
    held = []
    for out in fed(spark, tmp_path, "maps", "ref string, kind string, ts timestamp, seq bigint, role string, expires_at timestamp", entries, state.stream_token_maps):
        held.append(held_states(spark, tmp_path / "maps" / "run", "map"))
    assert held == [{"r1", "r2"}, {"r3"}, {"r3"}]
    assert {r.seq: r.status for r in out.collect()} == {2: "ok", 4: "gone"}


def test_slots_share_state_and_answer_alike(spark, tmp_path):
    day, refs = timedelta(days=1), [f"r{i}" for i in range(40)] + [None]
    put = [(r, "put", T0, i, "angel", T0 + (day if i % 3 else timedelta(minutes=30))) for i, r in enumerate(refs)]
    get = [(r, "get", T0 + timedelta(hours=1), 100 + i, "angel" if i % 2 else "dios", None) for i, r in enumerate(refs)]
    # Maps of half an hour end with the first batch, the others with the third; the last one puts r1 again.
    entries = [get[::2] + put[::-1], get[1::2], [("z", "put", T0 + 2 * day, 200, "angel", T0 + 3 * day)],
               [("r1", "put", T0 + 2 * day, 201, "dios", T0 + 3 * day), ("r1", "get", T0 + 2 * day, 202, "dios", None)]]
    schema = "ref string, kind string, ts timestamp, seq bigint, role string, expires_at timestamp"
    held = []
    for out in fed(spark, tmp_path, "maps", schema, entries, lambda s: state.stream_token_maps(s, slots=3)):
        held.append(held_states(spark, tmp_path / "maps" / "run", "map"))
    want = {100 + i: "gone" if i % 3 == 0 else "ok" if i % 2 else "wrong_owner" for i in range(41)} | {202: "ok"}
    assert {r.seq: r.status for r in out.collect()} == want and out.count() == 42
    assert {r.ref for r in out.collect()} == {*refs[:-1], "None"} and [len(h) for h in held[:3]] == [3, 3, 1]

    attempts = [(f"k{i % 20}", T0 + timedelta(seconds=i), i) for i in range(240)]
    for out in fed(spark, tmp_path, "rate", "key string, ts timestamp, seq bigint", [attempts[:200][::-1], attempts[200:]],
                   lambda s: state.stream_rate_limit(s, 2, 3600, slots=3)):
        pass
    assert sorted((r.seq, r.key, r.n, r.allowed) for r in out.collect()) == [(i, f"k{i % 20}", i // 20 + 1, i < 40) for i in range(240)]
    assert held_states(spark, tmp_path / "rate" / "run", "count") == {"0", "1", "2"}


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "job_id", 8)

    def put(version, rows):
        batch = spark.createDataFrame(rows, "job_id long, v long")
        table.merge(version, batch, lambda stored, new: stored.join(new, "job_id", "left_anti").unionByName(new))
        return batch.schema

    def files():
        return {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("part-*.parquet")}

    schema = put(0, [(k, 0) for k in range(100)])
    first = files()
    put(1, [(7, 1)])
    second = files()
    assert first.items() <= second.items() and len(second) == len(first) + 1
    put(1, [(7, 1)])  # again: the same version
    assert len(files()) == len(second) and {r.job_id: r.v for r in table.read(schema).collect()} == {k: int(k == 7) for k in range(100)}
    put(2, [(7, 2), (1000, 2)])
    put(3, [(7, 3)])
    put(4, [])
    rows = {r.job_id: r.v for r in table.read(schema).collect()}
    assert rows == {**{k: 3 if k == 7 else 0 for k in range(100)}, 1000: 2}
    left = files()
    named = {f"t/data/version={holder}/bucket={bucket}" for version in (3, 4) for bucket, holder in table.holders(version).items()}
    assert {p.rsplit("/", 1)[0] for p in left} == named and len(named) <= 9
    untouched = {p for p in first if p in left}
    assert len(untouched) >= 6 and all(first[p] == left[p] for p in untouched)


def test_stream_masking_into_a_table(spark, tmp_path):
    rows = [("a", "ana@x.com", "ok", T0, 1), ("b", "plain", "ok", T0, 2), ("a", "again ana@x.com", "ok", T0 + timedelta(hours=1), 3)]
    docs = stream_of(spark, tmp_path, rows, "job_id string, content_md string, status string, ts timestamp, seq bigint", "jobs", 3)
    table = streams.stream_jobs_to_table(docs, str(tmp_path / "base"), ["ts", "seq"])
    got = {r.job_id: r.content_md for r in table.collect()}
    assert got == {"a": "again «EMAIL_1»", "b": "plain"}


def test_a_late_older_update_loses(spark, tmp_path):
    rows = [("a", "new", "ok", T0 + timedelta(hours=2), 3), ("a", "old", "ok", T0, 1), ("b", "only", "ok", T0, 2)]
    docs = stream_of(spark, tmp_path, rows, "job_id string, content_md string, status string, ts timestamp, seq bigint", "late", 3)
    table = streams.stream_jobs_to_table(docs, str(tmp_path / "base"), ["ts", "seq"])
    assert {r.job_id: r.content_md for r in table.collect()} == {"a": "new", "b": "only"}


def test_stream_metrics(spark, tmp_path):
    rows = [("a", T0 + timedelta(seconds=i * 20)) for i in range(30)]
    log = stream_of(spark, tmp_path, rows, "status string, ts timestamp", "m", 1)
    out = streams.run_available(streams.stream_metrics(log, "status"), "update")
    assert out.agg(F.max("n")).first()[0] == 15


def test_data_tree_keeps_one_body_of_a_page(spark, monkeypatch):
    kept, cut = [], jobs.cut_lineage
    monkeypatch.setattr(jobs, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    corpus = spark.createDataFrame(PAGES[:2], "url string, html string")
    texts = ["x" * 500, json.dumps({"r": [{"title": "T"}]}), json.dumps({"r": [{"title": "U"}]}), json.dumps([1, 2])]
    rows = [("http://h.org/a", n, f"http://h.org/api/{n}", 200, "application/json", text) for n, text in enumerate(texts)]
    schema = "page_url string, seq int, url string, status int, content_type string, body string"
    captured = endpoints.read_endpoints(spark.createDataFrame([*rows, ("http://h.org/", 0, "http://h.org/api", 200, "application/json", "no")], schema))
    seeds = spark.createDataFrame([("j", "http://h.org/")], "job_id string, url string")
    nodes, recs = jobs.data_tree(corpus, captured, seeds)
    assert {r.url: (r.endpoints_count, r.records_count) for r in nodes.collect()} == {"http://h.org/": (1, 0), "http://h.org/a": (4, 1)}
    assert [r.title for r in recs.collect()] == ["T"]  # of two as large, the one captured first ranks first
    folder = spark._jvm.java.io.File
    stored = [t for t in kept if folder(t._stored_at).exists() and "body" in t.columns]
    assert [sorted(r.body for r in t.collect() if r.body is not None) for t in stored] == [[texts[1]]]
