import random
from datetime import datetime, timedelta
from urllib.robotparser import RobotFileParser

import numpy as np
from pyspark.sql import functions as F

from webcorpus.operators import crawl, fetchlog, robots, vectors
from webcorpus.sources import feeds

T0 = datetime(2024, 1, 1)


# Who links to whom. "copy" holds what "b" holds; "gone" is not stored.
SITE = {"": ["a", "b", "gone"], "a": ["c", "", "copy"], "b": ["c", "docs/d"], "c": ["e"], "copy": ["f"], "docs/d": ["docs/g", "e"], "e": [], "f": [], "docs/g": ["h"], "h": []}
JOBS = [
    # job, start, most pages, depth, scope -> (url, depth, parent) in order
    ("all", "", 50, 9, None, [("", 0, None), ("a", 1, ""), ("b", 1, ""), ("c", 2, "a"), ("docs/d", 2, "b"), ("e", 3, "c"), ("docs/g", 3, "docs/d"), ("h", 4, "docs/g")]),
    ("flat", "", 50, 0, None, [("", 0, None)]),
    ("capped", "", 4, 9, None, [("", 0, None), ("a", 1, ""), ("b", 1, ""), ("c", 2, "a")]),
    ("scoped", "b", 50, 9, "/docs", [("b", 0, None), ("docs/d", 1, "b"), ("docs/g", 2, "docs/d")]),
    ("copy first", "copy", 50, 1, None, [("copy", 0, None), ("c", 1, "copy"), ("docs/d", 1, "copy")]),
    ("missing", "gone", 5, 2, None, []),
]


def test_crawl(spark):
    def page(name):
        return "".join(f'<a href="http://s.org/{u}">x</a>' for u in SITE["b" if name == "copy" else name])

    corpus = spark.createDataFrame([(f"http://s.org/{u}", page(u) or f"<p>{u}") for u in SITE], "url string, html string")
    seeds = spark.createDataFrame([(j, f"http://s.org/{u}", n, d, s) for j, u, n, d, s, _ in JOBS], "job_id string, url string, max_pages int, max_depth int, scope_path string")
    rows = crawl.crawl(corpus, seeds, drop_chrome=False).orderBy("job_id", "ord").collect()
    for job, *_, want in JOBS:
        got = [(r.url, r.depth, r.parent) for r in rows if r.job_id == job]
        assert got == [(f"http://s.org/{u}", d, p if p is None else f"http://s.org/{p}") for u, d, p in want], job


def test_crawl_of_many_pages_keeps_its_promises(spark):
    rng = random.Random(2)
    links = {k: sorted({rng.randrange(80) for _ in range(rng.randint(0, 4))}) for k in range(80)}
    corpus = spark.createDataFrame([(f"http://s.org/{k}", f"<p>{k}</p>" + "".join(f'<a href="/{u}">x</a>' for u in to)) for k, to in links.items()], "url string, html string")
    seeds = spark.createDataFrame([("j", "http://s.org/0", 200, 4)], "job_id string, url string, max_pages int, max_depth int")
    rows = crawl.crawl(corpus, seeds, drop_chrome=False).orderBy("ord").collect()
    far = {0: 0}  # steps from the start, relaxed until nothing changes
    for _ in range(80):
        for k, to in links.items():
            for u in to:
                far[u] = min(far.get(u, 99), far.get(k, 99) + 1)
    assert {int(r.url.rsplit("/")[-1]): r.depth for r in rows} == {k: d for k, d in far.items() if d <= 4}
    place = {r.url: r for r in rows}
    for r in rows[1:]:
        parent = place[r.parent]
        assert parent.ord < r.ord and parent.depth == r.depth - 1 and int(r.url.rsplit("/")[-1]) in links[int(r.parent.rsplit("/")[-1])]


ROBOTS = ["User-agent: *\nDisallow: /private\nAllow: /private/ok\n", "User-agent: webcorpus\nAllow: /a/b\nDisallow: /a\n\nUser-agent: *\nDisallow: /",
          "User-agent: other\nDisallow: /\n", "# none\n", "User-agent: WEBCORP\nUser-agent: x\nDisallow:\n\nUser-agent: *\nDisallow: /",
          "User-agent: *\nDisallow: /caf%C3%A9 # c\nCrawl-delay: 3\n"]


def test_robots_agree_with_the_standard_library(spark):
    files = [(f"http://h{i}", body) for i, body in enumerate(ROBOTS)] + [("http://h9", "")]
    paths = ["", "/", "/private", "/private/ok", "/a", "/a/b/c", "/b?x=1", "/café", "/caf%C3%A9/x"]
    urls = [(o + p,) for o, _ in files for p in paths] + [("http://nofile/x",)]
    rules = robots.robots_rules(spark.createDataFrame(files, "origin string, body string"))
    got = {r.url: r.robots_ok for r in robots.robots_allowed(spark.createDataFrame(urls, "url string"), rules, "webcorpus/1.0").collect()}
    for origin, body in files:
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        for path in paths:
            want = parser.can_fetch("webcorpus/1.0", origin + path) if body else True
            assert got[origin + path] == want, (body, path)
    assert got["http://nofile/x"]


def test_crawl_respects_robots(spark):
    corpus = spark.createDataFrame([("http://h/", '<a href="/no">n</a><a href="/yes">y</a>'), ("http://h/no", "n"), ("http://h/yes", "y")], "url string, html string")
    rules = robots.robots_rules(spark.createDataFrame([("http://h", "User-agent: *\nDisallow: /no")], "origin string, body string"))
    seeds = spark.createDataFrame([(1, "http://h/")], "job_id int, url string")
    assert [r.url for r in crawl.crawl(corpus, seeds, robots=rules).orderBy("ord").collect()] == ["http://h/", "http://h/yes"]


def test_feeds(spark):
    xml = [(1, '<urlset xmlns="http://s"><url><loc> https://a/1 </loc></url><url><loc>ftp://x</loc></url></urlset>'),
           (2, "<urlset><loc>http://b</loc></urlset>"), (3, "<broken"), (4, None),
           (5, '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="https://c/1"/></entry></feed>'),
           (6, "<rss><channel><item><link>http://d/1</link></item></channel></rss>")]
    df = spark.createDataFrame(xml, "i int, xml string")
    assert sorted((r.i, r.link) for r in feeds.sitemap_urls(df).collect()) == [(1, "https://a/1"), (2, "http://b")]
    assert sorted((r.i, r.link) for r in feeds.feed_urls(df).collect()) == [(5, "https://c/1"), (6, "http://d/1")]


def test_tree_bundle_and_summary(spark):
    rows = [("j", 1, "u0", 0, None), ("j", 2, "u1", 1, "u0"), ("j", 3, "u2", 1, "u0"), ("j", 4, "u3", 2, "u1")]
    crawled = spark.createDataFrame(rows, "job_id string, ord int, url string, depth int, parent string")
    bodies = spark.createDataFrame([("u0", "x\n# Root"), ("u1", "é"), ("u2", "t"), ("u3", "t")], "url string, text string")
    tree = {r.url: r for r in crawl.page_tree(crawled, bodies).collect()}
    assert len(tree) == 4 and tree["u0"].children == 2 and tree["u0"].title == "Root" and tree["u1"].bytes == 2
    assert tree["u3"].path == ["u0", "u1", "u3"]
    pages = crawled.join(bodies, "url").withColumnRenamed("text", "content_md")
    text = crawl.bundle(pages).first().content_md
    assert text == "## u0\n\nx\n# Root\n\n---\n\n## u1\n\né\n\n---\n\n## u2\n\nt\n\n---\n\n## u3\n\nt\n"


def test_dedup_and_frontier(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "page_id int, text string")
    assert sorted(r.page_id for r in crawl.dedup_content(df, "page_id").collect()) == [1, 2]
    pushes = spark.createDataFrame([("c", 1, "u", 0), ("c", 2, "v", 1), ("c", 3, "u", 2), ("d", 4, "u", 0)], "crawl_id string, seq int, url string, depth int")
    queued = crawl.frontier_dedup(pushes)
    assert sorted((r.crawl_id, r.url, r.seq, r.depth) for r in queued.collect()) == [("c", "u", 1, 0), ("c", "v", 2, 1), ("d", "u", 4, 0)]
    assert crawl.frontier_dedup(pushes, queued.filter("crawl_id = 'c'")).count() == 1
    counts = {r.crawl_id: (r.visited, r.pending) for r in crawl.frontier_counts(queued, queued.filter("seq = 1")).collect()}
    assert counts == {"c": (2, 1), "d": (1, 1)}


def attempts(spark):
    rows = [("f1", "d", 0, "p", "blocked", "status:403", T0, 1), ("f1", "d", 1, "p", "captcha", "cloudflare", T0 + timedelta(seconds=1), 2),
            ("f1", "d", 2, "p", "ok", None, T0 + timedelta(seconds=2), 3), ("f2", "d", 2, "q", "error", "x", T0 + timedelta(days=1), 4),
            ("f3", "e", 0, "q", "ok", None, T0 - timedelta(days=8), 5)] + [
        ("f4", "d", 0, "p", "blocked", "s", T0 + timedelta(minutes=i), 10 + i) for i in range(1, 8)]
    return spark.createDataFrame(rows, "fetch_id string, domain string, tier int, proxy string, outcome string, signal string, ts timestamp, seq int")


def test_fetch_log(spark):
    log = attempts(spark)
    paths = {r.fetch_id: r.escalation for r in fetchlog.escalation_path(log).collect()}
    assert paths["f1"] == ["t0:status:403", "t1:cloudflare"] and paths["f2"] == ["t2:error"] and paths["f3"] == []
    assert [(r.domain, r.tier) for r in fetchlog.winning_tier(log, T0).collect()] == [("d", 2)]
    health = {r.proxy: r for r in fetchlog.proxy_health(log, T0 + timedelta(minutes=30)).collect()}
    assert health["p"].fails == 7 and health["p"].cooldown_until == T0 + timedelta(minutes=7, seconds=1500) and not health["p"].healthy
    assert health["q"].fails == 1
    req = spark.createDataFrame([("d", 0), ("z", 1), ("d", 3)], "domain string, tier_hint int")
    assert sorted(r.start_tier for r in fetchlog.cached_tier(log, req, T0, 2).collect()) == [1, 2, 2]


def test_rate_limit_agrees_with_counting(spark):
    rng = random.Random(9)
    rows = [(rng.choice("hot hot hot cold".split()), T0 + timedelta(milliseconds=rng.randint(0, 150_000)), i) for i in range(800)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq int")
    counts, want = {}, {}
    for key, ts, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        bucket = (key, int(ts.timestamp() // 60))
        counts[bucket] = counts.get(bucket, 0) + 1
        want[seq] = counts[bucket]
    got = {r.seq: (r.n, r.allowed) for r in fetchlog.rate_limit(df, 25).collect()}
    assert got == {seq: (n, n <= 25) for seq, n in want.items()}
    assert fetchlog.rate_limit(df, 0).filter("not allowed").count() == 0


def test_rates_and_histogram(spark):
    df = spark.createDataFrame([("a", T0 + timedelta(seconds=30)), ("a", T0 + timedelta(minutes=3)), ("b", T0)], "status string, ts timestamp")
    rates = {(r.status, r.window_end): r.rate for r in fetchlog.five_minute_rate(df, "status").collect()}
    assert rates[("a", T0 + timedelta(minutes=4))] == 2 / 300 and rates[("a", T0 + timedelta(minutes=6))] == 1 / 300 and len(rates) == 13
    hist = fetchlog.duration_histogram(spark.createDataFrame([(0.004,), (0.3,), (99.0,)], "seconds double"))
    got = {r.le: r.observations for r in hist.collect()}
    assert got["0.005"] == 1 and got["0.25"] == 1 and got["0.5"] == 2 and got["10.0"] == 2 and got["+Inf"] == 3


def test_top_k_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(900 + i, [1.0] * 8) for i in range(40)]
    data += [(1000, [0.0] * 8), (1001, [1.0]), (1002, None), (1003, [float("nan")] * 8), (1004, [])]
    data += [(2000 + i, [float(x) for x in data[0][1]]) for i in range(200)] + [(3000 + i, [float(x) for x in rng.normal(size=8)]) for i in range(3000)]
    vecs = spark.createDataFrame(data, "vec_id int, embedding array<double>").repartition(5)
    queries = [(f"q{i}", [float(x) for x in rng.normal(size=8)]) for i in range(7)] + [("first", data[0][1]), ("wide", [1.0] * 9), ("empty", []), ("ones", [1.0] * 8), ("none", None), ("zero", [0.0] * 8)]
    qdf = spark.createDataFrame(queries, "query_id string, vector array<double>")

    def cos(a, b):
        if not a or len(a) != len(b):
            return 0.0
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n > 0 else 0.0

    for size in (10**6, 24):
        got = {}
        for r in vectors.top_k(qdf, vecs, k=4, max_values=size, vector_values=50 * size).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for name, q in queries:
            if q is not None:
                want = sorted(((-round(cos(q, v), 12) + 0.0, i) for i, v in data if v is not None))[:4]
                assert got[name] == [i for _, i in want], name
        assert "none" not in got


def test_top_k_passes_no_vectors_through_the_driver(spark, monkeypatch):
    vecs = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    queries = vecs.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    sent = []
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value))
    collect = type(vecs).collect

    def few(self):
        rows = collect(self)
        if any(isinstance(value, list) for row in rows for value in row):
            sent.append(rows)
        return rows

    monkeypatch.setattr(type(vecs), "collect", few)
    # 30 blocks of queries, 4 of vectors
    found = vectors.top_k(queries, vecs, k=2, max_values=200, vector_values=1500)
    monkeypatch.undo()
    assert sent == []
    rows = found.collect()
    assert len(rows) == 6000 and {r.query_id for r in rows if r.rank == 1} == set(range(3000))
    # far out, neighbours look the same at twelve decimals: then the smaller id is first
    assert all(r.id == r.query_id for r in rows if r.rank == 1 and r.query_id < 100)


def test_top_k_scores_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MAX_SCORES", 100)
    test_top_k_agrees_with_numpy(spark)


def test_embed(spark):
    df = spark.createDataFrame([(1, "x" * 9000), (2, "  ")], "doc_id int, text string")
    def size(texts):
        return [[float(len(t))] for t in texts]

    assert [(r.doc_id, r.embedding) for r in vectors.embed(df, size).collect()] == [(1, [9000.0])]
    assert [(r.doc_id, r.embedding) for r in vectors.embed(df, size, limit=8000).collect()] == [(1, [8000.0])]


def test_links_are_read_of_followed_pages_only(spark):
    pages = spark.createDataFrame(
        [("http://h.org/", "<a href='/a'>x</a><a href='http://h.org/a#f'>x</a><a href='//o.org/'>x</a>"), ("http://h.org/a", "<a href='/b'>x</a>"),
         ("http://h.org/a", "<a href='/c'>x</a>"), ("http://h.org/b", "b")], "url string, html string")
    seeds = spark.createDataFrame([(1, "http://h.org/"), (2, "http://h.org/"), (3, None)], "job_id int, url string")
    got = {r.url: r.links for r in crawl.page_index(pages, followed=seeds).collect()}
    assert got == {"http://h.org/": ["http://h.org/a"], "http://h.org/a": None, "http://h.org/b": None}
    shallow = {(r.job_id, r.ord, r.url, r.parent) for r in crawl.crawl(pages, seeds, 9, 1).collect()}
    deep = {(r.job_id, r.ord, r.url, r.parent) for r in crawl.crawl(pages, seeds, 9, 2).collect() if r.depth < 2}
    assert shallow == deep == {(j, *row) for j in (1, 2) for row in ((1, "http://h.org/", None), (2, "http://h.org/a", "http://h.org/"))}


def test_pages_of_one_host_are_not_read_by_one_task(spark):
    pages = spark.createDataFrame([(f"http://h.org/{k}", f"<a href='/{k + 1}'>x</a>") for k in range(50)], "url string, html string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = crawl.page_index(pages, hosts=spark.createDataFrame([("h.org",)], "host string"))
        assert index.count() == 50
        assert "hashpartitioning(host" not in index._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_crawl_leaves_no_index_behind(spark, monkeypatch):
    made = {"bucketed": [], "cut_lineage": []}
    for name, tables in made.items():
        monkeypatch.setattr(crawl, name, lambda *a, f=getattr(crawl, name), t=tables: t.append(f(*a)) or t[-1])
    rows = [(f"http://h.org/{k}", f"<a href='/{2 * k}'>x</a><a href='/{2 * k + 1}'>x</a>") for k in range(1, 40)]
    pages = spark.createDataFrame(rows, "url string, html string")
    seeds = spark.createDataFrame([(1, "http://h.org/1"), (2, "http://h.org/3")], "job_id int, url string")
    got = {(r.job_id, r.ord, r.url[13:], r.depth, r.parent and r.parent[13:]) for r in crawl.crawl(pages, seeds, 9, 3).collect()}
    assert got == {(1, k, str(k), k.bit_length() - 1, str(k // 2) if k > 1 else None) for k in range(1, 10)} | {
        (2, n + 1, str(k), d, str(k // 2) if d else None)
        for n, (k, d) in enumerate([(3, 0), (6, 1), (7, 1), (12, 2), (13, 2), (14, 2), (15, 2), (24, 3), (25, 3)])}
    (index,) = made["bucketed"]
    assert not index.sparkSession._jvm.java.io.File(index._stored_at).exists()
    assert not any("at" in t.columns and index.sparkSession._jvm.java.io.File(t._stored_at).exists() for t in made["cut_lineage"])


def test_levels_of_a_tree_do_not_move_all_pages(spark, monkeypatch):
    plans, keep = [], crawl.cut_lineage
    monkeypatch.setattr(crawl, "cut_lineage", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or keep(df))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("j", k, f"u{k}", 0, f"u{k // 2}" if k > 1 else None) for k in range(1, 9)] + [("j", 9, "u9", 0, "gone"), ("j", 10, "u10", 0, "u10")]
        crawled = spark.createDataFrame(rows, "job_id string, ord int, url string, depth int, parent string")
        bodies = spark.createDataFrame([(f"u{k}", f"a\n # T{k}\n# no" if k % 2 else "plain") for k in range(1, 11)], "url string, text string")
        tree = {r.url: r for r in crawl.page_tree(crawled, bodies).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert tree["u8"].path == ["u1", "u2", "u4", "u8"] and tree["u9"].path == ["u9"] and tree["u10"].parent is None
    assert (tree["u1"].children, tree["u4"].children, tree["u1"].title, tree["u2"].title) == (2, 1, "T1", None) and len(tree) == 10
    levels = [plan for columns, plan in plans if "path" in columns and "Join" in plan]
    assert levels and all(plan.count("Exchange") == 1 for plan in levels)
