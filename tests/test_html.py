import random

from pyspark.sql import functions as F

from webcorpus.operators import assets, elements, heal, links, markdown, selectors

PAGE = """<html><head><title>T</title><style>a{}</style><script>var x='<a href="/in-script">';</script></head><body>
<!-- <a href="/in-comment">c</a> --><nav><a href='/login'>in</a><a href=/news/a?x=1&amp;y=2>A</a></nav>
<a class="k" href="https://other.org/z#frag">ext</a><a href="#top">t</a><a href="mailto:a@b.c">m</a>
<A HREF="  /news/b#f ">B</A><a name="none">n</a><a href="/news/a?x=1&y=2">again</a><a href="rel/../c">rel</a>
<a title="href=/fake" href="javascript:void(0)">js</a><a href="">e</a></body></html>"""


def test_links_of_a_tricky_page(spark):
    df = spark.createDataFrame([(1, "https://site.org/news/index.html", PAGE)], "page_id int, url string, html string")
    got = [r.link for r in links.extract_links(df, same_domain=False).orderBy("pos").collect()]
    assert got == ["https://site.org/login", "https://site.org/news/a?x=1&y=2", "https://other.org/z", "https://site.org/news/b", "https://site.org/news/c"]
    local = [r.link for r in links.extract_links(df, drop_chrome=True, scope="/news").orderBy("pos").collect()]
    assert local == ["https://site.org/news/a?x=1&y=2", "https://site.org/news/b", "https://site.org/news/c"]


FORM = """<form method=post action="list.aspx?a=1&amp;b=2"><input type="hidden" name="__VIEWSTATE" value="v1">
<input type='hidden' name='k' value='old'><input type="hidden" name="k" value="new"><input name="q" type="text">
<a href="javascript:__doPostBack(&#39;grid&#39;,&#39;Page$2&#39;)">2</a>
<a href="javascript:__doPostBack('grid','Page$2')">2</a><a href="javascript:__doPostBack('grid','Page$Next')">&gt;</a></form>"""


def test_postback_forms(spark):
    df = spark.createDataFrame([("http://h.org/x/list.aspx", FORM)], "url string, html string")
    row = df.select(
        links.is_postback("html").alias("p"), links.form_state("html").alias("s"),
        links.postback_pagers("html").alias("g"),
        links.build_postback(links.form_state("html"), links.next_pager(links.postback_pagers("html"), 1), "url").alias("b"),
        links.next_pager(links.postback_pagers("html"), 5)["arg"].alias("n"),
    ).first()
    assert row.p and row.s.action == "list.aspx?a=1&b=2" and row.s.fields == {"__VIEWSTATE": "v1", "k": "new"}
    assert [tuple(g) for g in row.g] == [("grid", "Page$2"), ("grid", "Page$Next")] and row.n == "Page$Next"
    assert row.b.url == "http://h.org/x/list.aspx?a=1&b=2"
    assert row.b.data == {"__VIEWSTATE": "v1", "k": "new", "__EVENTTARGET": "grid", "__EVENTARGUMENT": "Page$2"}


def test_next_link_and_anchor_labels(spark):
    rows = [
        ("http://h/1", '<link rel="next" href="/r?p=2&amp;q=1"><a href="/x">next</a>', "http://h/r?p=2&q=1"),
        ("http://h/1", '<a class=k href=/u rel="nofollow NEXT">x</a>', "http://h/u"),
        ("http://h/1", '<a href="/a">prev</a><a href="/b"><b>Próxima</b> página</a>', "http://h/b"),
        ("http://h/1", '<a href="javascript:go()">next</a><a href="/c"> › </a>', "http://h/c"),
        ("http://h/l?page=4", "<a href='/nextdoor'>nextdoor</a>", "http://h/l?page=5"),
        ("http://h/1", "nothing", None),
    ]
    df = spark.createDataFrame(rows, "url string, html string, want string")
    for r in links.find_next_link(df).collect():
        assert r.next_url == r.want
    got = [(r.href, r.label) for r in links.anchors(df).collect()]
    assert ("/b", "Próxima página") in got


def test_paginate_stops_where_it_should(spark):
    def page(n, extra=""):
        return f"<p>page {n}</p>{extra}"

    pages = [
        ("http://h/l?page=1", page(1)), ("http://h/l?page=2", page(2)), ("http://h/l?page=3", page(3)),
        ("http://loop/a", page("a", '<a rel="next" href="/b">n</a>')), ("http://loop/b", page("b", '<a rel="next" href="/a">n</a>')),
        ("http://self/s", page("s", '<a rel="next" href="/s">n</a>')),
        ("http://same/l?page=1", page("q")), ("http://same/l?page=2", page("q")),
    ]
    corpus = spark.createDataFrame(pages, "url string, html string")
    seeds = spark.createDataFrame([("n", pages[0][0]), ("loop", "http://loop/a"), ("self", "http://self/s"),
                                   ("same", pages[6][0]), ("gone", "http://none/")], "seed string, url string")
    got = {}
    for r in links.paginate(corpus, seeds).orderBy("step").collect():
        got.setdefault(r.seed, []).append(r.url)
    assert got == {"n": [p[0] for p in pages[:3]], "loop": ["http://loop/a", "http://loop/b"],
                   "self": ["http://self/s"], "same": [pages[6][0]]}
    short = links.paginate(corpus, seeds, max_pages=2).filter("seed = 'n'").count()
    thrifty = links.paginate(corpus, seeds, max_bytes=1).filter("seed = 'n'").count()
    assert (short, thrifty) == (2, 1)


def test_paginate_follows_form_posts(spark):
    state = '<input type="hidden" name="__VIEWSTATE" value="{}">'
    first = state.format(1) + "<form action='l.aspx'></form><a href=\"javascript:__doPostBack('g','Page$2')\">2</a>"
    second = state.format(2) + "<p>two</p>"
    rows = [("http://h/l.aspx", first, None, None), ("http://h/l.aspx", second, "g", "Page$2")]
    corpus = spark.createDataFrame(rows, "url string, html string, post_target string, post_arg string")
    seeds = spark.createDataFrame([("s", "http://h/l.aspx")], "seed string, url string")
    assert [(r.step, r.url) for r in links.paginate(corpus, seeds).orderBy("step").collect()] == [
        (1, "http://h/l.aspx"), (2, "http://h/l.aspx")]


def test_swept_links(spark):
    pages = [("http://h/1", '<a href="/a">a</a><a href="http://o/b">b</a>'), ("http://h/2", '<a href="/c">c</a><a href="/a">a</a>')]
    corpus = spark.createDataFrame(pages, "url string, html string")
    swept = spark.createDataFrame([("s", 1, "http://h/1"), ("s", 2, "http://h/2")], "seed string, step int, url string")
    rows = links.swept_hyperlinks(swept, corpus, keep=2).orderBy("rank").collect()
    assert [(r.link, r.hyperlinks_total, r.pages_swept) for r in rows] == [("http://h/a", 3, 2), ("http://o/b", 3, 2)]


ASSETS = """<body><a href="/f/a.pdf">Doc A</a><a href="/f/a.pdf#p2">again</a><a href="get?id=1" download="r.bin">d</a>
<a href="x.zip"></a><a href="javascript:x()">j</a><video src="v.mp4" poster="p.jpg"><source src="w.webm"></video>
<audio><source src="s.mp3"></audio><img src="i.png"><img src="i.png"><object data="o"></object>
<iframe src="https://docs.google.com/viewer?url=https%3A%2F%2Fz.org%2Fq.docx"></iframe>
<iframe src="https://www.youtube.com/embed/xyz"></iframe><embed src="e.pdf"><iframe src="/plain"></iframe></body>"""


def test_assets(spark):
    df = spark.createDataFrame([(1, "http://h.org/d/", ASSETS)], "page_id int, url string, html string")
    rows = assets.harvest_assets(df).orderBy("kind", "pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r.kind, []).append((r.url, r.name, r.ext, r.via, r.provider, r.dl_video))
    assert [g[:2] for g in got["document"]] == [
        ("http://h.org/f/a.pdf", "Doc A"), ("http://h.org/d/get?id=1", "r.bin"), ("http://h.org/d/o", "o"),
        ("https://z.org/q.docx", "q.docx"), ("http://h.org/d/e.pdf", "e.pdf")]
    assert got["document"][3][3] == "visor desincrustado"
    assert [g[0] for g in got["video"]] == ["http://h.org/d/v.mp4", "http://h.org/d/w.webm"]
    assert [g[0] for g in got["image"]] == ["http://h.org/d/p.jpg", "http://h.org/d/i.png"]
    assert [g[0] for g in got["audio"]] == ["http://h.org/d/s.mp3"] and [g[1] for g in got["archive"]] == ["x.zip"]
    assert got["embed"] == [("https://www.youtube.com/embed/xyz", "Video de YouTube", None, None, "youtube", True)]
    assert assets.harvest_assets(df, caps={**assets.fixed.ASSET_CAPS, "document": 2}).filter("kind='document'").count() == 2


def test_merged_assets(spark):
    df = spark.createDataFrame([("j", 1, "http://h.org/d/", ASSETS), ("j", 2, "http://h.org/e/", ASSETS)],
                               "job_id string, page_order int, url string, html string")
    manifests = assets.harvest_assets(df)
    seeds = spark.createDataFrame([("j", "https://www.instagram.com/p/1"), ("k", "https://vimeo.com/1"), ("l", "http://h/")],
                                  "job_id string, url string")
    rows = assets.merge_assets(manifests, seeds).collect()
    embeds = sorted([(r.job_id, r.pos, r.provider, r.dl_gallery) for r in rows if r.kind == "embed"])
    assert embeds == [("j", -1, "instagram", True), ("j", 0, "instagram", False), ("j", 1, "youtube", False),
                      ("k", 0, "vimeo", False)]
    urls = [r.url for r in rows if r.job_id == "j" and r.kind == "document"]
    assert len(urls) == len(set(urls)) == 8


def test_main_markdown(spark):
    page = ("<title>no</title><nav><ul><li><a href=x>Home</a></ul></nav><article><h2>Head &amp; more</h2><p>First <b>para</b>"
            "<p>Second <a href=y>link</a> text here<ul><li>one<li>two</ul></article><p><a href=z>only link</a></p><footer>f</footer>")
    df = spark.createDataFrame([(1, page), (2, "<nav>just <a href=1>nav</a></nav>")], "page_id int, html string")
    got = {r.page_id: r.content_md for r in markdown.main_markdown(df).collect()}
    assert got == {1: "## Head & more\n\nFirst para\n\nSecond link text here\n\n- one\n\n- two", 2: "just nav"}


def test_routes_and_choice(spark):
    rows = [(1, "http://h/a.pdf", "application/pdf", "", b"PDF"), (2, "http://h/b", "text/html", "<p>hi</p>", b""),
            (3, "http://h/c", "text/plain", " raw ", b"")]
    df = spark.createDataFrame(rows, "page_id int, url string, content_type string, text string, content binary")
    got = {r.page_id: (r.route, r.content_md) for r in markdown.to_markdown(
        df, lambda blobs, names: [n + ":" + b.decode() for b, n in zip(blobs, names)]).collect()}
    assert got == {1: ("document", "a.pdf:PDF"), 2: ("html", "hi"), 3: ("plain", "raw")}
    cands = [(1, "x", 0, "[a](b) " * 20), (1, "y", 1, "word " * 20), (2, "x", 0, "same"), (2, "y", 1, "same"), (3, "x", 0, " ")]
    best = markdown.pick_best(spark.createDataFrame(cands, "page_id int, engine string, engine_rank int, md string"))
    assert {r.page_id: r.engine for r in best.collect()} == {1: "y", 2: "x"}


def test_healing(spark):
    first = '<div><span id="p" class="price big">$ 100</span><i>x</i></div>'
    later = '<section><b id="p" class="cost">$ 100</b><span class="price">other</span></section>'
    empty = "<section><b>z</b></section>"
    fields = spark.createDataFrame([("d", "price", "div span.price")], "profile string, field string, selector string")
    none = spark.createDataFrame([], f"profile string, field string, fp {heal.FINGERPRINT}")

    def run(html, prints):
        page = spark.createDataFrame([(1, "d", html)], "page_id int, profile string, html string")
        return heal.heal_fields(page, fields, prints)

    one = run(first, none)
    row = one.first()
    assert (row.value, row.healed, row.score, row.selector) == ("$ 100", False, 1.0, "div span.price")
    saved = one.select("profile", "field", "fp")
    two = run(later, saved).first()
    assert (two.value, two.healed, two.selector) == ("$ 100", True, "#p") and round(two.score, 6) == 0.5
    three = run(empty, saved).first()
    assert three.value is None and not three.healed and three.fp is None
    four = run(later, none).first()
    assert four.value is None and four.score == 0.0


def test_selectors(spark):
    html = '<div id="d"><p class="a b">one</p><section><p class="a" data-k="v">two</p></section></div><h1>three</h1><a href="/x">four</a>'
    cases = {
        "p": "one", "div > p.b": "one", "section>p": "two", "div p.a.b": "one", "#d section .a": "two", "div > section > p": "two",
        "h1, a": "three", "[href]": "four", "p[data-k=v]": "two", "p[data-k='v']": "two", "p[data-k=w]": None, "*#d > *.a": "one",
        "body > p": None, "h1 > p, h1": "three", "p:first-child": "one", "xpath://a": "four", "p + p": None, "": None, "> p": None, "p[": None,
        "p + section p": "two", "p ~ section": "two", "h1 + a": "four", "div ~ a": "four", "section:last-child > p": "two", "p:not(.b)": "two",
        "a:nth-of-type(1)": "four", "div > :nth-child(2)": "two", ":nth-child(odd of x)": None, "p:nth-last-child(2)": "one", "h1:hover": None,
        "p[class~=b]": "one", "[href^='/']": "four", "[href$=x]": "four", "[data-k*=v]": "two", "div:nth-child(2n+1)": "onetwo", "p:not(:first-child)": None,
        "xpath:/div/p": "one", "xpath:/p": None, "xpath://div//p[@data-k='v']": "two", "xpath://*[2]/p": "two", "xpath://a[contains(@href,'x')]": "four",
        "xpath://p[last()]": "one", "xpath://p[@class][1]": None, "xpath:/div/section/p[1]": "two", "xpath:count(//p)": None, "p,": "one", "p >": None,
    }
    page = spark.createDataFrame([(1, "d", html)], "page_id int, profile string, html string")
    fields = spark.createDataFrame([("d", s, s) for s in cases], "profile string, field string, selector string")
    none = spark.createDataFrame([], f"profile string, field string, fp {heal.FINGERPRINT}")
    assert {r.field: r.value for r in heal.heal_fields(page, fields, none).collect()} == cases


def test_selectors_in_one_pass_agree_with_looking_up():
    rng = random.Random(3)
    tags, combinators = ["a", "b", "i"], [" ", " > ", " + ", " ~ "]

    def page(depth):
        return "".join(f"<{t} class={rng.choice('xyz')}>{page(depth - 1) if depth else ''}</{t}>" for t in rng.choices(tags, k=rng.randint(1, 3)))

    def holds(p, parts):
        tag, cls, nth, hangs = parts[-1]
        if p is None or p.element.tag != tag or cls and cls not in p.element.classes or nth and p.place != nth:
            return False
        if len(parts) == 1:
            return True
        if hangs in (" > ", " + "):
            return holds(p.parent if hangs == " > " else p.before, parts[:-1])
        while p := p.parent if hangs == " " else p.before:
            if holds(p, parts[:-1]):
                return True
        return False

    met = 0
    for _ in range(300):
        placed = selectors.place(elements.Tree(None, runs=False).read(page(3)).rows)
        for _ in range(10):
            parts = [(rng.choice(tags), rng.choice(["x", "y", ""]), rng.choice([0, 0, 1, 2]), rng.choice(combinators)) for _ in range(rng.randint(1, 4))]
            text = "".join((hangs if k else "") + tag + (f".{cls}" if cls else "") + (f":nth-child({nth})" if nth else "") for k, (tag, cls, nth, hangs) in enumerate(parts))
            want = next((p.element for p in placed if holds(p, parts)), None)
            assert selectors.first_match(text, placed) is want, text
            met += want is not None
    assert met > 300


def test_healing_reads_heads_and_one_whole_text():
    html = "<div> " + "<section>" * 50 + "x" * 300 + "  " * 200 + "</section>" * 50 + "<p> \n</p><b>ab </b></div>"
    page = heal._Page(html)
    for element in page.elements:
        assert page.head(element) == page.text[element.start:element.end].strip()[:120]
    assert page.whole(page.elements[1]) == "x" * 300


def test_generators_make_what_is_asked(spark):
    df = spark.createDataFrame([(7, "<div id=a><p class=x>one<p>two<a href=/x>l</a></div>")], "page_id int, html string")
    few = elements.html_elements(df, columns=("el", "tag"), tags=("p", "a"))
    assert few.columns == ["page_id", "el", "tag"] and [tuple(r) for r in few.collect()] == [(7, 1, "p"), (7, 3, "p"), (7, 5, "a")]
    assert elements.html_elements(df, columns=("lineage",), tags=("a",)).first().lineage[0].el_id == "a"
    plan = assets.harvest_assets(df.selectExpr("page_id", "'http://h/' url", "html"))._jdf.queryExecution().toString()
    assert "lineage" not in plan and "boilerplate" not in plan and "block_tag" not in plan
    assert "Exchange" not in markdown.main_markdown(df)._jdf.queryExecution().toString()


def test_element_table_shape(spark):
    df = spark.createDataFrame([(7, "<div id=a class='x y'><p>one<p>two<br></div>tail")], "page_id int, html string")
    rows = elements.html_elements(df).orderBy("el").collect()
    assert [(r.tag, r.parent) for r in rows] == [("div", None), ("p", 0), ("#text", 1), ("p", 0), ("#text", 3), ("br", 3), ("#text", None)]
    assert rows[0].el_id == "a" and rows[0].classes == ["x", "y"] and rows[0].text == "onetwo" and rows[4].block == 3


def searches(df):
    """How often the regular expressions over tags and attributes stand in a plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")


def test_tags_are_searched_once(spark):
    pages = spark.createDataFrame([("http://h/a", '<a rel="next" href="/b?x=1&amp;y=2">n</a>')], "url string, html string")
    found = links.find_next_link(pages)
    assert searches(found) < 15 and found.first().next_url == "http://h/b?x=1&y=2"
    posts = pages.withColumn("pager", links.next_pager(links.postback_pagers("html"), 1)).withColumn("state", links.form_state("html"))
    b = posts.select(links.build_postback("state", "pager", "url").alias("b")).select("b.url", F.col("b.data")["k"], F.col("b.data")["l"])
    assert searches(b) < 15
    fields = "".join(f'<input type="hidden" name="f{i % 30}" value="{i}">' for i in range(60))
    form = spark.createDataFrame([(f'<form action="/x?a=1&amp;b=2">{fields}</form>',)], "html string").select(links.form_state("html").alias("s")).first().s
    assert form.action == "/x?a=1&b=2" and form.fields == {f"f{i}": str(i + 30) for i in range(30)}


def test_a_table_of_one_file_is_dealt_out(spark, tmp_path):
    from webcorpus.session import dealt

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.rdd.getNumPartitions() == 1 and dealt(table).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert dealt(table, rows=20).rdd.getNumPartitions() == 50 and sorted(r.id for r in dealt(table, 20).collect()) == list(range(1000))


def test_plain_pages_are_read_like_others():
    """Pages of plain tags take a short way to the same elements and blocks."""
    rng = random.Random(4)
    plain = ["<p>", "</p>", '<a href="/x" CLASS="b  c">', "</A>", "<br/>", '<img src="<q>" />', "text ", "é\n", "<li>", "</li>", "<nav>", "</nav>", "<td>", "<h1>", "</h1 >"]
    odd = ["&amp;", "<!-- c -->", "<script>", "</script>", "<a href='s'>", "<title>", "< ", '<a b="c"d="e">', "<x:y>"]
    short = 0
    for n in range(3000):
        html = "".join(rng.choice(plain if n % 3 else plain + odd) for _ in range(rng.randint(0, 12)))
        trees = []
        for tree in (elements.Tree(), elements._Blocks()):
            tree.feed(html)
            tree.close()
            tree._close(None)
            trees.append(tree)
        read = elements.Tree().read(html)

        def facts(tree):
            return [(r.el, r.parent, r.tag, r.attrs, r.start, r.end, r.block, r.in_link, r.boilerplate, r.silent) for r in tree.rows], tree.text

        assert facts(read) == facts(trees[0]), html
        assert elements._Blocks().read(html).found == trees[1].found, html
        short += elements.Tree()._read_plain(html)
    assert short > 1500


def test_plain_links_are_resolved_like_others(spark):
    plain = ["/a", "/b/c", "/", "/a//b", "/login", "/a", "/cart/x", "/~u/-"]
    pages = [(k, url, " ".join(f'<a href="{h}">x</a>' for h in [*plain, *more]))
             for k, url in enumerate(["http://h.org/q", "http://h.org:80/", "HTTP://H.org/", "http://u@h.org/", " http://h.org/", None])
             for more in ([], ["/x?y=1"])]
    rows = spark.createDataFrame(pages, "k int, url string, html string")
    for chrome in (True, False):
        got = rows.select("k", "html", links.link_array("html", "url", True, chrome).alias("l")).collect()
        by = {(r.k, "?" in r.html): r.l for r in got}
        for k in range(6):
            assert by[k, False] == [link for link in by[k, True] if "?" not in link]
        want = [f"http://h.org{p}" for p in ("/a", "/b/c", "/", "/a//b", "/login", "/cart/x", "/~u/-") if not (chrome and ("login" in p or "cart" in p))]
        assert by[0, False] == want
