import itertools
import random
from ipaddress import ip_address
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from webcorpus.functions import urls as U


def values(spark, rows, **columns):
    df = spark.createDataFrame(rows)
    return [r.asDict() for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_join_agrees_with_the_standard_library(spark):
    rng = random.Random(7)
    bases = ["http://h.com", "http://h.com/", "https://h.com/a/b", "http://h.com/a/b/?q=1#f",
             "http://h.com/a//b/../c;p?x=y", "http://u@h.com:80/x"]
    parts = ["", "a", ".", "..", "b c", "x.html", "é"]
    refs = {"", "/", "//o.org/z", "//o.org", "http:rel", "http://O.org/Q?#", "HTTPS://A.b/c#d", "?q=2",
            "#frag", "mailto:x@y", "../../../up", "./here", "a/./b/../c/", "/a/../../b", "/./x", "g?y/../z",
            "/x//y", "a//b", "http:/abs", "javascript:void(0)", "\tx\ny", " lead"}
    for _ in range(200):
        refs.add(rng.choice(["", "/"]) + "/".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
                 + rng.choice(["", "?k=v", "#f", "?"]))
    pairs = list(itertools.product(bases, sorted(refs)))
    df = spark.createDataFrame(pairs, "b string, r string")
    for row in df.select("b", "r", U.url_join("b", "r").alias("j")).collect():
        assert row.j == urljoin(row.b, row.r), (row.b, row.r)


def test_split_agrees_with_the_standard_library(spark):
    urls = ["http://User:pw@Host.COM:8080/p/a?q#f", "https://a_b.com", "//x.org/y", "/only/path",
            "http://[::1]:9/z", "mailto:a@b", "http://h/?a=1&b=", "HTTP://UP.com/X"]
    rows = values(spark, [(u,) for u in urls], u=F.col("_1"), host=U.url_host("_1"), path=U.url_path("_1"),
                  query=U.url_query("_1"), scheme=U.url_scheme("_1"))
    for r in rows:
        p = urlsplit(r["u"])
        assert (r["host"], r["path"], r["query"], r["scheme"]) == (p.hostname, p.path, p.query, p.scheme)


BUMPED = [
    ("http://x.com/l?page=3", "http://x.com/l?page=4"), ("http://x.com/l?q=a+b&page=9#z", "http://x.com/l?q=a+b&page=10"),
    ("http://x.com/?p=x&offset=20", "http://x.com/?p=x&offset=21"), ("http://x.com/?page=", None), ("http://x.com/none", None),
    ("http://x.com/?pg=1&pg=7&k=%C3%A9~*", "http://x.com/?pg=2&k=%C3%A9~%2A"), ("http://x.com/?page=-1", "http://x.com/?page=0"),
]


def test_bump_page(spark):
    rows = values(spark, [(u,) for u, _ in BUMPED], u=F.col("_1"), n=U.bump_page("_1"))
    assert [(r["u"], r["n"]) for r in rows] == BUMPED


def test_files_and_providers(spark):
    rows = values(
        spark,
        [("https://d.org/a/Report%20One.PDF?x=1",), ("https://d.org/",), ("https://d.org/tar.gz",)],
        ext=U.url_ext("_1"), name=U.url_name("_1"), kind=U.asset_kind(U.url_ext("_1")),
    )
    assert [r["ext"] for r in rows] == ["pdf", "", "gz"]
    assert [r["name"] for r in rows] == ["Report One.PDF", "d.org", "tar.gz"]
    assert [r["kind"] for r in rows] == ["document", None, "archive"]
    rows = values(
        spark,
        [("https://docs.google.com/viewer?url=https%3A%2F%2Fz.org%2Ff.docx&e=1",),
         ("https://www.youtube.com/embed/abc",), ("https://m.soundcloud.com/a",),
         ("https://notyoutube.com/embed",), ("https://old.reddit.com/r/x",)],
        real=U.unwrap_viewer("_1"), prov=U.embed_provider("_1")["provider"], video=U.video_provider("_1"),
        gal=U.gallery_provider("_1"), com=U.comment_platform("_1"), exp=U.is_experimental("_1"),
    )
    assert [r["real"] for r in rows] == ["https://z.org/f.docx", None, None, None, None]
    assert [r["prov"] for r in rows] == ["gdocs", "youtube", "soundcloud", "youtube", None]
    assert [r["video"] for r in rows] == [None, "youtube", "soundcloud", None, None]
    assert rows[4]["gal"] == "reddit" and rows[4]["com"] == "reddit" and rows[4]["exp"]


def test_instagram(spark):
    rows = values(
        spark,
        [("https://www.instagram.com/p/AbC/",), ("https://instagram.com/some.one",),
         ("https://instagram.com/explore/",), ("https://instagram.com/",), ("https://x.com/p/AbC",)],
        kind=U.instagram_kind("_1"), code=U.instagram_shortcode("_1"), user=U.instagram_username("_1"),
    )
    assert [r["kind"] for r in rows] == ["post", "profile", None, None, None]
    assert rows[0]["code"] == "AbC" and rows[1]["user"] == "some.one" and rows[2]["user"] is None


def test_chrome_scope_telemetry_documents(spark):
    rows = values(
        spark,
        [("https://x.com/login",), ("https://x.com/news/contact-sport",), ("https://x.com/CART?x",),
         ("https://x.com/a/terms.html",)],
        c=U.is_chrome("_1"), s=U.in_scope("_1", "/news"),
    )
    assert [r["c"] for r in rows] == [True, False, True, True]
    assert [r["s"] for r in rows] == [False, True, False, False]
    rows = values(
        spark,
        [("https://x.com/collect?z", "text/html"), ("https://api.x.com/items", "application/pdf; v=1"),
         ("https://x.com/f.DOCX", "application/octet-stream"), ("https://x.com/f.pdf", "text/html")],
        t=U.is_telemetry("_1"), d=U.is_document("_2", "_1"), f=U.filename_from_url("_1"),
    )
    assert [r["t"] for r in rows] == [True, False, False, False]
    assert [r["d"] for r in rows] == [False, True, True, False]
    assert rows[2]["f"] == "f.DOCX"


def test_reg_domain_is_naive(spark):
    rows = values(spark, [("www.shop.com.ar",), ("a.b",), ("host",), (None,)], r=U.reg_domain("_1"))
    assert [r["r"] for r in rows] == ["com.ar", "a.b", "host", ""]


def test_safe_filename(spark):
    rows = values(
        spark,
        [("https://x/a/..%2f..%2fetc%2fpasswd", "", ""), ("https://x/a", "attachment; filename=\"b c.pdf\"", ""),
         ("https://x/report", "", "application/pdf; charset=x"), ("https://x/", "", "")],
        n=U.safe_filename("_1", "_2", "_3"),
    )
    names = [r["n"] for r in rows]
    assert "/" not in names[0] and ".." not in names[0]
    assert names[1:] == ["b c.pdf", "report.pdf", "descarga"]


def test_blocked_addresses(spark):
    ips = ["127.0.0.1", "10.1.2.3", "172.15.0.1", "172.16.0.1", "192.168.1.1", "169.254.169.254", "100.64.0.1",
           "100.128.0.1", "8.8.8.8", "0.0.0.0", "224.0.0.1", "255.255.255.255", "198.18.0.1", "192.0.0.9",
           "192.0.0.8", "203.0.113.7", "1.1.1.1"]
    v6 = ["::1", "::", "fe80::1", "fc00::1", "ff02::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "2001:db8::1",
          "2606:4700:4700::1111", "fec0::1", "2001:4860:4860::8888", "2002:7f00:1::", "2001:20::1", "2001:1::1",
          "64:ff9b::8.8.8.8"]

    def blocked(text):
        ip = ip_address(text)
        mapped = getattr(ip, "ipv4_mapped", None)
        shared = ip.version == 4 and ip in __import__("ipaddress").ip_network("100.64.0.0/10")
        return (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved
                or ip.is_unspecified or shared or (mapped is not None and blocked(str(mapped)))
                or (ip.version == 6 and ip.is_site_local))

    rows = [(f"http://{i}/x", blocked(i)) for i in ips] + [(f"https://[{i}]:8/x", blocked(i)) for i in v6]
    rows += [("ftp://8.8.8.8/", True), ("http:///x", True), ("https://name.example/x", False), ("nonsense", True)]
    df = spark.createDataFrame(rows, "u string, want boolean")
    for r in df.select("u", "want", U.is_blocked_address("u").alias("got")).collect():
        assert r.got == r.want, r


def test_redaction_and_allow_list(spark):
    rows = values(
        spark, [("https://A.com:8/p?tok=1#z",), ("not a url",)],
        r=U.redact_url("_1"), ok=U.host_allowed("_1", ["a.com"]),
    )
    assert rows[0] == {"r": "https://a.com/p", "ok": True}
    assert rows[1] == {"r": "not a url", "ok": False}
