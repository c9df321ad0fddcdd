"""URL functions over the pages table (and over URLs derived from other tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webcorpus import fixed
from webcorpus.functions import urls as U
from webcorpus.plans.catalog import dealt_table, query, table

HOST_SQL = r"nullif(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^:/?#]*)', 1)), '')"
PATH_SQL = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
QUERY_SQL = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query("url_host", f"SELECT page_id, {HOST_SQL} AS host FROM pages")
def _host(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.url_host("url").alias("host"))


@query("reg_domain", f"""
    SELECT array_to_string(list_slice(string_split({HOST_SQL}, '.'), -2, -1), '.') AS domain,
           count(*) AS pages
    FROM pages GROUP BY 1""")
def _reg_domain(spark, sf):
    return table(spark, sf, "pages").groupBy(
        U.reg_domain(U.url_host("url")).alias("domain")
    ).agg(F.count("*").alias("pages"))


@query("url_join", rf"""
    WITH refs AS (
      SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, {PATH_SQL} AS path
      FROM pages)
    SELECT page_id, origin || '/p' || page_id || '?q=' || page_id AS rooted,
           regexp_extract(url, '^([^:/?#]+:)', 1) || '//cdn.example/' || page_id AS network,
           CASE WHEN path = '' THEN origin || '/x' || page_id
                ELSE origin || regexp_replace(path, '[^/]*$', '') || 'x' || page_id END AS sibling,
           CASE WHEN path = '' THEN origin || '/up'
                ELSE origin || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || 'up' END AS parent
    FROM refs""")
def _url_join(spark, sf):
    pages = table(spark, sf, "pages")
    number = F.col("page_id").cast("string")
    return pages.select(
        "page_id",
        U.url_join("url", F.concat(F.lit("/p"), number, F.lit("?q="), number)).alias("rooted"),
        U.url_join("url", F.concat(F.lit("//cdn.example/"), number)).alias("network"),
        U.url_join("url", F.concat(F.lit("x"), number)).alias("sibling"),
        U.url_join("url", F.lit("../up")).alias("parent"),
    )


@query("same_domain", "SELECT page_id, page_id % 2 <> 0 AS same FROM pages")
def _same_domain(spark, sf):
    # Every second page is compared with a link to a subdomain of its host.
    link = F.concat(
        F.lit("https://"), F.when(F.col("page_id") % 2 == 0, F.lit("m.")).otherwise(F.lit("")),
        F.upper(U.url_host("url")), F.lit("/x?page="), F.col("page_id"),
    )
    return table(spark, sf, "pages").select("page_id", U.same_domain("url", link).alias("same"))


@query("is_chrome", rf"""
    WITH urls AS (
      SELECT page_id, false AS made, url FROM pages
      UNION ALL
      SELECT page_id, true, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/'
             || list_extract([{sql_list(fixed.CHROME_SEGMENTS)}], CAST(page_id % {len(fixed.CHROME_SEGMENTS)} + 1 AS INT))
             || CASE WHEN page_id % 3 = 0 THEN 'x' ELSE '/y' END AS url
      FROM pages)
    SELECT page_id, made, regexp_matches({PATH_SQL}, '(?i)(?:^|/)(?:{"|".join(fixed.CHROME_SEGMENTS)})(?:[/?.#]|$)') AS chrome
    FROM urls""")
def _is_chrome(spark, sf):
    pages = table(spark, sf, "pages")
    words = F.array(*[F.lit(w) for w in fixed.CHROME_SEGMENTS])
    word = F.get(words, (F.col("page_id") % len(fixed.CHROME_SEGMENTS)).cast("int"))
    tail = F.when(F.col("page_id") % 3 == 0, F.lit("x")).otherwise(F.lit("/y"))
    made = pages.select("page_id", F.lit(True).alias("made"), F.concat(U.url_origin("url"), F.lit("/"), word, tail).alias("url"))
    every = pages.select("page_id", F.lit(False).alias("made"), "url").unionByName(made)
    return every.select("page_id", "made", U.is_chrome("url").alias("chrome"))


@query("in_scope", f"""
    SELECT page_id, starts_with({PATH_SQL}, '/en/') AS in_section,
           CASE WHEN {PATH_SQL} = '' THEN '/' ELSE {PATH_SQL} END AS own_scope
    FROM pages""")
def _in_scope(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", U.in_scope("url", "/en/").alias("in_section"),
        U.scope_prefix("url").alias("own_scope"),
    )


_SEGMENT_SQL = f"list_extract(string_split({PATH_SQL}, '/'), -1)"


@query("url_ext_and_name", f"""
    SELECT page_id,
           CASE WHEN contains({_SEGMENT_SQL}, '.') THEN lower(list_extract(string_split({_SEGMENT_SQL}, '.'), -1))
                ELSE '' END AS ext,
           CASE WHEN {_SEGMENT_SQL} <> '' THEN url_decode({_SEGMENT_SQL}) ELSE {HOST_SQL} END AS name
    FROM pages""")
def _ext_name(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", U.url_ext("url").alias("ext"), U.url_name("url").alias("name")
    )


_PART_EXT = ["pdf", "zip", "mp3", "mp4", "png", "html", "xlsx", "tgz"]
_KIND_SQL = " ".join(
    f"WHEN ext IN ({sql_list(names)}) THEN '{kind}'" for kind, names in fixed.ASSET_EXTENSIONS.items()
)


def part_files(spark, sf):
    """A file URL per part, its extension picked by key."""
    ext = F.get(F.array(*[F.lit(e) for e in _PART_EXT]), (F.col("p_partkey") % 8).cast("int"))
    return table(spark, sf, "part", "p_partkey").select(
        "p_partkey",
        F.concat(F.lit("https://files.example/f/"), F.col("p_partkey"), F.lit("."), ext).alias("url"),
    )


PART_FILES_SQL = f"""SELECT p_partkey, list_extract([{sql_list(_PART_EXT)}], CAST(p_partkey % 8 + 1 AS INT)) AS ext,
    'https://files.example/f/' || p_partkey || '.' || list_extract([{sql_list(_PART_EXT)}], CAST(p_partkey % 8 + 1 AS INT)) AS url
    FROM part"""


@query("asset_kind", f"""
    WITH files AS ({PART_FILES_SQL})
    SELECT p_partkey, CASE {_KIND_SQL} END AS kind FROM files""")
def _asset_kind(spark, sf):
    return part_files(spark, sf).select("p_partkey", U.asset_kind(U.url_ext("url")).alias("kind"))


@query("unwrap_viewer", f"""
    WITH files AS ({PART_FILES_SQL})
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN url END AS real_url FROM files""")
def _unwrap_viewer(spark, sf):
    files = part_files(spark, sf)
    viewer = F.when(
        F.col("p_partkey") % 3 == 0,
        F.concat(F.lit("https://docs.google.com/gview?embedded=true&url="), F.url_encode("url")),
    ).when(F.col("p_partkey") % 3 == 1, F.col("url")).otherwise(
        F.concat(F.lit("https://docs.google.com/gview?name="), F.col("p_partkey"))
    )
    return files.select("p_partkey", U.unwrap_viewer(viewer).alias("real_url"))


_HOST_POOL = ["www.youtube.com/embed/", "player.vimeo.com/video/", "www.slideshare.net/x/", "old.reddit.com/r/",
              "x.com/status/", "i.imgur.com/", "m.tiktok.com/@", "example.org/youtube/", "open.spotify.com/embed/",
              "www.instagram.com/p/", "instagram.com/user", "instagram.com/explore/"]
_POOL_SQL = f"""SELECT c_custkey, 'https://' || list_extract([{sql_list(_HOST_POOL)}],
    CAST(c_custkey % {len(_HOST_POOL)} + 1 AS INT)) || c_custkey AS url FROM customer"""


def media_urls(spark, sf):
    """A social or media URL per customer."""
    host = F.get(
        F.array(*[F.lit(h) for h in _HOST_POOL]), (F.col("c_custkey") % len(_HOST_POOL)).cast("int")
    )
    return table(spark, sf, "customer", "c_custkey").select(
        "c_custkey", F.concat(F.lit("https://"), host, F.col("c_custkey")).alias("url")
    )


def _host_case(labels: dict[str, str]) -> str:
    host = "regexp_extract(url, '//([^/]*)', 1)"
    whens = " ".join(
        f"WHEN {host} = '{h}' OR ends_with({host}, '.{h}') THEN '{label}'" for h, label in labels.items()
    )
    return f"CASE {whens} END"


@query("embed_provider", f"""
    WITH u AS ({_POOL_SQL})
    SELECT c_custkey, CASE
        WHEN contains(url, 'youtube.com/embed') THEN 'youtube' WHEN contains(url, 'player.vimeo.com') THEN 'vimeo'
        WHEN contains(url, 'slideshare.net') THEN 'slideshare' WHEN contains(url, 'spotify.com/embed') THEN 'spotify'
        END AS provider FROM u""")
def _embed(spark, sf):
    return media_urls(spark, sf).select("c_custkey", U.embed_provider("url")["provider"].alias("provider"))


@query("platform_providers", f"""
    WITH u AS ({_POOL_SQL})
    SELECT c_custkey, {_host_case(fixed.VIDEO_HOSTS)} AS video, {_host_case(fixed.GALLERY_HOSTS)} AS gallery,
           {_host_case(fixed.COMMENT_HOSTS)} AS comments,
           coalesce({_host_case(fixed.COMMENT_HOSTS)} IN ('reddit', 'twitter', 'tiktok'), false) AS experimental
    FROM u""")
def _platforms(spark, sf):
    return media_urls(spark, sf).select(
        "c_custkey", U.video_provider("url").alias("video"), U.gallery_provider("url").alias("gallery"),
        U.comment_platform("url").alias("comments"), U.is_experimental("url").alias("experimental"),
    )


@query("instagram_urls", f"""
    WITH u AS ({_POOL_SQL})
    SELECT c_custkey, CASE c_custkey % {len(_HOST_POOL)} WHEN 9 THEN 'post' WHEN 10 THEN 'profile' END AS kind,
           CASE WHEN c_custkey % {len(_HOST_POOL)} = 9 THEN c_custkey::VARCHAR END AS shortcode,
           CASE WHEN c_custkey % {len(_HOST_POOL)} = 10 THEN 'user' || c_custkey END AS username
    FROM u""")
def _instagram(spark, sf):
    here = U.gallery_provider("url") == "instagram"
    return media_urls(spark, sf).select(
        "c_custkey", F.when(here, U.instagram_kind("url")).alias("kind"),
        F.when(here, U.instagram_shortcode("url")).alias("shortcode"),
        F.when(here, U.instagram_username("url")).alias("username"),
    )


_TRACK = ["collect?x=", "api/items/", "pixel/", "v1/traces/", "ads?", "news/", "prebid/", "trackside/"]


@query("is_telemetry", f"""
    WITH u AS (SELECT o_orderkey, 'https://t.example/' || list_extract([{sql_list(_TRACK)}],
                 CAST(o_orderkey % 8 + 1 AS INT)) || o_orderkey AS url FROM orders)
    SELECT o_orderkey, regexp_matches(url, '{fixed.TELEMETRY_PATTERN}') AS telemetry FROM u""")
def _telemetry(spark, sf):
    piece = F.get(F.array(*[F.lit(t) for t in _TRACK]), (F.col("o_orderkey") % 8).cast("int"))
    url = F.concat(F.lit("https://t.example/"), piece, F.col("o_orderkey"))
    return table(spark, sf, "orders", "o_orderkey").select("o_orderkey", U.is_telemetry(url).alias("telemetry"))


@query("is_document", f"""
    WITH files AS ({PART_FILES_SQL})
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN true WHEN p_partkey % 5 = 1 THEN false
           ELSE ext IN ('pdf', 'xlsx') END AS is_document, p_partkey || '.' || ext AS filename
    FROM files""")
def _documents(spark, sf):
    kind = F.when(F.col("p_partkey") % 5 == 0, F.lit("application/PDF; v=1")).when(
        F.col("p_partkey") % 5 == 1, F.lit("text/html")
    ).otherwise(F.lit("application/octet-stream"))
    return part_files(spark, sf).select(
        "p_partkey", U.is_document(kind, "url").alias("is_document"),
        U.filename_from_url("url").alias("filename"),
    )


@query("looks_like_html", """
    SELECT page_id, CASE page_id % 3 WHEN 1 THEN false ELSE true END AS as_page,
           contains(lower(left(html, 512)), '<html') OR starts_with(lower(ltrim(left(html, 512))), '<!doctype html') AS by_body,
           false AS as_title
    FROM pages""")
def _html_sniff(spark, sf):
    kind = F.when(F.col("page_id") % 3 == 1, F.lit("text/plain")).when(
        F.col("page_id") % 3 == 2, F.lit("Text/HTML")
    )
    return table(spark, sf, "pages").select(
        "page_id", U.looks_like_html(kind, "html").alias("as_page"),
        U.looks_like_html(F.lit(None), "html").alias("by_body"),
        U.looks_like_html(F.lit(None), F.concat(F.lit("plain "), F.col("url"))).alias("as_title"),
    )


@query("bump_page", f"""
    SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=[0-9]+') THEN
        regexp_replace(regexp_replace(url, '#.*$', ''), 'page=[0-9]+',
        'page=' || (CAST(regexp_extract(url, 'page=([0-9]+)', 1) AS INT) + 1)) END AS next_url FROM pages""")
def _bump(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.bump_page("url").alias("next_url"))


@query("safe_filename", """
    SELECT p_partkey, CASE p_partkey % 3
        WHEN 0 THEN regexp_replace(p_name, '[^A-Za-z0-9._ ()-]+', '_', 'g') || '.pdf'
        WHEN 1 THEN '__' || p_partkey || '.zip'
        ELSE 'item ' || p_partkey || '.csv' END AS filename
    FROM part""")
def _safe_filename(spark, sf):
    third = F.col("p_partkey") % 3
    number = F.col("p_partkey").cast("string")
    url = F.when(third == 1, F.concat(F.lit("https://f.example/..%2F"), number, F.lit(".zip"))).otherwise(
        F.concat(F.lit("https://f.example/item%20"), number)
    )
    header = F.when(third == 0, F.concat(F.lit('attachment; filename="'), F.col("p_name"), F.lit('"')))
    kind = F.when(third == 0, F.lit("application/pdf")).when(third == 2, F.lit("text/csv; charset=utf-8"))
    return table(spark, sf, "part", "p_partkey", "p_name").select(
        "p_partkey", U.safe_filename(url, header, kind).alias("filename")
    )


@query("blocked_address", """
    WITH ips AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS v FROM orders),
    parts AS (SELECT o_orderkey, v, v // 16777216 AS a, (v // 65536) % 256 AS b, (v // 256) % 256 AS c, v % 256 AS d FROM ips)
    SELECT o_orderkey, (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254)
        OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 198 AND b BETWEEN 18 AND 19)
        OR (a = 192 AND b = 0 AND c IN (0, 2) AND NOT (c = 0 AND d IN (9, 10)))
        OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS blocked
    FROM parts""")
def _blocked(spark, sf):
    value = (F.col("o_orderkey") * F.lit(2654435761)) % F.lit(4294967296)
    octets = [F.floor(value / 2**shift) % 256 for shift in (24, 16, 8, 0)]
    url = F.concat(F.lit("http://"), F.concat_ws(".", *[o.cast("string") for o in octets]), F.lit("/x"))
    return dealt_table(spark, sf, "orders", "o_orderkey").select(
        "o_orderkey", U.is_blocked_address(url).alias("blocked")
    )


@query("host_allowed", f"""
    SELECT page_id, {HOST_SQL} IN ('spam-farm.example.org', 'blog.ththan.example.net') AS allowed FROM pages""")
def _allowed(spark, sf):
    hosts = ["spam-farm.example.org", "blog.ththan.example.net"]
    return table(spark, sf, "pages").select("page_id", U.host_allowed("url", hosts).alias("allowed"))


@query("redact_log_urls", f"""
    SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || {HOST_SQL} || {PATH_SQL} AS url,
           'page ' || page_id AS seed FROM pages""")
def _redact(spark, sf):
    from webcorpus.sources.envelopes import redact_log_urls

    logs = table(spark, sf, "pages").select(
        "page_id", "url", F.concat(F.lit("page "), F.col("page_id")).alias("seed")
    )
    return redact_log_urls(logs)
