"""URL functions as Catalyst expressions.

``parse_url`` is not used: it returns NULL for hosts such as ``a_b.com`` and keeps
upper case. The patterns below split a URL the way RFC 3986 (appendix B) does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus import fixed

_SCHEME = r"(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
SCHEME_PATTERN = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC_PATTERN = rf"^{_SCHEME}//([^/?#]*)"
HOST_PATTERN = rf"^{_SCHEME}//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)"
PATH_PATTERN = rf"^{_SCHEME}(?://[^/?#]*)?([^?#]*)"
QUERY_PATTERN = r"^[^?#]*\?([^#]*)"
FRAGMENT_PATTERN = r"#(.*)$"
_C0_AND_SPACE = "".join(map(chr, range(33)))


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean(url: Column | str) -> Column:
    """Drop leading control characters and embedded tabs and line breaks."""
    return F.translate(F.ltrim(_col(url), F.lit(_C0_AND_SPACE)), "\t\r\n", "")


def url_scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), SCHEME_PATTERN, 1))


def url_netloc(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), NETLOC_PATTERN, 1)


def url_host(url: Column | str) -> Column:
    """Lower-cased host without port or user info; NULL when there is none."""
    host = F.translate(F.regexp_extract(_col(url), HOST_PATTERN, 1), "[]", "")
    return F.nullif(F.lower(host), F.lit(""))


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), PATH_PATTERN, 1)


def url_query(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), QUERY_PATTERN, 1)


def url_origin(url: Column | str) -> Column:
    return F.concat(url_scheme(url), F.lit("://"), url_netloc(url))


def reg_domain(host: Column | str) -> Column:
    """Last two labels. Deliberately naive: ``www.shop.com.ar`` gives ``com.ar``."""
    return F.substring_index(F.lower(F.coalesce(_col(host), F.lit(""))), ".", -2)


def same_domain(left: Column | str, right: Column | str) -> Column:
    return url_host(left).eqNullSafe(url_host(right))


def is_chrome(url: Column | str) -> Column:
    """Navigation boilerplate (login, cart, terms, …) judged by path segment."""
    return url_path(url).rlike(fixed.CHROME_PATTERN)


def in_scope(url: Column | str, prefix: Column | str | None) -> Column:
    """``prefix`` is a literal path or a column; NULL or empty means no limit."""
    if prefix is None:
        return F.lit(True)
    wanted = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return F.coalesce(wanted == "", F.lit(True)) | url_path(url).startswith(wanted)


def scope_prefix(seed: Column | str) -> Column:
    """Section prefix of a seed URL for crawls limited to its path."""
    path = url_path(seed)
    return F.when(path == "", F.lit("/")).otherwise(path)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def _parts(url: Column) -> Column:
    return F.struct(
        url_scheme(url).alias("scheme"), url_netloc(url).alias("netloc"),
        url_path(url).alias("path"), url_query(url).alias("query"),
        F.regexp_extract(url, FRAGMENT_PATTERN, 1).alias("fragment"),
    )


def _unsplit(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    empty = F.lit("")
    return F.concat(
        scheme, F.lit("://"), netloc,
        F.when((path != "") & ~path.startswith("/"), F.lit("/")).otherwise(empty), path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(empty),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(empty),
    )


def _resolve_segments(segments: Column) -> Column:
    """Apply ``.`` and ``..`` to path segments and put the path back together."""
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg == "..",
            F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
        ).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg))),
    )
    tail = F.when(
        F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(resolved, tail), "/")


def _merge_paths(base_path: Column, path: Column) -> Column:
    """RFC 3986 path merge; only the text after the base path's last slash is replaced."""
    rooted = path.startswith("/")
    merged = F.concat(F.regexp_replace(base_path, r"[^/]*$", ""), path)
    relative = F.when(merged.startswith("/"), merged).otherwise(F.concat(F.lit("/"), merged))
    # Empty segments inside a relative result collapse; a rooted reference keeps them.
    tidy = F.regexp_replace(relative, r"/{2,}", "/")
    return let(
        F.when(rooted, path).otherwise(tidy),
        lambda joined: F.when(
            joined.contains("/."),
            let(_resolve_segments(F.split(joined, "/", -1)),
                lambda done: F.when(done == "", F.lit("/")).otherwise(done)),
        ).otherwise(joined),
    )


def _join_general(base: Column, href: Column) -> Column:
    def resolve(both: Column) -> Column:
        root, ref = both["root"], both["ref"]
        bare = (ref["path"] == "") & (ref["netloc"] == "")
        path = (
            F.when(ref["netloc"] != "", ref["path"])
            .when(ref["path"] == "", root["path"])
            .otherwise(_merge_paths(root["path"], ref["path"]))
        )
        joined = _unsplit(
            root["scheme"],
            F.when(ref["netloc"] != "", ref["netloc"]).otherwise(root["netloc"]),
            path,
            F.when(bare & (ref["query"] == ""), root["query"]).otherwise(ref["query"]),
            ref["fragment"],
        )
        foreign = (ref["scheme"] != "") & (ref["scheme"] != root["scheme"])
        return F.when(foreign, href).otherwise(joined)

    return let(
        F.struct(_parts(clean(base)).alias("root"), _parts(clean(href)).alias("ref")), resolve
    )


def url_root(base: Column | str) -> Column:
    """What :func:`url_join` puts before a rooted reference: scheme and host of a base."""
    root = _col(base)
    return F.concat(F.lower(F.regexp_extract(root, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*:)", 1)), F.lit("//"), url_netloc(clean(root)))


def url_join(base: Column | str, href: Column | str, before: Column | None = None) -> Column:
    """Resolve ``href`` against an absolute ``base``, fragment kept.

    ``before`` is the base's :func:`url_root` for callers that join many references to one base.

    Plain rooted and absolute references, nearly all of a web corpus, take a path without
    arrays; everything else goes through full RFC 3986 resolution.
    """
    root, ref = _col(base), _col(href)
    odd = ref.rlike(r"[\x00-\x20]|\?#|[?#]$|/\.|^https?:///")
    return (
        F.when(F.coalesce(ref, F.lit("")) == "", root)
        .when(is_http(ref) & ~odd, ref)
        .when(
            ref.startswith("/") & ~ref.startswith("//") & ~odd,
            F.concat(url_root(root) if before is None else before, ref),
        )
        .otherwise(_join_general(root, ref))
    )


def cut_fragment(url: Column | str) -> Column:
    return F.substring_index(_col(url), "#", 1)


def is_http(url: Column | str) -> Column:
    return _col(url).startswith("http://") | _col(url).startswith("https://")


def unquote(text: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone and bad escapes untouched."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _unquote_plus(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _quote_plus(text: Column) -> Column:
    # Form encoding keeps "*" and escapes "~"; URLs in the corpus do the reverse.
    encoded = F.url_encode(text)
    return F.replace(
        F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def query_pairs(url: Column | str) -> Column:
    """Decoded ``(k, v)`` pairs of the query in order; blank values dropped."""
    parts = F.filter(F.split(url_query(url), "&", -1), lambda part: part.contains("="))
    pairs = F.transform(
        parts,
        lambda part: F.struct(
            _unquote_plus(F.substring_index(part, "=", 1)).alias("k"),
            _unquote_plus(F.regexp_extract(part, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    return F.filter(pairs, lambda pair: pair["v"] != "")


def _first_value(pairs: Column, key: Column) -> Column:
    return F.try_element_at(F.filter(pairs, lambda pair: pair["k"] == key), F.lit(1))["v"]


def bump_page(url: Column | str) -> Column:
    """Next URL of a numbered query page, or NULL when no parameter counts pages.

    The first of the known page parameters that holds a whole number grows by one.
    Every key keeps its first value only and the fragment goes.
    """
    source = _col(url)

    def rebuild(pairs: Column) -> Column:
        candidates = F.transform(
            F.array(*[F.lit(key) for key in fixed.PAGE_PARAMS]),
            lambda key: F.struct(
                key.alias("key"),
                let(
                    _first_value(pairs, key),
                    lambda v: F.when(
                        v.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(v).try_cast("decimal(38,0)")
                    ),
                ).alias("number"),
            ),
        )

        def write(chosen: Column) -> Column:
            keys = F.array_distinct(F.transform(pairs, lambda pair: pair["k"]))
            return F.array_join(
                F.transform(
                    keys,
                    lambda key: F.concat(
                        _quote_plus(key), F.lit("="),
                        F.when(key == chosen["key"], (chosen["number"] + 1).cast("string")).otherwise(
                            _quote_plus(_first_value(pairs, key))
                        ),
                    ),
                ),
                "&",
            )

        usable = F.get(F.filter(candidates, lambda c: c["number"].isNotNull()), 0)
        return let(usable, lambda chosen: F.when(chosen.isNotNull(), write(chosen)))

    head = F.regexp_extract(source, r"^([^?#]*)", 1)
    return F.when(
        source.contains("?"),
        let(query_pairs(source), lambda pairs: F.concat(head, F.lit("?"), rebuild(pairs))),
    )


def _last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def url_ext(url: Column | str) -> Column:
    """Lower-cased extension of the last path segment, empty when there is none."""
    segment = _last_segment(F.lower(url_path(url)))
    return F.when(segment.contains("."), F.substring_index(segment, ".", -1)).otherwise(F.lit(""))


def url_name(url: Column | str) -> Column:
    segment = unquote(_last_segment(url_path(url)))
    return F.coalesce(F.nullif(segment, F.lit("")), url_host(url), _col(url))


def asset_kind(ext: Column | str) -> Column:
    """document / archive / audio / video / image, else NULL."""
    table = [
        F.lit(x) for kind, names in fixed.ASSET_EXTENSIONS.items() for n in names for x in (n, kind)
    ]
    return F.try_element_at(F.create_map(*table), _col(ext))


def unwrap_viewer(url: Column | str) -> Column:
    """The real file behind a document viewer URL, or NULL."""
    source = _col(url)
    low = F.lower(source)
    is_viewer = reduce(lambda a, b: a | b, [low.contains(mark) for mark in fixed.VIEWER_MARKS])

    def first_real(pairs: Column) -> Column:
        found = F.transform(
            F.array(*[F.lit(key) for key in fixed.VIEWER_KEYS]),
            lambda key: unquote(_first_value(pairs, key)),
        )
        return F.get(F.filter(found, lambda real: F.lower(real).rlike("^https?://")), 0)

    return F.when(is_viewer, let(query_pairs(source), first_real))


def embed_provider(url: Column | str) -> Column:
    """``struct(provider, name)`` of a known embedded player, or NULL."""
    low = F.lower(_col(url))
    rules = []
    for provider, name, marks in fixed.EMBED_RULES:
        hit = reduce(lambda a, b: a | b, [low.contains(mark) for mark in marks])
        rules.append(
            F.when(hit, F.struct(F.lit(provider).alias("provider"), F.lit(name).alias("name")))
        )
    return F.coalesce(*rules)


def _host_label(url: Column | str, table: dict[str, str]) -> Column:
    # Every listed host has two labels, so "host or any subdomain of it" is one lookup.
    labels = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(labels, F.substring_index(url_host(url), ".", -2))


def video_provider(url: Column | str) -> Column:
    return _host_label(url, fixed.VIDEO_HOSTS)


def gallery_provider(url: Column | str) -> Column:
    return _host_label(url, fixed.GALLERY_HOSTS)


def comment_platform(url: Column | str) -> Column:
    return _host_label(url, fixed.COMMENT_HOSTS)


def is_experimental(url: Column | str) -> Column:
    return F.coalesce(comment_platform(url).isin(*fixed.EXPERIMENTAL_PLATFORMS), F.lit(False))


def _segments(url: Column | str) -> Column:
    return F.filter(F.split(url_path(url), "/", -1), lambda seg: seg != "")


def instagram_kind(url: Column | str) -> Column:
    """``post``, ``profile`` or NULL."""
    host = url_host(url)
    ours = (host == "instagram.com") | host.endswith(".instagram.com")
    first = F.get(_segments(url), 0)
    return F.when(
        ours,
        F.when(first.isin(*fixed.POST_SEGMENTS), F.lit("post")).when(
            first.isNotNull() & ~first.isin(*fixed.PROFILE_RESERVED), F.lit("profile")
        ),
    )


def instagram_shortcode(url: Column | str) -> Column:
    segments = _segments(url)
    return F.when(F.get(segments, 0).isin(*fixed.POST_SEGMENTS), F.get(segments, 1))


def instagram_username(url: Column | str) -> Column:
    first = F.get(_segments(url), 0)
    return F.when(~first.isin(*fixed.PROFILE_RESERVED), first)


def is_telemetry(url: Column | str) -> Column:
    return _col(url).rlike(fixed.TELEMETRY_PATTERN)


def is_document(content_type: Column | str, url: Column | str) -> Column:
    """True for office files and PDFs, by content type first and suffix second."""
    kind = F.lower(F.coalesce(_col(content_type), F.lit("")))
    by_type = reduce(lambda a, b: a | b, [kind.contains(t) for t in fixed.DOCUMENT_TYPES])
    path = F.lower(url_path(url))
    by_suffix = reduce(lambda a, b: a | b, [path.endswith(s) for s in fixed.DOCUMENT_SUFFIXES])
    return (
        F.when(by_type, F.lit(True))
        .when(kind.contains("html") | kind.contains("text/plain"), F.lit(False))
        .otherwise(F.coalesce(by_suffix, F.lit(False)))
    )


def filename_from_url(url: Column | str) -> Column:
    return F.coalesce(
        F.nullif(_last_segment(url_path(url)), F.lit("")), F.lit(fixed.DEFAULT_DOCUMENT_NAME)
    )


def looks_like_html(content_type: Column | str, text: Column | str) -> Column:
    """By content type; without a telling one, by how the body begins (first 512 characters)."""
    kind = F.lower(F.coalesce(_col(content_type), F.lit("")))
    head = F.lower(F.regexp_replace(F.substring(F.coalesce(_col(text), F.lit("")), 1, 512), r"^\s+", ""))
    return (
        F.when(kind.contains("html"), F.lit(True))
        .when(kind.contains("text/plain") | kind.contains("markdown"), F.lit(False))
        .otherwise(head.startswith("<!doctype html") | head.contains("<html"))
    )


def safe_filename(
    url: Column | str, disposition: Column | str, content_type: Column | str
) -> Column:
    """File name without path tricks; the Content-Disposition name goes first."""
    parameters = F.transform(F.split(F.coalesce(_col(disposition), F.lit("")), ";"), lambda part: F.trim(part))
    given = F.get(F.filter(parameters, lambda part: F.lower(part).rlike(r"^filename\*?=")), 0)
    value = F.regexp_replace(F.substring(given, F.instr(given, "=") + 1, F.length(given)), r"(?i)^utf-8''", "")
    named = F.nullif(F.trim(unquote(F.btrim(F.trim(value), F.lit('"')))), F.lit(""))
    raw = F.coalesce(named, F.trim(unquote(_last_segment(url_path(url)))))
    # What is not allowed becomes one underscore, and so do the dots that could climb folders.
    allowed = F.regexp_replace(raw, rf"[^{fixed.FILENAME_CHARACTERS}]+|\.{{2,}}", "_")
    name = F.coalesce(F.nullif(F.btrim(allowed, F.lit(". ")), F.lit("")), F.lit(fixed.DEFAULT_DOWNLOAD_NAME))
    kinds = F.create_map(*[F.lit(x) for pair in fixed.DOWNLOAD_EXTENSIONS.items() for x in pair])
    kind = F.lower(F.trim(F.substring_index(F.coalesce(_col(content_type), F.lit("")), ";", 1)))
    ending = F.when(~name.contains("."), F.concat(F.lit("."), F.try_element_at(kinds, kind)))
    return F.substring(F.concat(name, F.coalesce(ending, F.lit(""))), 1, fixed.FILENAME_LENGTH)


# Address ranges that are not publicly routable (IANA special-purpose registries),
# as (first, last) integers. Two carve-outs inside 192.0.0.0/24 are public.
_V4_BLOCKED = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8),
    ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24),
    ("224.0.0.0", 4), ("240.0.0.0", 4),
)
_V4_PUBLIC = ("192.0.0.9", "192.0.0.10")


def _v4_number(dotted: str) -> int:
    return reduce(lambda total, octet: total * 256 + int(octet), dotted.split("."), 0)


def _v4_value(host: Column) -> Column:
    octets = F.transform(F.split(host, r"\.", -1), lambda o: o.try_cast("bigint"))
    return F.when(
        F.size(octets) == 4, F.aggregate(octets, F.lit(0).cast("bigint"), lambda n, o: n * 256 + o)
    )


_V4_PATTERN = r"^(?:0x[0-9a-f]*|[0-9]+)(?:\.(?:0x[0-9a-f]*|[0-9]+)){0,3}\.?$"


def _v4_written(host: Column) -> Column:
    """The address that one to four decimal, octal or hexadecimal numbers name; NULL if they name none.

    The last number fills all bytes the others leave.
    """
    def number(part: Column) -> Column:
        base = F.when(part.startswith("0x"), 16).when(part.rlike("^0.*"), 8).otherwise(10)
        digits = F.when(base == 16, F.concat(F.lit("0"), F.substring(part, 3, 99))).otherwise(part)
        readable = (base != 8) | digits.rlike("^[0-7]+$")
        value = F.when(base == 16, F.conv(digits, 16, 10)).when(base == 8, F.conv(digits, 8, 10)).otherwise(digits)
        return F.when(readable & (F.length(digits) <= 14), value.try_cast("bigint"))

    def address(parts: Column) -> Column:
        count = F.size(parts)
        heads, last = F.slice(parts, F.lit(1), count - 1), F.element_at(parts, -1)
        room = F.pow(F.lit(256), F.lit(5) - count).cast("bigint")
        head = F.aggregate(heads, F.lit(0).cast("bigint"), lambda n, o: n * 256 + o)
        sound = F.forall(heads, lambda o: o < 256) & (last < room)
        return F.when(sound, head * room + last)

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), number), address)


def _v4_blocked(value: Column) -> Column:
    inside = [
        value.between(_v4_number(net), _v4_number(net) + 2 ** (32 - bits) - 1)
        for net, bits in _V4_BLOCKED
    ]
    public = value.isin(*[_v4_number(ip) for ip in _V4_PUBLIC])
    return reduce(lambda a, b: a | b, inside) & ~public


def _v6_words(host: Column) -> Column:
    """The eight 16-bit words of an IPv6 literal; a dotted tail becomes two words."""
    tail = F.regexp_extract(host, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    number = _v4_value(tail)
    hexed = F.concat(
        F.lower(F.hex(F.shiftright(number, 16))), F.lit(":"),
        F.lower(F.hex(number.bitwiseAND(F.lit(65535)))),
    )
    flat = F.when(
        tail != "", F.concat(F.regexp_replace(host, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$", ""), hexed)
    ).otherwise(host)
    flat = F.substring_index(flat, "%", 1)
    has_gap = flat.contains("::")
    left = F.filter(F.split(F.substring_index(flat, "::", 1), ":"), lambda w: w != "")
    right = F.when(
        has_gap, F.filter(F.split(F.substring_index(flat, "::", -1), ":"), lambda w: w != "")
    ).otherwise(F.array().cast("array<string>"))
    missing = F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))
    words = F.concat(left, F.array_repeat(F.lit("0"), missing), right)
    return F.transform(words, lambda w: F.conv(w, 16, 10).cast("bigint"))


def _v6_blocked(words: Column) -> Column:
    first, second = F.get(words, 0), F.get(words, 1)

    special_2001 = (first == 0x2001) & (second < 0x200)
    public_2001 = special_2001 & (
        ((second == 1) & F.forall(F.slice(words, 3, 5), lambda w: w == 0)
         & F.get(words, 7).isin(1, 2))
        | (second == 3)
        | ((second == 4) & (F.get(words, 2) == 0x112))
        | second.between(0x20, 0x3F)
    )
    # Only 2000::/3 is public unicast, so mapped IPv4, local and multicast all fall outside.
    return (
        F.when((first < 0x2000) | (first > 0x3FFF), F.lit(True))
        .otherwise(
            (special_2001 & ~public_2001)
            | ((first == 0x2001) & (second == 0xDB8))
            | (first == 0x2002)
            | ((first == 0x3FFF) & (second < 0x1000))
        )
    )


def is_blocked_address(url: Column | str) -> Column:
    """True when a URL must not be fetched: scheme, missing host or non-public literal IP.

    Names are never resolved here; only literal addresses are judged.
    """
    source = clean(url)
    bad_scheme = ~url_scheme(source).isin("http", "https")

    def judge(host: Column) -> Column:
        return (
            F.when(host == "", F.lit(True))
            .when(host.rlike(_V4_PATTERN), F.coalesce(let(_v4_written(host), _v4_blocked), F.lit(False)))
            .when(host.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*(?:%.*)?$"), let(_v6_words(host), _v6_blocked))
            .otherwise(F.lit(False))
        )

    return F.when(bad_scheme, F.lit(True)).otherwise(
        let(F.coalesce(url_host(source), F.lit("")), judge)
    )


def host_allowed(url: Column | str, allowlist: list[str]) -> Column:
    """Exact-host allow-list; an empty list allows every host."""
    if not allowlist:
        return url_host(url).isNotNull()
    return F.coalesce(url_host(url).isin(*[h.lower() for h in allowlist]), F.lit(False))


def redact_url(url: Column | str) -> Column:
    """``scheme://host/path`` for logs; text that is not a URL stays as it is."""
    source = _col(url)
    return F.when(
        url_scheme(source) != "",
        F.concat(
            url_scheme(source), F.lit("://"), F.coalesce(url_host(source), F.lit("None")),
            url_path(source),
        ),
    ).otherwise(source)
