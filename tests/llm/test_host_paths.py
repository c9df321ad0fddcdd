"""Main text of pages of several hosts, each with a layout of its own, against the text they were made of."""

import random

import pytest

from webcorpus.llm import host_paths
from webcorpus.llm.host_paths import Page


def words(rng, low, high):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(low, high)))


def plain(title, parts, junk):
    return f"""<!DOCTYPE html><html><head><title>{title} | site</title><style>p{{x}}</style><script>var t="</p><p>no";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/a>{junk}</a></li></ul></nav><!-- no <p>comment</p> -->
    <article><h1>{title}</h1>{''.join(f'<p>{p}' for p in parts)}</article><footer>&copy; {junk}</footer></body></html>"""


def blog(title, parts, junk):
    return f"""<html><body><div id="cookie-notice">{junk}</div><div class="wrap wrap-7"><div class="top-menu"><a href=/>{junk}</a></div>
    <div class="post post-{len(title) * 37}"><h1>{title}</h1><div class="entry-content">{''.join(f'<p>{p}</p><aside>{junk}</aside>' for p in parts)}
    <form action=/><p>{junk}</p><button>{junk}</button></form><div class="adBox ad">{junk}</div></div></div>
    <section id="comments"><ol><li><article class="comment"><p>{junk * 20}</p></article></li></ol></section></div>"""


def bare(title, parts, junk):
    return f"""<body><ul><li><a href=1>{junk}</a><li><a href=2>b</a><li><a href=3>c</a></ul><table><tr><td class=left><a href=4>{junk}</a></td>
    <td class="main{len(title)}"><h2>{title}</h2>{''.join(f'<div>{p}</div>' for p in parts)}<blockquote>{title}</blockquote></td></tr></table>"""


def form_page(title, parts, junk):
    return f"""<body><form id="aspnet"><input value="{junk}"><main><header><p>{junk}</p><h1>{title}</h1></header><ul>{''.join(f'<li>{p}</li>' for p in parts)}</ul>
    <p hidden>{junk}</p></main><div role="contentinfo">{junk}</div></form></body>"""


LAYOUTS = {"plain.example": plain, "blog.example": blog, "bare.example": bare, "form.example": form_page}


@pytest.fixture(scope="module")
def made():
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(60):
        host = list(LAYOUTS)[k % 4]
        title, parts, junk = words(rng, 2, 5), [words(rng, 4 if k < 8 else 10, 40) for _ in range(rng.randint(2, 6))], words(rng, 3, 12)
        html = LAYOUTS[host](title, [p.replace("e", "<b>&eacute;</b> \n\t", 1) + " &amp;&lt;<br>x" for p in parts], junk)
        want[k] = [title, *(" ".join((p.replace("e", "é ", 1) + " &< x").split()) for p in parts), *([title] if host == "bare.example" else [])]
        rows.append((k, f"https://{host}/p/{k}", html))
    return rows, want


def test_articles_of_every_layout(spark, made):
    rows, want = made
    pages = spark.createDataFrame([(*r, "x", 1, "p") for r in rows], "page_id long, url string, html string, host string, votes int, text string").repartition(4)
    got = {r.page_id: r for r in host_paths.extract(pages).collect()}
    for k, lines in want.items():
        assert got[k].text == "\n".join(lines), rows[k][2]
        assert got[k].n_chars == len(got[k].text)
        assert got[k].url == rows[k][1]


def test_a_page_follows_its_host(spark):
    notice = "<div class=box9><p>" + "terms that nobody reads, at great length. " * 4 + "</p></div>"
    usual = [(k, "http://h.example/", f"<body><div class=box{k}><p>short</p></div><div class=story-{k}><p>{'a long story ' * 20}</p></div>") for k in range(20)]
    odd = (99, "http://h.example/odd", f"<body>{notice}<div class=story-5><p>a short story, but one all the same with words</p></div>")
    alone = (99, "http://other.example/odd", odd[2])

    def text(rows):
        return {r.page_id: r.text for r in host_paths.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}[99]

    assert text([*usual, odd]) == "a short story, but one all the same with words"
    assert text([*usual, alone]).startswith("terms that nobody reads")
    paths = {r.host: r.votes for r in host_paths.host_paths(spark.createDataFrame([*usual, odd], "page_id long, url string, html string")).collect()}
    assert paths == {"h.example": {"body>div.story-0": 20, "body": 1}}


@pytest.mark.parametrize("html, text", [
    ("", ""), ("just words", "just words"), ("<p>a<p>b<br>c", "a\nb c"), ("<body><nav>x</nav>", ""), ("<div>a&nbsp;&#x41;&copy;</div>", "a A©"),
    ("<p>one <script>if (a < b) {}</script>two", "one two"), ("<article><p>a</p><div class='share'>b</div><table><tr><td>c<td>d</table></article>", "a\nc\nd"),
    ("<div><p>x y z</p><!-- <p>no</p> --></div></div></p>", "x y z"), ("<div><h1>t</h1><div><p>words and words</p></div></div>", "t\nwords and words"),
    ("<p>a <a href=1>link</a> in words</p><ul><li>item <a href=2>one</a></li></ul>", "a link in words\nitem one"), ("<b>a<i>b", "ab"), ("<p>&amp;lt;</p>", "&lt;"),
    ("<div class='no-sidebar'><p>the article, which is long</p><div class=sidebar>side</div></div><div class=ad>ad</div>", "the article, which is long"),
    ("<div class=story><p>a short article</p></div><div class=comments><p>what readers write is longer than that</p></div>", "a short article"),
    ("<main hidden><p>x</p></main><div><p>seen</p></div>", "x\nseen"),
])
def test_small_pages(html, text):
    page = Page(html)
    assert page.text(page.chosen({})) == text


def test_awkward_rows(spark, made, nothing):
    rows = made[0][:3] + [(None, None, None), (1000, None, "<p>words</p>"), (1001, "not a url", ""), (1002, "https://plain.example/", None), made[0][0]]
    rows.append((1003, "https://plain.example/long", "<article>" + "<p>long</p>" * 200_000 + "</article>"))
    got = sorted(((r.page_id, r.url, r.n_chars, r.text) for r in host_paths.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    assert len(got) == len(rows)
    assert [r[2:] for r in got if r[0] in (None, 1001, 1002)] == [(0, "")] * 3
    assert [r[3] for r in got if r[0] == 1000] == ["words"]
    assert [r[2] for r in got if r[0] == 1003] == [5 * 200_000 - 1]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert host_paths.extract(empty).collect() == []


def test_deep_pages():
    page = Page("<div>" * 5000 + "deep words" + "</div>" * 5000)
    assert page.text(page.chosen({})) == "deep words"
