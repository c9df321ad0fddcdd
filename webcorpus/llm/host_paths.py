"""The main text of web pages, by the paths that the pages of a host agree on.

Each page's containers are scored by the prose below them and the best one votes for its generalised
path: the tags and classes from the root down, numbers made alike. Spark counts the votes per host and
path. Pages are then read again: among a page's good containers the one whose path has most votes on its
host gives the text, so a page with a long notice or few words follows the others; a page with none of
the host's paths keeps its own best container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.functions.urls import url_host
from webcorpus.llm.batches import by_bytes
from webcorpus.llm.scratch import Scratch
from webcorpus.operators.elements import BLOCKS, IMPLIED_END, SCOPES, VOID

SLICE_BYTES = 4 << 20
GOOD = 0.1  # share of the best container's score from which on a container may be chosen
CONSENSUS = 0.01  # share of a host's votes from which on a path counts
FADE = 0.9  # what a container's score keeps on the way to the next one around it
TITLE = 1.25  # factor for a container that holds the page's title heading
MENU = 3  # so many links alone in a list make a menu

BREAKING = BLOCKS | {"blockquote", "caption", "center", "details", "legend", "optgroup", "option", "summary", "title"}
CONTAINERS = frozenset("article body center div form main section table td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu".split())
#: Never part of an article. ``header`` keeps its headings inside an article, ``form`` may wrap a whole page.
UNWANTED = frozenset(
    "aside audio button canvas datalist dialog embed footer form head header iframe input label legend map math menu nav noscript "
    "object option script select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class names and ids that mark what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement advertisements advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright discussion disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice "
    "notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Those of them that may mark most of a page all the same: readers can write more than the author.
READERS = frozenset("comment comments discussion disqus replies reply respond".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")


class Page(HTMLParser):
    """Elements and text pieces of one page, then its containers and their text."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.parents = ["#root"], [{}], [0]
        self.pieces: list[tuple[int, int, bool, str]] = []  # block, element, in a link, text
        self._open, self._block, self._links = [0], 0, 0
        self.feed(html)
        self.close()
        self._judge()

    # -- reading

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for spot in range(len(self._open) - 1, 0, -1):
            above = self.tags[self._open[spot]]
            if tag in IMPLIED_END.get(above, ()):
                self._close(spot)
                break
            if above in SCOPES:
                break
        if tag == "br":
            self.pieces.append((self._block, self._open[-1], False, " "))
        if tag in VOID:
            self._block += tag == "hr"
            return
        self.tags.append(tag)
        self.attrs.append(dict(reversed(attrs)) if attrs else {})
        self.parents.append(self._open[-1])
        self._open.append(len(self.tags) - 1)
        self._links += tag == "a"
        self._block += tag in BREAKING

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "path", "svg"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for spot in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[spot]] == tag:
                self._close(spot)
                return
        if tag == "p":
            self._block += 1

    def _close(self, spot: int) -> None:
        for element in self._open[spot:]:
            self._links -= self.tags[element] == "a"
            self._block += self.tags[element] in BREAKING
        del self._open[spot:]

    def handle_data(self, data: str) -> None:
        self.pieces.append((self._block, self._open[-1], self._links > 0, data))

    # -- judging

    def _marks(self, element: int) -> set[str]:
        """What says that an element is not the article: words of its class and id, or that it is hidden."""
        attrs = self.attrs[element]
        if not attrs:
            return set()
        style = (attrs.get("style") or "").replace(" ", "").lower()
        if "hidden" in attrs or "display:none" in style or (attrs.get("aria-hidden") or "").lower() == "true":
            return {"hidden"}
        if (attrs.get("role") or "").lower() in ROLES:
            return {"role"}
        return {w.lower() for name in ("class", "id") for w in _WORD.findall(attrs.get(name) or "")} & MARKS

    def _chars(self) -> list[int]:
        """Characters of text below each element, without what is in unwanted tags."""
        n = len(self.tags)
        out, chars = [False] * n, [0] * n
        for e in range(1, n):
            out[e] = out[self.parents[e]] or self.tags[e] in UNWANTED and self.tags[e] != "form"
        for _, element, _, text in self.pieces:
            if not out[element]:
                chars[element] += len(text.strip())
        for e in range(n - 1, 0, -1):
            chars[self.parents[e]] += chars[e]
        return chars

    def _judge(self) -> None:
        """Which elements are not part of any article, and the score of each container."""
        tags, parents, n = self.tags, self.parents, len(self.tags)
        marks = [self._marks(e) for e in range(n)]
        chars = self._chars() if any(marks) else [0] * n
        # A wrapper that is named after a side bar it has, or has not, holds most of the page.
        marked = [bool(m) and (2 * chars[e] <= chars[0] or bool(m & (READERS | {"hidden", "role"}))) for e, m in enumerate(marks)]
        core = [tags[e] in ("h1", "main") or tags[e] == "article" and not marked[e] or (self.attrs[e].get("role") or "") == "main" for e in range(n)]
        for e in range(n - 1, 0, -1):
            core[parents[e]] |= core[e]
        within, self.gone, self.titles = [False] * n, [False] * n, [False] * n
        for e in range(1, n):
            tag, up = tags[e], parents[e]
            within[e] = within[up] or tag in ("article", "main")
            out = tag in UNWANTED and not (tag == "form" and core[e]) or marked[e] and tag not in ("body", "html", "main") and not core[e]
            # The headings of an article's own header stay.
            title = tag == "header" and within[up] and not self.gone[up]
            self.titles[e] = title or self.titles[up] and tag not in HEADINGS
            self.gone[e] = (self.gone[up] and not (self.titles[up] and tag in HEADINGS)) or out or title
        self._drop_menus()
        self.blocks: list[tuple[int, str]] = []  # element and text, in page order
        scores, points = [0.0] * n, [0.0] * n
        first = 0
        while first < len(self.pieces):
            last = first
            while last < len(self.pieces) and self.pieces[last][0] == self.pieces[first][0]:
                last += 1
            kept = [p for p in self.pieces[first:last] if not self.gone[p[1]]]
            text = " ".join("".join(p[3] for p in kept).split())
            if text:
                linked = sum(len(" ".join(p[3].split())) for p in kept if p[2])
                element = next(p[1] for p in kept if p[3].strip())
                self.blocks.append((element, text))
                points[element] += len(text) - linked if 2 * linked <= len(text) else -3 * linked
            first = last
        titled = [tags[e] == "h1" and not self.gone[e] for e in range(n)]
        for e in range(n - 1, -1, -1):
            if tags[e] in CONTAINERS or e == 0:
                scores[e] = points[e] * (TITLE if titled[e] else 1.0)
                points[parents[e]] += points[e] * FADE if e else 0.0
            elif e:
                points[parents[e]] += points[e]
            if e:
                titled[parents[e]] |= titled[e]
        self.scores = {e: s for e, s in enumerate(scores) if s > 0 and not self.gone[e]}

    def _drop_menus(self) -> None:
        """Lists of links alone are menus, however they are marked."""
        plain, linked = {}, {}
        for _, element, in_link, text in self.pieces:
            if not self.gone[element] and text.strip():
                side = linked if in_link else plain
                while element and self.tags[element] not in LISTS:
                    element = self.parents[element]
                side[element] = side.get(element, 0) + 1
        menus = {e for e, k in linked.items() if e and k >= MENU and e not in plain}
        if menus:
            for e in range(1, len(self.tags)):
                self.gone[e] |= e in menus or self.gone[self.parents[e]] and not self.titles[self.parents[e]]

    # -- choosing

    def path(self, element: int) -> str:
        """Tags and classes of the containers from the root to ``element``, numbers made alike."""
        steps = []
        while element:
            if self.tags[element] in CONTAINERS:
                classes = {_DIGITS.sub("0", c.lower()) for c in (self.attrs[element].get("class") or "").split()}
                steps.append(".".join([self.tags[element], *sorted(classes)]))
            element = self.parents[element]
        return ">".join(reversed(steps))

    def best(self) -> int | None:
        return max(self.scores, key=lambda e: (self.scores[e], -e), default=None)

    def chosen(self, votes: dict[str, int]) -> int | None:
        """The good container with most votes for its path, the highest score among those."""
        best = self.best()
        if best is None:
            return None
        good = [e for e, s in self.scores.items() if s >= GOOD * self.scores[best]]
        return max(good, key=lambda e: (votes.get(self.path(e), 0), self.scores[e], -e))

    def text(self, container: int | None) -> str:
        if container is None:
            return ""
        inside = [False] * len(self.tags)
        for e in range(container, len(self.tags)):
            inside[e] = e == container or inside[self.parents[e]]
        return "\n".join(text for element, text in self.blocks if inside[element])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``host, path``: where each page finds its article. Pages without text do not vote."""
    for batch in by_bytes(batches, "html", SLICE_BYTES):
        hosts, paths = [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
            page = Page(html.as_py())
            best = page.best()
            if best is not None:
                hosts.append(host)
                paths.append(page.path(best))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], names=["host", "path"])


def host_paths(pages: DataFrame, consensus: float = CONSENSUS) -> DataFrame:
    """``host`` and ``votes`` (path -> pages) of every host.

    Paths with less than ``consensus`` of a host's votes are left out: their pages agree with too few
    others, so each goes by its own scores. A host has at most ``1 / consensus`` paths.
    """
    cast = pages.select(url_host("url").alias("host"), "html").filter(F.col("host").isNotNull() & F.col("html").isNotNull())
    counted = cast.mapInArrow(_votes, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("n"))
    total = counted.groupBy("host").agg(F.sum("n").alias("total"))
    agreed = counted.join(total, "host").filter(F.col("n") >= F.col("total") * consensus)
    return agreed.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "n"))).alias("votes"))


def extract(pages: DataFrame, consensus: float = CONSENSUS) -> DataFrame:
    """``page_id``, ``url``, ``text`` (the article's blocks, one a line) and ``n_chars`` of every page.

    Navigation, headers, footers, asides, forms, scripts, styles, hidden elements, lists of links alone
    and elements whose class or id names a menu, side bar, notice, advert or comments go; everything else
    in the chosen container stays. Character references are decoded, white space inside a block
    becomes one space. A null or empty page, and one without such text, gives an empty text; a null url
    has no host and the page goes by its own scores. Repeated rows come back as often; an empty table
    gives none. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession)
    agreed = scratch.keep(host_paths(pages, consensus), free=False)
    # The written table is small unless there are very many hosts; Spark broadcasts it by its size or else
    # joins by host and splits the partitions of large ones.
    joined = pages.select("page_id", "url", "html", url_host("url").alias("host")).join(agreed, "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html", SLICE_BYTES):
            texts = []
            for votes, html in zip(batch.column("votes").to_pylist(), batch.column("html")):
                page = Page(html.as_py() or "")
                texts.append(page.text(page.chosen(dict(votes or ()))))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "votes", "html").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
