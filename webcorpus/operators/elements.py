"""The element table of HTML pages.

The one place where pages meet Python: a generator over Arrow batches that turns each
page into rows. Everything downstream is relational.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body div dd dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav header footer aside form".split())
SILENT = frozenset("script style noscript template title head".split())
# A start tag in the value set ends an open element of the key.
IMPLIED_END = {
    "p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
SCOPES = frozenset({"table", "ul", "ol", "dl", "select", "div", "section", "article", "body", "html"})

_LINEAGE = T.ArrayType(
    T.StructType([
        T.StructField("tag", T.StringType()), T.StructField("el_id", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
    ])
)
ELEMENT_FIELDS = [
    T.StructField("el", T.IntegerType()), T.StructField("parent", T.IntegerType()),
    T.StructField("tag", T.StringType()), T.StructField("el_id", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()), T.StructField("block", T.IntegerType()),
    T.StructField("block_tag", T.StringType()), T.StructField("media", T.IntegerType()),
    T.StructField("media_tag", T.StringType()), T.StructField("in_link", T.BooleanType()),
    T.StructField("boilerplate", T.BooleanType()), T.StructField("silent", T.BooleanType()),
    T.StructField("lineage", _LINEAGE),
]
HEAD_CHARS = 120
# A tag that needs no more than this to be read: a name and quoted attributes, one blank or more before each.
PLAIN_TAG = re.compile(r'<(/?)([a-zA-Z][a-zA-Z0-9]*)((?: +[a-zA-Z][a-zA-Z0-9_-]*="[^"]*")*) *(/?)>')
PLAIN_ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9_-]*)="([^"]*)"')
# The parser reads what follows these otherwise than as markup.
RAW_TEXT = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp".split())


class Element:
    """An element or a text run of a page."""

    __slots__ = ("el", "up", "tag", "attrs", "start", "end", "block", "block_tag", "media", "media_tag", "in_link", "boilerplate", "silent")

    def __init__(self, el: int, up: Element | None, tag: str, attrs: dict[str, str], start: int):
        self.el, self.up, self.tag, self.attrs, self.start, self.end = el, up, tag, attrs, start, start
        if up is None:
            self.block = self.block_tag = self.media = self.media_tag = None
            self.in_link = self.boilerplate = self.silent = False
        else:
            self.block, self.block_tag, self.media, self.media_tag = up.block, up.block_tag, up.media, up.media_tag
            self.in_link, self.boilerplate, self.silent = up.in_link, up.boilerplate, up.silent
        if tag in BLOCKS:
            self.block, self.block_tag = el, tag
        elif tag in ("video", "audio"):
            self.media, self.media_tag = el, tag
        elif tag == "a":
            self.in_link = True
        if tag in BOILERPLATE:
            self.boilerplate = True
        elif tag in SILENT:
            self.silent = True

    @property
    def parent(self) -> int | None:
        return self.up and self.up.el

    @property
    def el_id(self) -> str:
        return self.attrs.get("id", "")

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    @property
    def lineage(self) -> list[dict]:
        chain, up = [], self.up
        while up is not None:
            chain.append({"tag": up.tag, "el_id": up.el_id, "classes": up.classes})
            up = up.up
        return chain[::-1]


class Tree(HTMLParser):
    """Elements of one page in document order; those of ``tags`` are listed, and unless unwanted text runs."""

    def __init__(self, tags: frozenset[str] | None = None, runs: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[Element] = []
        self.open: list[Element] = []
        self.text: list[str] = []
        self.length = self.count = 0
        self.tags, self.runs = tags, runs

    def _row(self, tag: str, attrs: dict[str, str]) -> Element:
        row = Element(self.count, self.open[-1] if self.open else None, tag, attrs, self.length)
        self.count += 1
        if self.tags is None or tag in self.tags:
            self.rows.append(row)
        return row

    def _close(self, row: Element | None) -> None:
        while self.open:
            last = self.open.pop()
            last.end = self.length
            if last is row:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for row in reversed(self.open):
            if tag in IMPLIED_END.get(row.tag, ()):
                self._close(row)
                break
            if row.tag in SCOPES:
                break
        first: dict[str, str] = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        row = self._row(tag, first)
        if tag not in VOID:
            self.open.append(row)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for row in reversed(self.open):
            if row.tag == tag:
                self._close(row)
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        self.length += len(data)
        if self.runs:
            row = self._row("#text", {})
            row.start, row.end = self.length - len(data), self.length
        else:
            self.count += 1

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines are not counted

    def _read_plain(self, html: str) -> bool:
        """Read a page of plain tags without references; False, and nothing read, if it holds anything else."""
        if "&" in html:
            return False
        parts = PLAIN_TAG.split(html)  # text, then five for each tag: end, name, attributes, empty, text
        texts, names = parts[::5], [name.lower() for name in parts[2::5]]
        if any("<" in text for text in texts) or not RAW_TEXT.isdisjoint(names):
            return False
        tags = list(zip(parts[1::5], names, parts[3::5], parts[4::5], texts[1:]))
        if any(end and (attrs or empty) for end, _, attrs, empty, _ in tags):
            return False
        if texts[0]:
            self.handle_data(texts[0])
        for end, name, attrs, empty, text in tags:
            if end:
                self.handle_endtag(name)
            else:
                found = [(k.lower(), v) for k, v in PLAIN_ATTRIBUTE.findall(attrs)] if attrs else []
                (self.handle_startendtag if empty else self.handle_starttag)(name, found)
            if text:
                self.handle_data(text)
        return True

    def read(self, html: str | None) -> Tree:
        if not self._read_plain(html or ""):
            self.feed(html or "")
            self.close()
        self._close(None)
        return self


class _Blocks(Tree):
    """The text blocks of one page: what stands in one block element, without what is in blocks inside it."""

    def __init__(self) -> None:
        super().__init__(frozenset())
        self.found: dict[int, list] = {}

    def handle_data(self, data: str) -> None:
        above = self.open[-1] if self.open else None
        self.count += 1
        if above is None:
            self.found.setdefault(-1, [None, False, 0, []])[3].append(data)
        elif not above.silent:
            block = self.found.setdefault(-1 if above.block is None else above.block, [above.block_tag, False, 0, []])
            block[1] |= above.boilerplate
            if above.in_link:
                block[2] += len(" ".join(data.split()))
            block[3].append(data)


BLOCK = T.StructType([
    T.StructField("tag", T.StringType()), T.StructField("boilerplate", T.BooleanType()),
    T.StructField("link_chars", T.IntegerType()), T.StructField("text", T.StringType()),
])


def page_blocks(html: str | None) -> list[tuple]:
    """(tag, boilerplate, link characters, text) of each block with text, in document order."""
    found = _Blocks().read(html).found
    lines = ((tag, boilerplate, linked, " ".join("".join(runs).split())) for _, (tag, boilerplate, linked, runs) in sorted(found.items()))
    return [line for line in lines if line[3]]


def text_blocks(pages: DataFrame, html: str = "html", name: str = "blocks") -> DataFrame:
    """Every page's other columns and ``name``, the array of its text blocks in document order."""
    keys = [c for c in pages.columns if c != html]
    schema = T.StructType([*[pages.schema[c] for c in keys], T.StructField(name, T.ArrayType(BLOCK))])
    kind = to_arrow_schema(schema).field(name).type
    block = to_arrow_schema(BLOCK)

    def packed(pages: list[list[tuple]]) -> pa.Array:
        columns = zip(*(line for page in pages for line in page)) if any(pages) else [()] * len(block)
        lines = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, block)], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, pages))], pa.int32()), lines).cast(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                blocks = packed([page_blocks(page) for page in part.column(html).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], blocks], names=[*keys, name])

    return pages.select(*keys, html).mapInArrow(read, schema)


def arrow_rows(
    expand: Callable[[dict], Iterable[tuple]], schema: T.StructType, chunk: int = 4096
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow body that turns each input row into output tuples in schema order."""
    target = to_arrow_schema(schema)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), target)]
        return pa.RecordBatch.from_arrays(columns, schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        for batch in batches:
            for index in range(batch.num_rows):
                source = {n: batch.column(n)[index].as_py() for n in batch.schema.names}
                for row in expand(source):
                    ready.append(row)
                    if len(ready) == chunk:
                        yield packed(ready)
                        ready = []
        if ready:
            yield packed(ready)

    return run


def _text(row: Element, body: str, text: str) -> str:
    content = body[row.start:row.end]
    return content if text == "full" or row.tag == "#text" else content.strip()[:HEAD_CHARS]


def page_elements(html: str | None, columns: Sequence[str], tags: frozenset[str] | None = None, text: str = "head") -> Iterator[tuple]:
    """The named columns of a page's elements; nothing else is made."""
    tree = Tree(tags).read(html)
    body = "".join(tree.text) if "text" in columns else ""
    for row in tree.rows:
        yield tuple(
            _text(row, body, text) if name == "text" else list(row.attrs.items()) if name == "attrs" else getattr(row, name)
            for name in columns
        )


def html_elements(
    pages: DataFrame, html: str = "html", text: str = "head", columns: Sequence[str] | None = None, tags: Sequence[str] | None = None,
) -> DataFrame:
    """Element rows of every page: the page's other columns plus the element columns.

    ``columns`` names the element columns that are made (all but ``lineage`` if not given) and ``tags`` the
    tags that get a row (all, and text runs as ``#text``). ``el`` is the document position, counted over
    everything on the page. An element's ``text`` is its trimmed beginning, or all of its content with
    ``text="full"``. ``lineage`` is the chain of ancestors that descendant selectors need.
    """
    keys = [c for c in pages.columns if c != html]
    wanted = [f.name for f in ELEMENT_FIELDS if f.name in columns] if columns else [f.name for f in ELEMENT_FIELDS if f.name != "lineage"]
    schema = T.StructType([pages.schema[c] for c in keys] + [f for f in ELEMENT_FIELDS if f.name in wanted])
    only = None if tags is None else frozenset(tags)

    def rows(page: dict) -> Iterator[tuple]:
        mine = tuple(page[key] for key in keys)
        for row in page_elements(page[html], wanted, only, text):
            yield mine + row

    return pages.select(*keys, html).mapInArrow(arrow_rows(rows, schema), schema)
