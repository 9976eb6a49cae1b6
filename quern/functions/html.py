"""HTML to title, text, markdown and links, in one Arrow pass. Only the standard library's tolerant parser is used.

Defined results: null or unparsable markup gives nulls and no links; unclosed elements end with the document."""

from __future__ import annotations

import re
from collections.abc import Generator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import vocab

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style"))
_BLOCKS = frozenset(
    "p div section article main header footer nav aside ul ol table tr form blockquote address h1 h2 h3 h4 h5 h6 body html dl dt dd pre hr li".split()
)
_MAIN = re.compile("content|main|body", re.I)
LEAST_CHARS = 50


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self, dropped: frozenset[str] = frozenset()):
        """Texts below, in document order, without dropped elements."""
        stack: list = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in dropped:
                stack.extend(reversed(x.children))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "dt", "dd", "tr", "td", "option") and self.at.tag == tag:
            self.at = self.at.parent
        elif tag in _BLOCKS and self.at.tag == "p":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(markup: str) -> Node:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


def title_of(root: Node) -> str | None:
    nodes = list(root.walk())
    for n in nodes:
        if n.tag == "title":
            if len(n.children) == 1 and isinstance(n.children[0], str) and n.children[0]:
                return n.children[0].strip()
            break
    for n in nodes:
        if n.tag == "h1":
            return "".join(s.strip() for s in n.strings())
    for key, value in (("name", "title"), ("property", "og:title")):
        for n in nodes:
            if n.tag == "meta" and n.attrs.get(key) == value and n.attrs.get("content"):
                return n.attrs["content"].strip()
    return None


def _container(root: Node, dropped: frozenset[str], by_id: bool) -> Node:
    alive: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        alive.append(n)
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and c.tag not in dropped)
    body = next((n for n in alive if n.tag == "body"), root)
    first = lambda test: next((n for n in alive if test(n)), None)
    found = first(lambda n: n.tag == "main") or first(lambda n: n.tag == "article") or first(
        lambda n: n.tag == "div" and any(_MAIN.search(c) for c in n.attrs.get("class", "").split())
    )
    found = found or (by_id and first(lambda n: n.tag == "div" and _MAIN.search(n.attrs.get("id", "")))) or body
    return found if any(s.strip() for s in found.strings(dropped)) else body


def clean_text_of(root: Node) -> str | None:
    dropped = frozenset(vocab.DROPPED_ELEMENTS)
    parts = [s.strip() for s in _container(root, dropped, True).strings(dropped)]
    text = re.sub(r"\s+", " ", " ".join(p for p in parts if p)).strip()
    return text if len(text) > LEAST_CHARS else None


def _walked(step: Generator):
    """What a recursive walk returns that yields each of its inner walks; its stack is a list, so nesting has no limit."""
    stack, value = [step], None
    while stack:
        try:
            inner = stack[-1].send(value)
        except StopIteration as e:
            stack.pop()
            value = e.value
        else:
            stack.append(inner)
            value = None
    return value


def _inline(node: Node, dropped: frozenset[str]) -> Generator:
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag in dropped:
            continue
        elif c.tag == "br":
            out.append("  \n")
        elif c.tag == "img":
            out.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})")
        elif c.tag == "a" and c.attrs.get("href"):
            inner = yield _inline(c, dropped)
            out.append(f"[{inner.strip()}]({c.attrs['href']})")
        else:
            inner = yield _inline(c, dropped)
            mark = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`"}.get(c.tag, "")
            out.append(f"{mark}{inner.strip()}{mark}" if mark and inner.strip() else inner)
    return "".join(out)


def _blocks(node: Node, dropped: frozenset[str], depth: int, out: list[str]) -> Generator:
    run: list = []

    def flush() -> Generator:
        if run:
            text = (yield _inline(_wrap(run), dropped)).strip()
            run.clear()
            if text:
                out.append(text)

    for c in node.children:
        if isinstance(c, str) or c.tag not in _BLOCKS:
            run.append(c)
            continue
        yield from flush()
        if c.tag in dropped:
            continue
        if c.tag[0] == "h" and c.tag[1:].isdigit():
            text = (yield _inline(c, dropped)).strip()
            if text:
                out.append("#" * int(c.tag[1]) + " " + text)
        elif c.tag == "hr":
            out.append("---")
        elif c.tag in ("ul", "ol"):
            items = []
            for no, li in enumerate((x for x in c.children if isinstance(x, Node) and x.tag == "li"), 1):
                inner: list[str] = []
                yield _blocks(li, dropped, depth + 1, inner)
                if inner:
                    items.append("  " * (depth + 1) + ("* " if c.tag == "ul" else f"{no}. ") + "\n".join(inner))
            if items:
                out.append("\n".join(items))
        elif c.tag == "blockquote":
            inner = []
            yield _blocks(c, dropped, depth, inner)
            out.extend("> " + x for x in inner)
        else:
            yield _blocks(c, dropped, depth, out)
    yield from flush()


def _wrap(children: list) -> Node:
    node = Node("#run", {}, None)
    node.children = children
    return node


def markdown_of(root: Node) -> str | None:
    dropped = frozenset(vocab.DROPPED_ELEMENTS[:10])
    out: list[str] = []
    _walked(_blocks(_wrap([_container(root, dropped, False)]), dropped, 0, out))
    text = re.sub(r"\n\s*\n\s*\n+", "\n\n", "\n\n".join(out)).strip()
    return text if len(text) > LEAST_CHARS else None


def links_of(root: Node) -> list[str]:
    return [n.attrs["href"].strip() for n in root.walk() if n.tag == "a" and n.attrs.get("href", "").strip()]


class _Hrefs(HTMLParser):
    """The addresses of anchors alone, without a tree."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = (dict(attrs).get("href") or "").strip()
            if href:
                self.found.append(href)

    handle_startendtag = handle_starttag


def hrefs_in(markup: str) -> list[str]:
    parser = _Hrefs()
    try:
        parser.feed(markup)
        parser.close()
    except (ValueError, AssertionError):
        pass
    return parser.found


def _links(markup: pd.Series) -> pd.Series:
    return pd.Series([hrefs_in(m) if m else [] for m in markup])


#: Array of a page's links. Marked as not deterministic so that the filter an ``explode`` implies does not parse the page again.
links_in = F.pandas_udf(_links, T.ArrayType(T.StringType())).asNondeterministic()


def _title(markup: pd.Series) -> pd.Series:
    def one(m):
        try:
            return title_of(parse(m)) if m else None
        except (ValueError, AssertionError):
            return None

    return markup.map(one)


#: The title of a page, without its text, markdown and links.
title_in = F.pandas_udf(_title, T.StringType())


def with_links(pages: DataFrame, markup: str = "html_content", name: str = "href") -> DataFrame:
    """A row for each link of each page, repeats kept; the markup is read once and not carried on."""
    rest = [c for c in pages.columns if c != markup]
    return pages.where(F.col(markup).isNotNull()).select(*rest, links_in(F.col(markup)).alias("_quern_links")).select(
        *rest, F.explode("_quern_links").alias(name)
    )


SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("clean_text", T.StringType()),
        T.StructField("markdown", T.StringType()),
        T.StructField("links", T.ArrayType(T.StringType())),
    ]
)


@F.pandas_udf(SCHEMA)
def parsed(markup: pd.Series) -> pd.DataFrame:
    rows = []
    for m in markup:
        try:
            root = parse(m) if m else None
            rows.append(
                (title_of(root), clean_text_of(root), markdown_of(root), links_of(root)) if root is not None else (None, None, None, [])
            )
        except (ValueError, AssertionError, RecursionError):
            rows.append((None, None, None, []))
    return pd.DataFrame(rows, columns=["title", "clean_text", "markdown", "links"])


def with_extraction(pages: DataFrame, markup: str = "html_content", prefix: str = "x_") -> DataFrame:
    """``pages`` with title, clean text, markdown and links of ``markup``, each prefixed; the markup is parsed once."""
    out = pages.withColumn("_quern_parsed", parsed(F.col(markup)))
    for name in ("title", "clean_text", "markdown", "links"):
        out = out.withColumn(prefix + name, F.col(f"_quern_parsed.{name}"))
    return out.drop("_quern_parsed")


def rendered_text(markdown: Column, rendered: Column, browser: Column) -> Column:
    """The rendered page's markdown where a browser fetched it, else the extracted one."""
    return F.when(browser & rendered.isNotNull() & (rendered != ""), rendered).otherwise(markdown)
