"""Reading HTML pages and feeds with the standard library: titles, dates, breadcrumbs, links, Markdown body."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements, ids and classes that hold no content.
NOISE_TAGS = {"nav", "header", "footer", "aside", "script", "style", "noscript", "form", "button", "svg", "figure"}
NOISE_IDS = {"band-nav", "ms-banner", "uhf-header", "uhf-footer", "locale-selector"}
NOISE_CLASSES = {
    "breadcrumb", "feedback-section", "is-hidden-mobile", "action-container", "doc-feedback", "contribution", "page-action-holder",
    "learn-header", "learn-footer", "toc-toggle",
}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "source", "wbr"}
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class Element:
    def __init__(self, name: str, attrs: dict[str, str], parent: Element | None):
        self.name, self.attrs, self.parent, self.items = name, attrs, parent, []

    def find(self, test) -> Iterator[Element]:  # noqa: ANN001
        """Elements below that meet ``test``, in document order; of any depth."""
        stack = list(reversed(self.items))
        while stack:
            c = stack.pop()
            if isinstance(c, Element):
                if test(c):
                    yield c
                stack.extend(reversed(c.items))

    def text(self) -> str:
        """Words of all texts below, one blank between them."""
        out, stack = [], list(reversed(self.items))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out += c.split()
            else:
                stack.extend(reversed(c.items))
        return " ".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.root = self.at = Element("root", {}, None)

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        while self.at.name in _CLOSES.get(tag, ()) and self.at.parent:
            self.at = self.at.parent
        node = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        node = self.at
        while node.parent and node.name != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):  # noqa: ANN001, ANN201
        self.at.items.append(data)


def tree(html: str) -> Element:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _named(*names: str):  # noqa: ANN202
    return lambda e: e.name in names


def _first(root: Element, *tests) -> Element | None:  # noqa: ANN002
    for t in tests:
        if (found := next(root.find(t), None)) is not None:
            return found
    return None


def title(root: Element) -> str:
    """First h1, else og:title, else the title element up to its last separator."""
    if (h := _first(root, _named("h1"))) is not None and h.text():
        return h.text()
    if og := _first(root, lambda e: e.name == "meta" and e.attrs.get("property") == "og:title"):
        return og.attrs.get("content", "").strip()
    t = _first(root, _named("title"))
    return re.sub(r"\s+[|-]\s+[^|-]*$", "", t.text()) if t else ""


def published(root: Element) -> str | None:
    """time[datetime], else the date metas."""
    if t := _first(root, lambda e: e.name == "time" and e.attrs.get("datetime")):
        return t.attrs["datetime"]
    for name in ("ms.date", "date", "article:published_time"):
        if m := _first(root, lambda e, n=name: e.name == "meta" and n in (e.attrs.get("name"), e.attrs.get("property"))):
            return m.attrs.get("content")
    return None


def breadcrumb(root: Element) -> list[str]:
    """Names of a JSON-LD BreadcrumbList, else the links of a breadcrumb navigation."""
    for s in root.find(lambda e: e.name == "script" and e.attrs.get("type") == "application/ld+json"):
        try:
            data = json.loads("".join(c for c in s.items if isinstance(c, str)))
        except ValueError:
            continue
        for d in data if isinstance(data, list) else [data]:
            if isinstance(d, dict) and d.get("@type") == "BreadcrumbList":
                return [i["name"].strip() for i in d.get("itemListElement", []) if isinstance(i, dict) and i.get("name")]
    nav = _first(root, lambda e: e.name == "nav" and "breadcrumb" in e.attrs.get("aria-label", "").lower(), lambda e: e.name == "ol" and "breadcrumb" in e.attrs.get("class", ""))
    return [a.text() for a in nav.find(_named("a", "li")) if a.text()] if nav else []


def links(root: Element, base: str) -> list[str]:
    """Absolute http(s) targets without query and fragment, each once, in order."""
    out: dict[str, None] = {}
    for a in root.find(_named("a")):
        href = a.attrs.get("href", "").strip()
        if href and not href.startswith(("#", "mailto:", "javascript:")):
            u = urlparse(urljoin(base, href))
            if u.scheme in ("http", "https"):
                out.setdefault(f"{u.scheme}://{u.netloc}{u.path.rstrip('/') or '/'}")
    return list(out)


def _noise(e: Element) -> bool:
    return e.name in NOISE_TAGS or e.attrs.get("id") in NOISE_IDS or bool(set(e.attrs.get("class", "").split()) & NOISE_CLASSES)


#: Marks put around the text of an inline element.
_MARKS = {"code": "`", "strong": "**", "b": "**", "em": "*", "i": "*"}
_BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "blockquote", "main"}


def _marked(name: str, inner: str) -> str:
    """What an element makes of the markdown of its content."""
    text = inner.strip()
    if re.fullmatch("h[1-6]", name):
        return f"\n\n{'#' * int(name[1])} {text}\n\n"
    if name in _MARKS:
        return f"{_MARKS[name]}{text}{_MARKS[name]}" if text else ""
    if name == "li":
        return f"\n- {text}"
    if name in ("td", "th"):
        return f" {text} |"
    if name == "tr":
        return f"\n|{inner.rstrip()}"
    return f"\n\n{text}\n\n" if name in _BLOCKS else inner


def markdown(e: Element) -> str:
    """Markdown of an element: headings, paragraphs, lists, code, emphasis, tables; links become their text.

    Open elements lie on a stack with the texts gathered for them, so pages of any depth are written.
    """
    stack: list[tuple[str, Iterator, list[str]]] = [("", iter(e.items), [])]
    while True:
        name, rest, out = stack[-1]
        c = next(rest, None)
        if c is None:
            stack.pop()
            if not stack:
                break
            stack[-1][2].append(_marked(name, "".join(out)))
        elif isinstance(c, str):
            if name != "tr":
                out.append(re.sub(r"\s+", " ", c))
        elif _noise(c):
            continue
        elif c.name == "pre":
            raw = "".join(x if isinstance(x, str) else "".join(y for y in x.items if isinstance(y, str)) for x in c.items)
            out.append(f"\n\n```\n{raw.strip()}\n```\n\n")
        elif c.name in ("br", "hr"):
            out.append("\n" if c.name == "br" else "\n\n---\n\n")
        else:
            stack.append((c.name, iter(c.items), []))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n(?: +(?=\n))?", "\n", "".join(out))).strip()


def body(root: Element) -> str:
    """Markdown of the main element, without its h1."""
    main = _first(root, _named("main"), lambda e: e.name == "div" and e.attrs.get("id") == "main-content", _named("article"), lambda e: e.name == "div" and re.search("content|article|doc", e.attrs.get("class", ""), re.I), _named("body")) or root
    if (h := _first(main, _named("h1"))) is not None:
        h.parent.items.remove(h)
    return markdown(main)


def parse_pages(df: DataFrame, url: str, html: str, least: int = 50) -> DataFrame:
    """(url, title, body, published, breadcrumb, links) of every page whose body has at least ``least`` characters."""
    schema = "url string, title string, body string, published string, breadcrumb array<string>, links array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u, h in zip(b[url], b[html]):
                try:
                    root = tree(h or "")
                    row = (u, title(root), None, published(root), breadcrumb(root), links(root, u or ""))
                    text = body(root)
                except Exception:  # noqa: BLE001  a page that can't be read has no row and stops no other
                    continue
                if len(text) >= least:
                    out.append((*row[:2], text, *row[3:]))
            yield pd.DataFrame(out, columns=["url", "title", "body", "published", "breadcrumb", "links"])

    return df.select(url, html).mapInPandas(run, schema)


def crawl(spark: SparkSession, pages: DataFrame, seeds: list[str], most: int, prefixes: list[str]) -> DataFrame:
    """Breadth-first reach over stored (url, links) pages: (url, depth), until nothing new or ``most`` pages.

    The frontier and the visited set stay DataFrames; a level is cut in the
    shared folder before the next one starts.
    """
    from ..session import cut

    inside = F.lit(False)
    for p in prefixes:
        inside = inside | F.col("url").startswith(p)
    front = spark.createDataFrame([(s, 0) for s in dict.fromkeys(seeds)], "url string, depth int")
    seen = front
    depth = 0
    while True:
        depth += 1
        step = pages.join(front.select("url"), "url", "left_semi").select(F.explode("links").alias("url")).where(inside).distinct()
        front = cut(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
        if seen.count() >= most:
            return seen


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files as rows; malformed items are kept out, missing elements are null."""
    schema = "title string, link string, description string, pubDate string, category array<string>, guid string"
    return spark.read.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").schema(schema).load(path)


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files in the columns of ``read_feed``; the link is that of the alternate page, else the first one, the date the publication, else the update."""
    link = "link array<struct<_href:string,_rel:string>>"
    text = "struct<_VALUE:string,_type:string>"
    schema = f"title {text}, {link}, summary {text}, content {text}, published string, updated string, category array<struct<_term:string>>, id string"
    rows = spark.read.format("xml").option("rowTag", "entry").option("mode", "DROPMALFORMED").schema(schema.replace("link array", "`link` array")).load(path)
    pages = F.filter("link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    href = F.coalesce(F.get(pages, 0)["_href"], F.get("link", 0)["_href"])
    terms = F.transform("category", lambda c: c["_term"])
    return rows.select(F.col("title._VALUE").alias("title"), href.alias("link"), F.coalesce("summary._VALUE", "content._VALUE").alias("description"), F.coalesce("published", "updated").alias("pubDate"), terms.alias("category"), F.col("id").alias("guid"))


def outbound(pages: DataFrame, hosts: list[str], prefixes: list[str], locale: str | None = None) -> DataFrame:
    """``pages`` (url, links) with only those links that lie on one of ``hosts`` below one of ``prefixes``, each once, in order.

    With ``locale`` (such as ``/en-us``) a link of any two-part locale, or of
    none, is written with that one first, so that translations meet.
    """
    def one(u):  # noqa: ANN001, ANN202
        return F.regexp_replace(u, r"^(https?://[^/]+)(?:/[a-zA-Z]{2}-[a-zA-Z]{2}(?=/|$))?", F.concat(F.lit("$1"), F.lit(locale))) if locale else u

    host = lambda u: F.lower(F.regexp_extract(u, r"^https?://([^/:?#]+)", 1))
    path = lambda u: F.regexp_extract(u, r"^https?://[^/]+([^?#]*)", 1)

    def inside(u):  # noqa: ANN001, ANN202
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | path(u).startswith(p)
        return host(u).isin([h.lower() for h in hosts]) & hit

    kept = F.array_distinct(F.filter(F.transform("links", one), inside))
    return pages.withColumn("links", F.coalesce(kept, F.array().cast("array<string>")))
