"""Clean text from HTML, Markdown, wiki and LaTeX markup, with headings, lists, code and formulas kept recognisable.

HTML is read into a tree.  Paragraphs pass points for length and commas to
their parents and grandparents, discounted by the share of link text; the best
container is kept, and of what lies beside it and its ancestors whatever has a
share of its points or reads like a paragraph; the rest is dropped.  Whether a
text holds HTML is told by what the parser met.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table

# Element names that make an angle bracket a tag.
TAGS = (
    "a abbr address article aside b blockquote body br button caption center cite code col dd del details div dl dt em embed "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark "
    "math meta nav noscript object ol option p picture pre q s samp script section select small source span strike strong style "
    "sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video"
).split()
VOID = {"br", "hr", "img", "input", "meta", "link", "col", "embed", "source"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figure", "footer", "form", "header", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul", "li", "h1", "h2", "h3", "h4", "h5", "h6", "caption", "figcaption", "html"}
SILENT = {"script", "style", "noscript", "head", "template"}
# LaTeX commands of text and formulas.
COMMANDS = (
    "begin end item section subsection subsubsection paragraph chapter title emph textbf textit texttt textsc underline cite citep citet ref eqref "
    "label footnote caption includegraphics usepackage documentclass url href frac sqrt sum prod int lim le leq ge geq ne neq alpha beta gamma delta "
    "epsilon lambda mu sigma theta omega pi infty cdot times pm left right mathbf mathrm mathcal text ldots dots approx equiv partial nabla in"
).split()

_NAME = "|".join(sorted(TAGS, key=len, reverse=True))
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([a-zA-Z][a-zA-Z0-9]{1,30}));")
_MARKDOWN = [
    re.compile(r"^ {0,3}#{1,6} +\S", re.M),
    re.compile(r"^[^\n]*\w[^\n]*\n *(?:={3,}|-{3,}) *$", re.M),
    re.compile(r"(?<![*\w])\*{2,4}(?=[^\s*])[^*\n]+(?<=[^\s*])\*{2,4}(?!\*)"),
    re.compile(r"(?<![\w*])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])"),
    re.compile(r"(?<![\w_])__(?=[^\s_])[^\n]*?(?<=[^\s_])__(?![\w_])"),
    re.compile(r"(?<![\w_])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_])"),
    re.compile(r"~~(?=\S)[^~\n]+~~"),
    re.compile(r"(?<!`)`[^`\n]+`(?!`)"),
    re.compile(r"^ *(?:```|~~~)", re.M),
    re.compile(r"!?\[[^\]\n]*\]\((?:[a-z]+://|/|#|mailto:)[^)\n]*\)?", re.I),
    re.compile(r"\[[^\]\n]+\]\[[^\]\n]*\]"),
    re.compile(r"^ {0,3}\[[^\]\n]+\]: +\S", re.M),
    re.compile(r"^ {0,3}> ?\S", re.M),
    re.compile(r"^ *\|.*\|[ \t]*\n *\|?[ :|-]*-[ :|-]*\|?[ \t]*$", re.M),
    re.compile(r"^ {0,3}[*+-] +\S[^\n]*\n(?:\s*\n)? {0,3}[*+-] +\S", re.M),
    re.compile(r"^ {0,3}\d{1,3}[.)] +\S[^\n]*\n(?:\s*\n)? {0,3}\d{1,3}[.)] +\S", re.M),
    re.compile(r"^ {0,3}[*+-] \[[ xX]\] ", re.M),
]
_WIKI = [
    re.compile(r"^ *(={1,6}) ?[^\s=](?:[^\n]*[^\s=])? ?\1 *$", re.M),
    re.compile(r"'{2,5}(?=[^'\s])[^'\n]+'{2,5}"),
    re.compile(r"\[\[[^\[\]\n]+\]\]"),
    re.compile(r"\[[a-z]+://[^\s\]]+(?: [^\]\n]*)?\]", re.I),
    re.compile(r"\{\{[^{}\n]+\}\}"),
    re.compile(r"^ *\{\|", re.M),
    re.compile(r"^[*#]{1,4} ?\S[^\n]*\n[*#]{1,4} ?\S", re.M),
]
_LATEX = [
    re.compile(rf"(?<![\w:\\])\\(?:{'|'.join(COMMANDS)})(?![a-zA-Z])|~\\(?:cite|ref)\b"),
    re.compile(r"\\\[(?:.|\n)*?(?:\\\]|$)|\\\((?:.|\n)*?\\\)"),
    re.compile(r"\$\$?[^$\n]*[\\^_{}=][^$\n]*\$"),
    re.compile(r"\$[a-zA-Z]\$"),
]


def kinds(text: str) -> list[str]:
    """Which of html, markdown, wiki and latex the text holds."""
    out = ["html"] if ("<" in text or "&" in text) and parsed(text).met else []
    for name, patterns in (("markdown", _MARKDOWN), ("wiki", _WIKI), ("latex", _LATEX)):
        if any(p.search(text) for p in patterns):
            out.append(name)
    return out


class Node:
    """An element; ``size`` and ``linked`` are the characters of its text and of those in links, once ``_measure`` has run."""

    __slots__ = ("name", "parent", "children", "points", "size", "linked")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.children, self.points, self.size, self.linked = name, parent, [], 0.0, 0, 0

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.name not in SILENT or c is self:
                stack.extend(reversed(c.children))
        return "".join(out)

    def density(self) -> float:
        return self.linked / self.size if self.size else 0.0


class _Tree(HTMLParser):
    """A forgiving tree builder: paragraphs, items, rows and cells close the open one of their kind; ``met`` counts tags, references and declarations."""

    CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.root = self.at = Node("root", None)
        self.open: dict[str, int] = {}
        self.met = 0

    def _leave(self) -> None:
        self.open[self.at.name] -= 1
        self.at = self.at.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.met += 1
        closes = self.CLOSES.get(tag, {"p"} if tag in BLOCK else set())
        while self.at.name in closes and self.at.parent:
            self._leave()
        if tag == "img":
            alt = dict(attrs).get("alt")
            if alt:
                self.at.children.append(alt)
            return
        node = Node(tag, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        self.met += 1
        if self.open.get(tag):
            while self.at.name != tag:
                self._leave()
            self._leave()

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def handle_charref(self, name: str) -> None:
        self.met += 1
        self.at.children.append(unescape(f"&#{name};"))

    def handle_entityref(self, name: str) -> None:
        known = f"{name};" in html5
        self.met += known
        self.at.children.append(unescape(f"&{name};") if known else f"&{name}")

    def handle_comment(self, data: str) -> None:
        self.met += 1

    def handle_decl(self, decl: str) -> None:
        self.met += 1

    def unknown_decl(self, data: str) -> None:
        self.met += 1
        self.at.children.append(data.removeprefix("CDATA["))


def _measure(root: Node) -> list[Node]:
    """All nodes, parents first, with the sizes of their texts."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.size += len(c)
            elif c.name not in SILENT:
                node.size += c.size
                node.linked += c.size if c.name == "a" else c.linked
    return order


#: What gives points, and what is read by itself beside the best container.
SCORED = ("p", "pre", "td", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6")
#: Share of the best container's points that a container beside it must have, link density a paragraph may have.
SHARE, LINKED = 0.2, 0.5


def _score(root: Node) -> Node:
    """Give points upwards and return the best container."""
    seen = _measure(root)
    touched = set()
    for node in seen:
        if node.name in SCORED and node.parent is not None:
            t = node.text().strip()
            if len(t) < 10:
                continue
            points = 1 + t.count(",") + min(len(t) / 100, 3)
            for up, share in ((node.parent, 1.0), (node.parent.parent, 0.5)):
                if up:
                    up.points += points * share
                    touched.add(up)
    best = root
    for node in seen:
        if node in touched:
            node.points *= 1 - node.density()
            if node.points > best.points:
                best = node
    return best


def _reads(node: Node, best: Node) -> bool:
    """Whether what lies beside the best container is content: enough points, or a paragraph or phrase with little link text."""
    if node.points >= SHARE * best.points > 0:
        return True
    whole = node.name in SCORED or node.name in ("table", "thead", "tbody", "tfoot", "tr", "figure", "figcaption", "caption") or node.name not in BLOCK
    return whole and node.density() <= LINKED or node.size <= 25 and node.name not in BLOCK


def _keep(best: Node) -> list[Node | str]:
    """The best container within its ancestors, with what beside it or them is content."""
    kept: list[Node | str] = [best]
    node = best
    while node.parent:
        row: list[Node | str] = []
        for c in node.parent.children:
            if c is node:
                row += kept
            elif isinstance(c, str) or _reads(c, best):
                row.append(c)
        kept, node = row, node.parent
    return kept


def _render(parts: list[Node | str]) -> str:
    """Text of the nodes; blocks become paragraphs, headings, items, rows and fences.  The stack holds (what is left, its wrapping), so any depth is rendered."""
    out: list[list[str]] = [[]]
    stack: list[tuple[Iterator, str]] = [(iter(parts), "")]
    while stack:
        c = next(stack[-1][0], None)
        if c is None:
            name, inner = stack.pop()[1], "".join(out.pop())
            if not out:
                return inner
            out[-1].append(_wrap(name, inner))
        elif isinstance(c, str):
            out[-1].append(re.sub(r"\s+", " ", c))
        elif c.name == "pre":
            out[-1].append(f"\n\n```\n{c.text().strip(chr(10))}\n```\n\n")
        elif c.name in ("br", "hr"):
            out[-1].append("\n")
        elif c.name not in SILENT:
            stack.append((iter(c.children), c.name))
            out.append([])
    return ""


def _wrap(name: str, inner: str) -> str:
    if name[0] == "h" and name[1:].isdigit():
        return f"\n\n{'#' * int(name[1:])} {inner.strip()}\n\n"
    if name == "li":
        return f"\n- {inner.strip()}"
    if name in ("code", "tt", "kbd", "samp"):
        return f"`{inner.strip()}`"
    if name in ("td", "th"):
        return f" {inner.strip()} |"
    if name == "tr":
        return f"\n|{inner}"
    return f"\n\n{inner}\n\n" if name in BLOCK else inner


def parsed(text: str) -> _Tree:
    """The tree of a text; angle brackets that belong to no known element are ordinary signs."""
    if re.search(rf"&lt;/?(?:{_NAME})\b", text, re.I):
        text = unescape(text)
    text = re.sub(r"<!\[CDATA\[(.*?)(?:\]\]>|$)", r"<!---->\1", text, flags=re.S)
    tree = _Tree()
    # a tag cut off at the end of the text is dropped
    text, cut = re.subn(rf"</?(?:{_NAME})(?:\s[^<>]*)?$", "", text, flags=re.I)
    text = re.sub(rf"<(?!/?(?:{_NAME})(?:\s[^<>]*)?/?>|!--|!DOCTYPE)", "\x01", text, flags=re.I)
    tree.feed(text)
    tree.close()
    tree.met += cut
    return tree


def _html(text: str) -> str:
    out = _render(_keep(_score(parsed(text).root))).replace("\x01", "<")
    return unescape(out) if _ENTITY.search(out) else out


def _guard(text: str) -> tuple[str, list[str]]:
    """Code and formulas out of the way of the other rules."""
    kept: list[str] = []

    def put(piece: str) -> str:
        kept.append(piece)
        return f"\x00{len(kept) - 1}\x00"

    text = text.replace("\x00", "")
    text = re.sub(r"^ *(```|~~~)[^\n]*\n(.*?)(?:^ *\1[ \t]*$|\Z)", lambda m: put(f"```\n{m[2].rstrip(chr(10))}\n```"), text, flags=re.S | re.M)
    text = re.sub(r"(?<!`)`[^`\n]+`(?!`)", lambda m: put(m[0]), text)
    text = re.sub(r"\\\[(.*?)\\\]", lambda m: put(f"$${m[1].strip()}$$"), text, flags=re.S)
    text = re.sub(r"\$[^$\n]*[\\^_{}=][^$\n]*\$|\$[a-zA-Z]\$", lambda m: put(m[0]), text)
    return text, kept


def _latex(text: str) -> str:
    text = re.sub(r"\\(section|subsection|subsubsection|chapter|title)\*?\{([^{}]*)\}[ \t]*", lambda m: f"\n\n{'#' * (1 + m[1].count('sub'))} {m[2]}\n\n", text)
    text = re.sub(r"[ ~]?\\(?:cite[pt]?|ref|eqref|label)\{[^{}]*\}", "", text)
    text = re.sub(r"\\(?:emph|textbf|textit|texttt|textsc|underline|text|footnote|caption)\{([^{}]*)\}?", r"\1", text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}\n?", "", text)
    return re.sub(r"^[ \t]*\\item\s*", "- ", text, flags=re.M)


def _wiki(text: str) -> str:
    text = re.sub(r"^ *(={1,6}) ?([^\s=](?:[^\n]*?[^\s=])?) ?\1 *$", lambda m: f"{'#' * len(m[1])} {m[2]}", text, flags=re.M)
    text = re.sub(r"'{2,5}([^'\n]+)'{2,5}", r"\1", text)
    text = re.sub(r"\[\[(?:[^|\[\]\n]*\|)?([^|\[\]\n]*)\]\]", r"\1", text)
    text = re.sub(r"\[[a-z]+://[^\s\]]+ ?([^\]\n]*)\]", r"\1", text)
    text = re.sub(r"\{\{[^{}\n]*\}\}", "", text)
    if "{|" in text:
        text = re.sub(r"^ *\{\|.*$|^ *\|[-}].*$", "", text, flags=re.M)
        text = re.sub(r"^ *[|!] ?(.*)$", lambda m: "| " + re.sub(r"\s*(?:\|\||!!)\s*", " | ", m[1]) + " |", text, flags=re.M)
    return text


def _markdown(text: str) -> str:
    text = re.sub(r"^([^\n]*\w[^\n]*)\n *(={3,}|-{3,}) *$", lambda m: f"{'#' if m[2][0] == '=' else '##'} {m[1].strip()}", text, flags=re.M)
    text = re.sub(r"^ {0,3}\[[^\]\n]+\]: +\S+.*$\n?", "", text, flags=re.M)
    text = re.sub(r"!?\[([^\]\n]*)\]\([^)\n]*\)?", r"\1", text)
    text = re.sub(r"\[([^\]\n]+)\]\[[^\]\n]*\]", r"\1", text)
    text = re.sub(r"^ {0,3}> ?", "", text, flags=re.M)
    text = re.sub(r"^ *\|?[ :|]*-{3,}[ :|-]*\|?[ \t]*$\n?", "", text, flags=re.M)
    text = re.sub(r"^ {0,3}[*+-] +(?=\S)", "- ", text, flags=re.M)
    text = re.sub(r"\*{2,4}([^\s*][^*\n]*?)\*{2,4}|(?<![\w_])__(\S[^\n]*?)__(?![\w_])|~~(\S[^~\n]*?)~~", lambda m: m[1] or m[2] or m[3], text)
    return re.sub(r"(?<![\w*])\*([^\s*][^*\n]*?)\*(?![\w*])|(?<![\w_])_([^\s_][^_\n]*?)_(?![\w_])", lambda m: m[1] or m[2], text)


def clean(text: str) -> tuple[list[str], str]:
    """Kinds of markup, and the text without it (the text itself if there is none)."""
    found = kinds(text)
    if not found:
        return found, text
    out = _html(text) if "html" in found else text
    out, kept = _guard(out)
    for name, rule in (("latex", _latex), ("wiki", _wiki), ("markdown", _markdown)):
        if name in found or name == "markdown" and "html" not in found:
            out = rule(out)
    out = re.sub(r"[ \t]+\n", "\n", re.sub(r"(?<=\S)[ \t]{2,}", " ", out))
    out = re.sub(r"\n{3,}", "\n\n", out).strip()
    return found, re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], out)


def strip_markup(df: DataFrame, text: str, out: str = "clean_text", kinds_out: str = "markup") -> DataFrame:
    """``df`` with ``out`` (the clean text) and ``kinds_out`` (array of html, markdown, wiki, latex).

    A text without markup is returned as it is; null gives null and no kinds,
    the empty text stays empty.  Rows are kept one to one, with all columns;
    both new names must be free.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(kinds_out, T.ArrayType(T.StringType()))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [([], t) if t is None else clean(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c for _, c in done], pa.string()), pa.array([k for k, _ in done], pa.list_(pa.string()))], names=[*b.schema.names, out, kinds_out])

    return df.mapInArrow(run, schema)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of updates and blog posts: tab, rec_id, summary."""
    tabs = (("azure_updates", "update_id"), ("blog_posts", "blog_id"))
    one, two = (table(spark, sf_dir, t).select(F.lit(t).alias("tab"), F.col(k).alias("rec_id"), "summary") for t, k in tabs)
    return one.unionByName(two)


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every summary with its clean text and the kinds of markup found."""
    rows = strip_markup(summaries(spark, sf_dir), "summary")
    return rows.select("tab", "rec_id", "clean_text", F.array_join("markup", ",").alias("markup"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose summary holds markup."""
    return strip_markup(summaries(spark, sf_dir), "summary").where(F.size("markup") > 0).select("tab", "rec_id")
