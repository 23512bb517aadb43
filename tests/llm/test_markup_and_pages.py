import random

import numpy as np
import pytest

from lodestream.llm import boilerplate as B
from lodestream.llm import markup as M
from lodestream.session import table


@pytest.mark.parametrize(
    "text",
    [
        "Use snake_case or kebab-case; 1 < 8, as usual.", "That makes 5 * 4 * 2 units at $5 each, or $10.", "The R&D and Q&A groups agree.",
        "Samples in C# and F# cover ticket #490.", "Compare a == b before a -> c, and {0} stays.", "It stays as it was [sic]. See note [5].",
        "Logs land in C:\\golvoula\\vohal after ~36 s.", "It holds while load < 11 and latency > 0 ms.", "", "  ", "ends with <",
    ],
)
def test_ordinary_signs_stay(text):
    assert M.clean(text) == ([], text)


@pytest.mark.parametrize(
    "text,kind,want",
    [
        ("<p>One</p><p>Two &amp; three</p>", "html", "One\n\nTwo & three"),
        ("&lt;p&gt;One&lt;/p&gt;", "html", "One"),
        ("a&mdash;b", "html", "a—b"),
        ("<div><h3>T</h3><ul><li>x, y</li><li>z</li></ul></div>", "html", "### T\n\n- x, y\n- z"),
        ("<![CDATA[a <b>b</b>]]><!-- c -->", "html", "a b"),
        ("x <a href='https://e.example/p?q=1", "html", "x"),
        ("<pre>a  =  1\nb</pre>", "html", "```\na  =  1\nb\n```"),
        ("A **bold** and `co_de`", "markdown", "A bold and `co_de`"),
        ("Title\n=====\nText", "markdown", "# Title\nText"),
        ("* **a** b\n* c", "markdown", "- a b\n- c"),
        ("see [x](https://e.example) and ![i](/m.png)", "markdown", "see x and i"),
        ("See [a][1].\n\n[1]: https://e.example", "markdown", "See a."),
        ("```sql\nSELECT *\n```", "markdown", "```\nSELECT *\n```"),
        ("'''The''' [[A b|c]] {{box|x=1}}", "wiki", "The c"),
        ("== Head ==\ntext", "wiki", "## Head\ntext"),
        ("[https://e.example name] does", "wiki", "name does"),
        ("The bound is $x_1 \\le 2$ here", "latex", "The bound is $x_1 \\le 2$ here"),
        ("\\section{One} \\emph{two}~\\cite{k1}.", "latex", "# One\n\ntwo."),
        ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", "latex", "- a\n- b"),
    ],
)
def test_markup_becomes_text(text, kind, want):
    kinds, got = M.clean(text)
    assert kind in kinds and got == want


def test_link_heavy_blocks_go_and_content_stays():
    page = "<body><ul><li><a href='/1'>first link of many</a></li><li><a href='/2'>second link of many</a></li></ul><div><p>Long text, with commas, and more of it here.</p><p>More, of, it.</p></div></body>"
    assert M.clean(page)[1] == "Long text, with commas, and more of it here.\n\nMore, of, it."


def test_deep_long_and_null_markup(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert M.clean(deep)[1] == "x"
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (3, "plain"), (4, "<b>x</b> " * 20000)], "markup_ int, summary string")
    got = M.strip_markup(df, "summary").collect()
    assert [(r.markup_, list(r.markup)) for r in got] == [(1, []), (2, []), (3, []), (3, []), (4, ["html"])]
    assert got[0].clean_text is None and M.strip_markup(df.limit(0), "summary").count() == 0


def corpus(n, seed=1):
    """Pages with a menu, a notice, links in the middle and a foot, in words that the prose never uses; (rows, furniture)."""
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("ran", "tel", "vos", "pim")]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    text = lambda: " ".join(sentence(rng.randint(7, 12)) for _ in range(5))
    rows, gone = [], set()
    for i in range(n):
        title = sentence(5)[:-1]
        lines = [(f"Ywe keep {rng.choice(words)} ycookies for ymeasuring, always.", 1), ("Xhome", 1), (f"Xshop ({i})", 1), (title, 0), (text(), 0), ("Zoverview", 0), (text(), 0)]
        lines += [("Xmore xreading", 1), *((sentence(6)[:-1], 1) for _ in range(rng.randint(1, 4)))] if i % 2 else []
        lines += [(text(), 0), ("- " + sentence(4)[:-1], 0), ("```", 0), ("Xhome", 0), ("```", 0), ("", 0), (text(), 0), (f"Xcopyright {2000 + i} xreserved", 1), ("Xup", 1)]
        gone |= {(i, k) for k, (_, f) in enumerate(lines) if f}
        rows.append((i, "\n".join(t for t, _ in lines), title, 5))
    return rows, gone


PAGES = "rec_id long, body_text string, title string, nodes int"


def found(spark, rows):
    return {(r.rec_id, r.line_no) for r in B.boilerplate_lines(spark.createDataFrame(rows, PAGES), "body_text", "title", ["rec_id"]).collect()}


def test_the_scores_choose_the_container(spark, monkeypatch):
    page = (
        "<html><body><div class='a'><ul><li><a href='/x'>First link of the list</a></li><li><a href='/y'>Second link of the list</a></li></ul></div>"
        "<div class='b'><h2>Head</h2><p>A long paragraph, with commas, and more of them, that goes on for a while.</p><p>Another one, as long, and as rich in commas as that.</p></div>"
        "<div class='c'><div>Terms</div><a href='/z'>Where else to look for things</a></div></body></html>"
    )
    whole = M.clean(page)[1]
    assert whole.startswith("## Head\n\nA long paragraph") and "link" not in whole and "Where else" not in whole
    monkeypatch.setattr(M, "_score", lambda root: (M._measure(root), root)[1])  # without scores the root is all there is
    assert "First link" in M.clean(page)[1] and "Where else" in M.clean(page)[1]


def test_trees_of_any_depth():
    deep = "<div>" * 5000 + "<p>Text, in the depth of it all.</p>" + "</div>" * 5000
    assert M.clean(deep) == (["html"], "Text, in the depth of it all.")


def test_lines_around_the_page(spark):
    rows, gone = corpus(60)
    got = found(spark, rows)
    assert len(got & gone) >= 0.97 * len(gone) and len(got & gone) >= 0.97 * len(got)
    body = {r.rec_id: r.main_text for r in B.main_body(spark.createDataFrame(rows[:60], PAGES), "body_text", "title", "rec_id").collect()}
    assert body[0].startswith(rows[0][2]) and "xreserved" not in body[0] and "Zoverview" in body[0] and len(body) == 60


def test_the_ratios_decide(spark, monkeypatch):
    """With the paths' scores dealt out anew, the lines are no longer found."""
    rows, gone = corpus(60)
    init = B.Paths.__init__

    def shuffled(self, rows, least):
        rng = random.Random(3)
        values = [r[3:] for r in rows]
        rng.shuffle(values)
        init(self, [(*r[:3], *v) for r, v in zip(rows, values)], least)

    monkeypatch.setattr(B.Paths, "__init__", shuffled)
    got = found(spark, rows)
    assert len(got & gone) < 0.9 * len(gone) or len(got & gone) < 0.9 * len(got)


def test_pages_without_content(spark):
    rows = [(2, None, None, 5), (3, "", "x", 5), (4, " \n\n", None, 5), (5, "One line, of text. " * 20000, None, 5)]
    assert found(spark, rows) == set() and found(spark, []) == set()
    body = {r.rec_id: r.main_text for r in B.main_body(spark.createDataFrame(rows, PAGES), "body_text", "title", "rec_id").collect()}
    assert body[2] is None and len(body) == 4


def test_two_modes():
    at = B.valley(np.array([0.1, 0.15, 0.2, 0.8, 0.9]), np.array([5.0, 1, 5, 100, 100]))
    assert 0.2 < at <= 0.8 and B.valley(np.zeros(0), np.zeros(0)) == 0


def test_found_queries(spark, sf):
    bodies = {("techcommunity_posts", r.post_id): r.body_text for r in table(spark, sf, "techcommunity_posts").collect()} | {("blog_posts", r.blog_id): r.body_text for r in table(spark, sf, "blog_posts").collect()}
    got = B.p4_found(spark, sf).collect()
    assert got and len(got) == len(set(got)) and all(bodies[r.tab, r.rec_id].split("\n")[r.line_no].strip() for r in got)
    assert M.p5_found(spark, sf).count() > 0
