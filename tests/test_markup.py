"""Element trees of pages against trees built by hand, and literal cases of markup."""

import random

import pytest

from textloom.operators import markup as M

SCHEMA = "page_id long, html string"
INLINE, LEAVES, HOLDERS = ["b", "i", "a"], ["p", "h1", "h2", "h4", "li", "figcaption"], ["div", "ul", "section", "blockquote", "nav", "table", "aside"]


class Node:
    def __init__(self, name, attributes="", children=()):
        self.name, self.attributes, self.children = name, attributes, list(children)

    def text(self):
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def html(self, rng):
        inner = "".join(c if isinstance(c, str) else c.html(rng) for c in self.children)
        end = "" if self.name == "p" and rng.random() < 0.4 else f"</{self.name}>"
        return f"<{self.name}{self.attributes}>{inner}{end}"

    def all(self, above=()):
        yield self, above
        for c in self.children:
            if isinstance(c, Node):
                yield from c.all((*above, self))


def words(rng):
    return " ".join(rng.choice(["one", "two  ", "three\n", "a&amp;b", "é", "part"]) for _ in range(rng.randint(0, 4)))


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.5:
        inner = [x for _ in range(rng.randint(0, 3)) for x in (words(rng), Node(rng.choice(INLINE), "", [words(rng)]))]
        return Node(rng.choice(LEAVES), rng.choice(["", ' class="footnote"', " id=x"]), inner)
    return Node(rng.choice(HOLDERS), rng.choice(["", ' class="newsletter-box"', ""]), [tree(rng, depth - 1) for _ in range(rng.randint(0, 4))])


def flat(text):
    return " ".join(text.replace("&amp;", "&").split())


def wanted_segments(body):
    out = []
    for node, above in body.all():
        n, text = node.name, flat(node.text())
        taken = any(a.name in ("blockquote", "table") for a in above)
        if not text or (n in ("p", "li") and taken):
            continue
        kind = {"h2": "heading", "h4": "subheading", "blockquote": "quote", "figcaption": "caption", "table": "table", "li": "list"}.get(n)
        kind = kind or {"h1": "title" if text.lower().split()[0] in ("part", "book") else "chapter", "p": "footnote" if "footnote" in node.attributes else "body"}.get(n)
        if kind:
            out.append([kind, text])
    if not any(k == "body" for k, _ in out) and sum(len(t) for _, t in out) < 300:
        out = [["title" if k in ("chapter", "heading", "subheading") else k, t] for k, t in out]
    return [(i + 1, *x) for i, x in enumerate(out)]


def wanted_article(body):
    out = []
    for node, above in body.all():
        skip = any(a.name in M.PASSED or "newsletter" in a.attributes for a in (*above, node))
        inner = any(x is not node and x.name in M.READ + M.HOLD for x, _ in node.all())
        if node.name in M.READ and not skip and not inner and flat(node.text()):
            out.append(flat(node.text()))
    return [(i + 1, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def bodies():
    rng = random.Random(8)
    return [Node("body", "", [tree(rng, 4) for _ in range(rng.randint(0, 6))]) for _ in range(120)]


@pytest.fixture(scope="module")
def pages(spark, bodies):
    rng = random.Random(9)
    rows = [(k, f"<!DOCTYPE html><html><head><title>t <p></title><script>var x = '</p><p>no';</script></head><!-- <p>no</p> -->{b.html(rng)}</html>") for k, b in enumerate(bodies)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_page(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["page_id"], []).append(tuple(r)[1:])
    return {k: sorted(v) for k, v in out.items()}


def test_segments(pages, bodies):
    found = by_page(M.segments(pages, "page_id", "html"))
    for k, body in enumerate(bodies):
        assert found.get(k, []) == wanted_segments(body), k
    assert sum(map(len, found.values())) > 300


def test_article(pages, bodies):
    found = by_page(M.article(pages, "page_id", "html"))
    for k, body in enumerate(bodies):
        assert found.get(k, []) == wanted_article(body), k


@pytest.mark.parametrize(
    ("html", "segments"),
    [
        (None, []), ("", []), ("plain text", []), ("<p>one<p>two", [(1, "body", "one"), (2, "body", "two")]), ("<p>a<br>b<img src=x/>c</p> d", [(1, "body", "abc")]),
        ("<h1>Part I</h1>", [(1, "title", "Part I")]), ("<h1>Animal</h1>", [(1, "title", "Animal")]), ("<h1>One</h1><p>x", [(1, "chapter", "One"), (2, "body", "x")]),
        ("<p>1 < 2 &lt; 3</p>", [(1, "body", "1 < 2 < 3")]), ("</p></div><p>x</p></p>", [(1, "body", "x")]), ("<div><P CLASS=x>y</P></DIV>", [(1, "body", "y")]), ("<ul><li>a<li>b</ul>", None),
    ],
)
def test_literal_pages(spark, html, segments):
    found = by_page(M.segments(spark.createDataFrame([(1, html)], SCHEMA), "page_id", "html")).get(1, [])
    assert segments is None or found == segments


def test_a_long_page(spark):
    html = "<ul>" + "<li>item</li>" * 20_000 + "</ul>"
    assert M.segments(spark.createDataFrame([(1, html)], SCHEMA), "page_id", "html").filter("category = 'list' and text = 'item'").count() == 20_000


def test_choices_of_the_reader(spark):
    from pyspark.sql import functions as F

    rows = [(1, "<div class=ad><p>buy</p></div><p>read</p><aside><p>no</p></aside>")]
    out = M.article(spark.createDataFrame(rows, SCHEMA), "page_id", "html", F.col("tag").contains("class=ad")).collect()
    assert [tuple(r) for r in out] == [(1, 1, "read")]
