"""The HTML patterns against a reader built on the standard library's parser."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagelode.functions import html as H

VOID = {"img", "br", "path"}


class Node:
    def __init__(self, tag, attrs=()):
        self.tag, self.attrs, self.children = tag, dict(attrs), []

    def walk(self):
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def texts(self, without=()):
        for child in self.children:
            if isinstance(child, str):
                yield child
            elif child.tag not in without:
                yield from child.texts(without)


class Reader(HTMLParser):
    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, attrs))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].children.append(data)


def tight(node):
    return "".join(t.strip() for t in node.texts())


def spaced(node):
    return " ".join(" ".join(t.strip() for t in node.texts(("svg",)) if t.strip()).split())


def random_page(rng, depth=0):
    """Well-formed markup with nesting, quotes of all kinds, comments and references."""
    words = ["alpha", "be ta", " gamma ", "x &amp; y", "&lt;b&gt;", "d&nbsp;e", "&#2547;5", "caf&eacute;", "\n", "৳"]
    parts = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.4 or depth > 5:
            parts.append(rng.choice(words))
        elif kind < 0.47:
            parts.append("<!-- <div class='hit'>no</div> -->")
        elif kind < 0.52:
            parts.append("<svg><path d='1'/>t</svg>")
        else:
            tag = rng.choice(["div", "span", "p", "DIV", "b"])
            cls = rng.choice(["hit", "a hit", "hit b", "hits", "no", "x-hit"])
            attr = rng.choice([f'class="{cls}"', f"class='{cls}'", f'title="a > b" class="{cls}"',
                               f"data-class=hit class='{cls}' id=z", 'title="class=\'hit\'"'])
            parts.append(f"<{tag} {attr}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(parts)


def test_elements_and_texts_agree_with_a_parser(spark):
    rng = random.Random(7)
    docs = [f"<html><body>{random_page(rng)}</body></html>" for _ in range(400)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, html string")
    markup = df.select("i", H.element_markup(F.col("html")).alias("m"))
    first = H.first_element(F.col("m"), "div", cls="hit")
    got = {r.i: r for r in markup.select(
        "i", first.isNotNull().alias("found"), H.tight_text(first).alias("tight"),
        H.spaced_text(first).alias("spaced"), H.spaced_text(F.col("m")).alias("whole")).collect()}
    hits = 0
    for i, doc in enumerate(docs):
        root = Reader(doc).root
        node = next((n for n in root.walk() if n.tag == "div"
                     and "hit" in (n.attrs.get("class") or "").split()), None)
        assert got[i].found == (node is not None), doc
        assert got[i].whole == spaced(root), doc
        if node:
            hits += 1
            assert got[i].spaced == spaced(node), doc
            if "nbsp" not in doc:
                assert got[i].tight == tight(node), doc
    assert hits > 50


@pytest.mark.parametrize(("html", "want"), [
    ('<div class="hit">a<div>b<div>c</div></div>d</div>e', "abcd"),
    ("<div class=hit>" + "<div>" * 9 + "x" + "</div>" * 9 + "y</div>z", "xy"),   # deeper than the pattern
    ('<div class="hit">never <b>closed', "neverclosed"),
    ('<div class="hit"></div><div class="hit">b</div>', ""),
    ('<DIV CLASS="hit">up</DIV >x', "up"),
    ('<div title="class=hit">a</div>', None),
    ('<div classy="hit">a</div>', None),
])
def test_first_element(values, html, want):
    assert values(lambda c: H.tight_text(H.first_element(H.element_markup(c), "div", cls="hit")), [html]) == [want]


def test_exact_class_list(values):
    count = lambda c: F.size(H.elements(c, "div", classes="row mb-2"))
    assert values(count, ['<div class="row mb-2">a</div><div class="row  mb-2 ">b</div>'
                          '<div class="row mb-2 x">c</div><div class="mb-2 row">d</div>']) == [2]


def test_rows_and_cells(values):
    rows = lambda c: H.table_rows(c)
    assert values(rows, ["<table><tr><td>1</td></tr><tr><td>2<tr class='x'>3</tr><TR>4</TABLE>"]) == [
        ["<td>1</td>", "3", "4</TABLE>"]]
    assert values(H.row_cells, ["<td>a</td><td b='>'>c", "<td>a<td>b</td></td>", ""]) == [["a", "c"], ["b"], []]


def test_attributes(values):
    tag = [' href="/a?b=1&amp;c=2" title=\'T "q"\'', " data-href=x href=y", " title='href=no'", ' href=""', ""]
    assert values(lambda c: H.attribute(c, "href"), tag) == ["/a?b=1&c=2", "y", None, "", None]
    assert values(lambda c: H.attribute(c, "title"), tag[:1]) == ['T "q"']


def test_references(values):
    assert values(H.decode_entities, ["a &amp;lt; b", "&#60;&#x3E;&#128241;", "&nosuch; &", "&copy;&rsquo;", None]) == [
        "a &lt; b", "<>📱", "&nosuch; &", "©’", None]


def test_text_or_default(values):
    page = ["<h1 class='t'> Hi <b>you</b></h1>", "<h1 class='t'></h1>", "<h1>other</h1>"]
    assert values(lambda c: H.element_text_or_default(c, "h1", cls="t"), page) == ["Hiyou", "Unknown", "Unknown"]
    assert values(lambda c: H.element_attribute_or_default(c, "h1", "class", "none"), page) == ["t", "t", "none"]


def test_long_attribute_lists_do_not_exhaust_the_stack(values):
    tag = "<div " + " ".join(f"data-{i}='v{i}'" for i in range(20_000)) + " class='hit'>x</div>"
    assert values(lambda c: H.tight_text(H.first_element(c, "div", cls="hit")), [tag]) == ["x"]
    many = "<div class=hit>" + "<p>y</p>" * 50_000 + "</div>"
    assert values(lambda c: F.length(H.first_element(c, "div", cls="hit")), [many]) == [len(many)]
    spaces = "<td>" + " " * 200_000 + "<b>x</b>" + "\n" * 200_000 + "y</td>"
    assert values(H.tight_text, [spaces]) == ["xy"] and values(H.spaced_text, [spaces]) == ["x y"]


def test_references_as_readers_take_them(values):
    import html as python_html
    texts = ["&#x110000;a", "&#9999999;", "&#xD800;b", "&#0;", "&#146;", "&#x80;x", "&#0000000000065;", "&#x000000000041;", "&#99999999999999999999999;",
             "&check;", "&nbsp d", "&notit;", "&copy2024", "&amp;lt;", "&AMP;", "&ltx", "&unknown;", "&;", "&#;", "&#x;", "&#65 b", "a & b", "&Eacute;&eacute",
             "&" * 5000, "&#65;" * 20_000, "&NotEqualTilde;"]
    got = values(H.decode_entities, texts)
    for text, result in zip(texts, got):
        assert result == python_html.unescape(text), text[:40]
