"""The markup scanner against an XML parser and plain versions, and what it does with texts that don't fit together."""

import random
import xml.parsers.expat

import pytest

from millrace.sources import markup


def by_expat(text):
    """(line, local name) of elements in order, or None if the text is not well formed."""
    out = []
    parser = xml.parsers.expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler = lambda name, attrs: out.append((parser.CurrentLineNumber, name.rpartition("}")[2], sorted((k.rpartition("}")[2], v) for k, v in attrs.items())))
    try:
        parser.Parse(text.encode(), True)
    except xml.parsers.expat.ExpatError:
        return None
    return out


def by_scanner(text):
    try:
        found = markup.scan_markup(text)
    except markup.Malformed:
        return None
    return [(line, name, sorted((k, v) for k, v in a.items() if k != "xmlns" and k not in ("x", "y"))) for _, _, line, name, _, a in found]


PARTS = ['<a>', '</a>', '<b>', '</b>', '<c/>', '<a\n k="1"/>', "<b k='&lt;\n2' l=\"&#65;&#x42;\">", '<x:a x:k="1">', '</x:a>', '<a xmlns:x="u">', '<!-- c\n-->', '<!-- -- -->', '<![CDATA[<a>\n]]>', '<?pi\n?>', 't\n', '&amp;', '&', '&bad;', '<', ']]>', '<a k=1>', '<a k="1" k="2"/>', '<a k="<"/>', '<é>', '</é>', '\r\n', '\r', '&#0;', '<a k="1"l="2"/>', '</a >', '<a xmlns="v"/>', '<y:b xmlns:y=""/>']


WHOLE = ["<a></a>", "<b>\n<c/></b>", '<a\n k="1"/>', "<b k='&lt;\n2' l=\"&#65;&#x42;\"></b>", '<x:a x:k="1">t</x:a>', "<!-- c\n-->", "<![CDATA[<a>\n]]>", "t\r\n", "&amp;", '<a xmlns:x="v"><x:b/></a>']


def test_like_an_xml_parser():
    rng = random.Random(4)
    agreed = 0
    for n in range(30_000):
        inner = "".join(rng.choice(PARTS if rng.random() < 0.2 else WHOLE) for _ in range(rng.randrange(6)))
        text = rng.choice(["", "\n", "<!-- x -->", "<?xml version='1.0'?>\n", "<!DOCTYPE r [<!ELEMENT r ANY>]>\n"]) + rng.choice(['<r xmlns:x="u">' + inner + "</r>", inner])
        want = by_expat(text)
        assert by_scanner(text) == want, text
        agreed += want is not None and len(want) > 1
    assert agreed > 2000


def test_paths_and_nodes():
    found = markup.scan_markup('<Grid xmlns:x="u">\n<Row/><Row x:Key="k"><Row/></Row>\n<x:Row/></Grid>')
    assert [(n, p, line, path) for n, p, line, _, path, _ in found] == [(1, 0, 1, "Grid"), (2, 1, 2, "Grid/Row[0]"), (3, 1, 2, "Grid/Row[1]"), (4, 3, 2, "Grid/Row[1]/Row"), (5, 1, 3, "Grid/Row")]
    deep = "<a>" * 5000 + "</a>" * 5000
    last = markup.scan_markup(deep)[-1]
    assert last[1] == 4999 and last[4].startswith(".../a/a") and last[4].count("/") == markup.MOST_SEGMENTS


def test_problems_have_lines(spark):
    rows = [("a.xaml", "<a>\n<b></a>"), ("b.xaml", None), ("c.xaml", "<a>\r\n<b k=1/></a>"), ("d.xaml", "﻿<a x:k='1' xmlns:x='u'/>"), ("e.txt", "<a/>")]
    files = spark.createDataFrame(rows, "rel_path string, text string")
    tables = markup.markup_tables(files)
    told = {r["file"]: (r["parsed"], r["line"]) for r in tables["parsed"].collect()}
    assert told == {"a.xaml": (False, 2), "b.xaml": (False, 1), "c.xaml": (False, 2), "d.xaml": (True, 1)}
    assert [(r["file"], r["attributes"]["k"]) for r in tables["elements"].collect()] == [("d.xaml", "1")]


RAZOR = '''@page "/card/{id:int}"
@using System.Linq
@* <lost> *@
<!-- <lost> -->
<Card Title="@(Say("a>b"))" @bind-Value='Model.Size'
      Open>
  <p>one<p>two @Model.Find(")", 1).Rest <br>
  @if (x < 3) { <li>@@not</li> }
  <img src=/a.png />
</Card>
</div>
<section>
@code {
    string s = "}"; // }
    <lost>
}
'''


def test_components():
    rows = markup.scan_components(RAZOR)
    of = lambda kind: [r for r in rows if r[0] == kind]
    assert [(r[1], r[2], r[3]) for r in of("directive")] == [(1, "page", '"/card/{id:int}"'), (2, "using", "System.Linq")]
    assert [(r[1], r[2], r[6]) for r in of("element")] == [(5, "Card", "Card"), (7, "p", "Card/p"), (7, "p", "Card/p/p"), (7, "br", "Card/p/p/br"), (8, "li", "Card/p/p/li"), (9, "img", "Card/p/p/img"), (12, "section", "section")]
    assert of("element")[0][8] == [("Title", '@(Say("a>b"))', 5), ("@bind-Value", "Model.Size", 5), ("Open", "", 6)]
    assert of("element")[5][7] is False or of("element")[5][8] == [("src", "/a.png", 9)]
    assert [(r[1], r[3]) for r in of("expression")] == [(7, '@Model.Find(")", 1)')]
    assert [(r[1], r[2]) for r in of("block")] == [(13, "code")] and "<lost>" in of("block")[0][3]
    assert [(r[1], r[3]) for r in of("issue")] == [(11, "</div> closes nothing"), (12, "<section> is never closed")]


@pytest.mark.parametrize("text", ["", "<", "<a", "<a b", "<a b=", "<a b='", '<a b="@(', "@", "@(", "@{", "@code", "@*", "<!--", "</", "</a", "<a =b>", "<a/", '@("\\', "@x(", "<1>", "a@b.c d@"])
def test_texts_that_break_off(text):
    assert isinstance(markup.scan_components(text), list)


def test_long_texts():
    """A text is read once: twice the length takes about twice the time, whatever never closes."""
    for part in ("<b>", "<a b='", "@(", "</x>", '<a b="1" ', "@{ \"", "<!--", "<p><p></div>", "@x.y("):
        rows = markup.scan_components(part * 100_000)
        assert len(rows) <= 300_001
    assert len(markup.scan_markup("<r>" + "<a k='1'/>\n" * 100_000 + "</r>")) == 100_001


def test_random_texts_keep_order():
    rng = random.Random(9)
    for _ in range(2000):
        text = "".join(rng.choice(["<a>", "</a>", "<B c='", "'", '"', "@(", ")", "@x", "\n", "<br>", "/>", ">", "@{", "}", "<!--", "-->", "=", " "]) for _ in range(30))
        rows = [r for r in markup.scan_components(text) if r[0] != "issue"]
        assert [r[1] for r in rows] == sorted(r[1] for r in rows)
        assert all(r[1] <= text.count("\n") + 1 for r in rows)
