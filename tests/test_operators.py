"""Operators on small hand-made tables."""

from millrace.operators import diff, folds, graph, joins, markdown, rules


def test_findings_fold(spark):
    rows = [("E1", "m", f"p{i:02}") for i in range(25)] + [("E1", "m", "p00"), ("E2", "n", "q")]
    got = {r["head"]: r for r in folds.findings(spark.createDataFrame(rows, "h string, m string, p string"), "h", "p", "m").collect()}
    assert got["E1"]["positions"].startswith("p00 x2, p01,") and got["E1"]["positions"].endswith("p19, +5 more") and got["E1"]["n"] == 26
    assert got["E2"]["positions"] == "q"


def test_occurrences(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",), (None,)], "k string")
    names = {r["occurrence"] for r in folds.occurrence_names(df, "k", chunk=2).collect()}
    assert names == {"a", "a  [2]", "a  [3]", "a  [4]", "a  [5]", "b"}
    assert {r["occurrence"] for r in folds.occurrence_keys(df.where("k is not null"), "k").collect()} == names


def test_delta_and_baseline(spark):
    now, before = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("abc", "bcd"))
    assert {(r["k"], r["state"]) for r in folds.delta(now, before, "k").collect()} == {("a", "appeared"), ("b", "unchanged"), ("c", "unchanged"), ("d", "fixed")}
    assert {r["state"] for r in folds.delta(now, None, "k").collect()} == {"baseline"}


def test_rollup(spark):
    paths = spark.createDataFrame([(p,) for p in ("a/b/1", "a/b/2", "a/c/1", "top", "a\\b\\3")], "path string")
    assert {(r["row"], r["files"]) for r in folds.rollup(paths, "path", 2).collect()} == {("a/b/**  x3 files", 3), ("a/c/1", 1), ("top", 1)}


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("x", None)], "f string, t string")
    got = {(r["node"], r["reached"], r["depth"]) for r in graph.closure(edges, "f", "t").collect()}
    assert ("a", "c", 2) in got and ("a", "a", 0) in got and ("x", "y", 1) in got and len(got) == 9 + 3
    assert graph.closure(edges, "f", "t", max_depth=1).where("node = 'a'").count() == 2
    line = spark.createDataFrame([(i, i + 1) for i in range(11)], "f long, t long")
    assert {(r["node"], r["reached"]): r["depth"] for r in graph.closure(line, "f", "t", max_depth=5).collect()} == {(i, j): j - i for i in range(12) for j in range(i, min(12, i + 6))}
    seeded = graph.closure(line, "f", "t", spark.createDataFrame([(9,)], "s long"))
    assert {(r["node"], r["reached"], r["depth"]) for r in seeded.collect()} == {(9, 9, 0), (9, 10, 1), (9, 11, 2)}


def test_chain_stops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "gone"), ("e", None)], "k string, p string")
    got = {r["node"]: r["chain"] for r in graph.chain(edges, "k", "p").collect()}
    assert got == {"a": ["a", "b", "c"], "b": ["b", "c", "a"], "c": ["c", "a", "b"], "d": ["d"], "e": ["e"]}
    line = spark.createDataFrame([(i, i + 1) for i in range(40)], "k long, p long")
    assert len(next(r["chain"] for r in graph.chain(line, "k", "p").collect() if r["node"] == 0)) == 17


def test_containment_innermost(spark):
    hunks = spark.createDataFrame([(1, "f", 10, 12), (2, "f", 300, 301), (3, "g", 1, 1)], "id long, path string, a int, b int")
    spans = spark.createDataFrame([("outer", "f", 1, 200), ("inner", "f", 9, 20), ("short", "f", 10, 11)], "span string, path string, s int, e int")
    got = {r["id"]: (r["span"], r["confidence"]) for r in joins.containment(hunks, spans, "path", "a", "b", "s", "e", "span", "id").collect()}
    assert got == {1: ("inner", "EXACT"), 2: (None, "HEURISTIC"), 3: (None, "HEURISTIC")}


def test_prefix_join_keeps_unresolved(spark):
    sites = spark.createDataFrame([("Save",), ("Gone",)], "uid string")
    entries = spark.createDataFrame([("Save.Text",), ("Save",), ("SaveAll.Text",), (None,)], "name string")
    assert {(r["uid"], r["n"], r["names"]) for r in joins.prefix(sites, entries, "uid", "name").collect()} == {("Save", 2, "Save,Save.Text"), ("Gone", 0, "")}


def test_missing_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([("x", None), ("y", "de")], "k string, c string")
    assert joins.missing(a, a.where("k = 'x'"), ["k", "c"]).collect()[0]["k"] == "y"


def test_resolution(spark):
    symbols = spark.createDataFrame([("Run", "A.B", "1"), ("Run", "A.C", "2"), ("Go", "A.B", "3")], "name string, container string, id string")
    names = spark.createDataFrame([("Run", None), ("Run", "B"), ("Nope", None)], "q string, c string")
    got = {(r["asked"], r["status"], r["ids"]) for r in joins.resolve(names, symbols, "q", "c").collect()}
    assert got == {("Run", "ambiguous", "1,2"), ("Run", "ok", "1"), ("Nope", "missing", "")}
    close = spark.createDataFrame([("runn",), ("zzz",)], "q string")
    assert {(r["asked"], r["near"]) for r in joins.resolve(close, symbols, "q").collect()} == {("runn", "Run"), ("zzz", "")}


def test_markdown_table(spark):
    text = "x\n| Finding | Tool | Other |\n|---|:-:|--|\n| a \\| b | t1 | z |\n| ragged |\n\nbreak\n| tool | n |\n|--|--|\n| t2 | 1 |\n\n| none |\n|--|\n| q |"
    got = markdown.table(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), ["Tool", "Finding"], "id", "text").orderBy("line").collect()
    assert [(r["line"], r["Tool"], r["Finding"]) for r in got] == [(4, "t1", "a | b"), (5, "", "ragged"), (10, "t2", None)]


def test_markdown_sections(spark):
    text = "# A\ntext\n## B\n```\n# no\n```\n## C\n# D"
    got = [(r["heading"], r["level"], r["start_line"], r["end_line"]) for r in markdown.sections(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").orderBy("start_line").collect()]
    assert got == [("A", 1, 1, 7), ("B", 2, 3, 6), ("C", 2, 7, 7), ("D", 1, 8, 8)]


def replay(script):
    return [x for k, x in script if k != "+"], [x for k, x in script if k != "-"]


def test_line_diff():
    old, new = list("abcdefg"), list("abxdefyg")
    script = diff.line_diff(old, new)
    assert replay(script) == (old, new) and sum(k == " " for k, _ in script) == 6
    big_old, big_new = [f"l{i}" for i in range(4000)], [f"l{i}" for i in range(4000) if i % 7] + ["end"]
    assert replay(diff.line_diff(big_old[::-1] + ["mid"] + big_old, big_new + ["mid"] + big_new)) == (big_old[::-1] + ["mid"] + big_old, big_new + ["mid"] + big_new)
    assert diff.line_diff([], ["a"]) == [("+", "a")] and diff.line_diff(["a"], ["a"]) == [(" ", "a")]


def test_hunks(spark):
    lines = ["+++ b/a.txt", "@@ -1,2 +3,4 @@ x", "+q", "@@ -9 +12 @@"]
    got = diff.hunks(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, n int, value string"), "value", "n").collect()
    assert [(r["path"], r["start"], r["count"]) for r in got] == [("a.txt", 3, 4), ("a.txt", 12, 1)]


ENTRIES = [
    ("f", "f.resx", None, "Hello", "{0} of {1}", "Text", False, 1),
    ("f", "f.resx", None, "Bye", "Bye ", "Text", False, 2),
    ("f", "f.resx", None, "Bye", "Bye", "Text", False, 3),
    ("f", "f.resx", None, "Icon", "x", "Binary", False, 4),
    ("f", "f.de.resx", "de", "Hello", "{0}", "Text", False, 1),
    ("f", "f.de.resx", "de", "Extra", "", "Text", False, 2),
]


def test_resource_rules(spark):
    entries = spark.createDataFrame(ENTRIES, "family string, path string, culture string, name string, value string, kind string, preserved boolean, line int")
    tokens = spark.createDataFrame([("Hello",)], "token string")
    designers = spark.createDataFrame([("f", "f.Designer.cs", "Hello")], "family string, designer string, text string")
    every = tuple(f"RESX00{i}" for i in range(1, 10))
    got = {(r["rule"], r["path"], r["key"]) for r in rules.validate_resources(entries, tokens, designers, every).collect()}
    assert got == {
        ("RESX001", "f.de.resx", "Bye"),
        ("RESX002", "f.de.resx", "Hello"),
        ("RESX003", "f.resx", "Bye"),
        ("RESX004", "f.resx", "Bye"),
        ("RESX005", "f.de.resx", "Extra"),
        ("RESX007", "f.resx", "Bye"),
        ("RESX008", "f.resx", "-"),
        ("RESX008", "f.de.resx", "-"),
        ("RESX009", "f.Designer.cs", "Bye"),
    }
    assert rules.family_missing(entries).collect()[0]["missing"] == 1


def test_markup_rules(spark):
    elements = spark.createDataFrame([("a", 1, "k", "n"), ("a", 2, "k", None), ("b", 1, "k", "n")], "file string, line int, key string, name string")
    assert [(r["path"], r["detail"]) for r in rules.markup_duplicates(elements, "key", "XAML001").collect()] == [("a", "again at line 2")]
    refs = spark.createDataFrame([("a", 5, "k"), ("a", 6, "gone")], "file string, line int, key string")
    files = spark.createDataFrame([("a", True), ("b", True)], "file string, parsed boolean")
    assert [r["key"] for r in rules.markup_unresolved(refs, elements, files).collect()] == ["gone"]
    broken = spark.createDataFrame([("a", True), ("b", False)], files.schema)
    assert rules.markup_unresolved(refs, elements, broken).count() == 0
    assert [r["path"] for r in rules.markup_unparsed(broken).collect()] == ["b"]
    assert rules.markup_unused(elements, spark.createDataFrame([("n",)], "t string"), "name", "XAML005").count() == 0


def test_component_rules(spark):
    uses = spark.createDataFrame([("p", 1, "Card", ["Title", "Odd"]), ("p", 2, "Nope", [])], "path string, line int, component string, attributes array<string>")
    parameters = spark.createDataFrame([("Card", "Title", False), ("Card", "Body", True)], "component string, parameter string, required boolean")
    none = spark.createDataFrame([], "component string")
    assert [r["key"] for r in rules.unknown_components(uses, parameters).collect()] == ["Nope"]
    assert [r["key"] for r in rules.unknown_parameters(uses, parameters, none).collect()] == ["Odd"]
    assert rules.unknown_parameters(uses, parameters, spark.createDataFrame([("Card",)], none.schema)).count() == 0
    assert [r["key"] for r in rules.required_parameters(uses, parameters).collect()] == ["Body"]
    routes = spark.createDataFrame([("a", "Card", "/x/{Title}"), ("b", "Card", "/X/{title}"), ("c", "Card", "/y/{id:int}")], "path string, component string, route string")
    assert [r["path"] for r in rules.duplicate_routes(routes).collect()] == ["b"]
    assert [r["key"] for r in rules.route_parameters(routes, parameters).collect()] == ["id"]
    binds = spark.createDataFrame([("p", "Card", "Title"), ("p", "Card", "Id")], "path string, component string, property string")
    properties = spark.createDataFrame([("Card", "Title", True), ("Card", "Id", False)], "component string, property string, settable boolean")
    assert [r["key"] for r in rules.unsettable_binds(binds, properties).collect()] == ["Id"]
    lineage = spark.createDataFrame([("Card", "Base")], "type string, base string")
    refs = spark.createDataFrame([("p", "Card", "Base"), ("q", "Card", "Other"), ("r", "Card", "Card")], "path string, component string, field_type string")
    assert [r["path"] for r in rules.reference_types(refs, lineage).collect()] == ["q"]
    sheets, components = spark.createDataFrame([("a.razor.css",), ("b.razor.css",)], "path string"), spark.createDataFrame([("a.razor",)], "path string")
    assert [r["path"] for r in rules.orphan_stylesheets(sheets, components).collect()] == ["b.razor.css"]
    types = lambda *t: spark.createDataFrame([(x,) for x in t], "type string")
    injects = spark.createDataFrame([("p", "A"), ("p", "B"), ("p", "C")], "path string, type string")
    assert [r["key"] for r in rules.unregistered_injections(injects, types("A"), types("B")).collect()] == ["C"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "h string, m string, p string")
    assert folds.findings(empty, "h", "p", "m").count() == 0
    assert graph.closure(empty, "h", "m").count() == 0
    assert graph.chain(empty, "h", "m").count() == 0
