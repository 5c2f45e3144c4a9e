"""The question set on one small workspace."""

import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidQuery
from millrace.plans.workspace import Workspace


@pytest.fixture(scope="module")
def ws(spark):
    t = spark.createDataFrame
    files = [("src/a.cs", "Core", "class A {\n    void Run() {\n        Go();\n    }\n}"), ("src/b.cs", "App", "new A().Run();"), ("test/t.cs", "Tests", "A.Run()\nA.Run()"), ("doc/n.md", "Doc", "# T\n| Tool | N |\n|--|--|\n| x | 1 |\n## U\nend")]
    symbols = [
        ("A", "A", "class", "public", "", "src/a.cs", 1, 5, "Core", False, "class A", ""),
        ("A.Run", "Run", "method", "public", "A", "src/a.cs", 2, 4, "Core", False, "void Run()", "A"),
        ("A.Hid", "RunHidden", "method", "private", "A", "src/a.cs", 3, 3, "Core", False, "void RunHidden()", "A"),
        ("T.RunTest", "RunTest", "method", "public", "T", "test/t.cs", 1, 2, "Tests", True, "void RunTest()", "T"),
    ]
    refs = [("A.Run", "src/b.cs", 1, 9, 8, "EXACT", "call", "x", "B", False, False), ("A.Run", "test/t.cs", 1, 3, 2, "EXACT", "call", "x", "T", False, False), ("A.Run", "test/t.cs", 2, 3, 10, "EXACT", "call", "x", "T", False, False), ("A.Run", "gen.cs", 2, 3, 10, "EXACT", "call", "x", "T", False, True)]
    entries = [("f", "f.resx", None, "Save.Text", "Save", None, "Text", False, 1), ("f", "f.de.resx", "de", "Save.Text", "Sichern", "c", "Text", False, 1), ("f", "f.resx", None, "Open", "Open", None, "Text", False, 2)]
    elements = [("v.xaml", 1, "Page", None, None, "Page", None, {"Title": "{Binding Name.Length}"}), ("v.xaml", 2, "Button", "k", "n", "Page/Button", "Save", {"Click": "OnClick", "Text": "x"})]
    return Workspace(
        spark,
        "w",
        {
            "files": t(files, "rel_path string, project string, text string"),
            "symbols": t(symbols, "id string, name string, kind string, accessibility string, container string, path string, start_line int, end_line int, project string, is_test boolean, signature string, type_id string"),
            "refs": t(refs, "symbol_id string, path string, line int, col int, offset int, confidence string, kind string, scope string, container string, is_implicit boolean, is_generated boolean"),
            "project_edges": t([("App", "Core"), ("Tests", "App"), ("Tests", "Core")], "from_project string, to_project string"),
            "type_edges": t([("B", "A"), ("C", "B")], "derived string, base string"),
            "diagnostics": t([(1, "s", "E1", 3, "src/a.cs", 1, "m", False), (2, "s", "E1", 3, "src/a.cs", 1, "m", False), (2, "s", "E1", 3, "src/a.cs", 1, "m", False), (2, "s", "W1", 2, "src/b.cs", 1, "n", False), (2, "s", "W2", 2, "src/b.cs", 1, "n", True)], "run_id int, scope string, id string, severity int, path string, line int, message string, suppressed boolean"),
            "registrations": t([("p.cs", 1, "AddX", "AddX<A>()", "Main"), ("h.cs", 9, "AddY", "AddY<B>()", "AddHelpers"), ("p.cs", 3, "MapGet", "MapGet('/a')", "Main")], "file string, line int, method string, text string, container string"),
            "helper_calls": t([("p.cs", 2, "AddHelpers")], "file string, line int, method string"),
            "hunks": t([("src/a.cs", 3, 1), ("zzz", 1, 1)], "path string, start int, count int"),
            "changed": t([("src/b.cs", 1, 2)], "path string, added long, deleted long"),
            "statuses": t([], "path string, status string"),
            "commits": t([(1, "c1", "first", "x", "aa"), (2, "c2", "second", "x", "aa aa"), (3, "c3", "third", "x", "aa bb aa")], "seq int, id string, message string, path string, text string"),
            "entries": t(entries, "family string, path string, culture string, name string, value string, comment string, kind string, preserved boolean, line int"),
            "elements": t(elements, "file string, line int, type_name string, key string, name string, path string, uid string, attributes map<string,string>"),
            "styles": t([("t.xaml", 1, "Base", "Button", None, "theme"), ("v.xaml", 2, "Primary", "Button", "Base", "local"), ("a.xaml", 3, None, "Button", None, "app"), ("a.xaml", 4, "Primary", "Text", None, "app")], "file string, line int, key string, target string, based_on string, scope string"),
            "tracked": t([("src/a.cs",), ("src/b.cs",)], "path string"),
            "results": t([("P", "a", "Passed", 5), ("P", "b", "Failed", 9)], "project string, test_name string, outcome string, duration_ms long"),
            "parameters": t([("Card", "Title", True)], "component string, parameter string, required boolean"),
            "routes": t([("c.razor", "Card", "/card/{Title}")], "path string, component string, route string"),
        },
    )


def col(df, *names):
    return [r[names[0]] if len(names) == 1 else tuple(r[n] for n in names) for r in df.collect()]


def test_catalogue(ws):
    assert "w_files" in ws.register().list_tables()
    assert dict(col(ws.status(), "table", "rows"))["refs"] == 4
    ws.drop()
    assert not ws.list_tables()
    with pytest.raises(InvalidQuery):
        ws["nothing"]


def test_files(ws):
    assert col(ws.list_projects("OR"), "project") == ["Core"] and col(ws.owner_of("src/b.cs"), "project") == ["App"]
    assert sorted(col(ws.find_files("**/*.cs", tracked=True), "rel_path")) == ["src/a.cs", "src/b.cs"]
    assert ("src/**  x2 files", 2) in col(ws.find_files(depth=1), "row", "files")
    assert col(ws.search_text(["Run"], exclude="test/**"), "rel_path", "line") == [("src/a.cs", 2), ("src/b.cs", 1)]
    assert col(ws.search_text(["Run", "new"], "src/b.cs"), "tags") == ["q1,q2"]
    assert col(ws.search_text(["Go"], context=1), "before", "after") == [("    void Run() {", "    }")]
    assert col(ws.search_regex(r"R\w+", "test/*.cs", matches_only=True), "text") == ["Run", "Run"]
    assert col(ws.read_text("src/a.cs", 2, 3), "line") == [2, 3] and col(ws.read_text("src/a.cs", tail=1), "text") == ["}"]
    assert col(ws.read_section("doc/n.md", "U"), "text") == ["## U", "end"]
    assert col(ws.read_section("doc/n.md", "# t", 1), "line") == [1, 2, 3, 4, 5, 6]
    assert col(ws.read_columns("doc/n.md", ["n", "Tool"]), "n", "Tool") == [("1", "x")]
    assert col(ws.read_columns("doc/n.md", ["n"], section="T"), "n") == ["1"] and not col(ws.read_columns("doc/n.md", ["n"], section="U"), "n")
    for heading, occurrence in (("V", 0), ("U", 2), ("# U", 0)):
        with pytest.raises(InvalidQuery):
            ws.read_section("doc/n.md", heading, occurrence)
    with pytest.raises(InvalidQuery):
        ws.read_columns("doc/n.md", ["Nope"])


def test_symbols(ws):
    assert col(ws.search_symbols("run"), "id", "withheld", "total") == [("A.Run", 1, 2), ("A.Hid", 1, 2)]
    assert col(ws.search_symbols("run", scope="test"), "id") == ["T.RunTest"]
    assert col(ws.get_file_outline(["src/a.cs"], "hidden"), "id", "shown", "members") == [("A.Hid", 1, 2)]
    assert col(ws.get_type_outline("A"), "id") == ["A.Run", "A.Hid"] and col(ws.get_symbol("A"), "signature") == ["class A"]
    assert col(ws.get_symbol_source(["A.Run", "no"]), "source") == ["void Run() {\n    Go();\n}", "NOT_RESOLVED"]
    assert {(r[0], r[1]) for r in col(ws.resolve([("Run", None), ("Zip", None)]), "asked", "status")} == {("Run", "ok"), ("Zip", "missing")}
    assert sorted(col(ws.find_usages("A.Run"), "path", "positions", "n")) == [("src/b.cs", "1:9", 1), ("test/t.cs", "1:3,2:3", 2)]
    assert col(ws.explore_symbol("A.Run"), "usages", "test_usages", "files") == [(3, 2, 2)]
    assert col(ws.top_files("A.Run", 1), "path") == ["test/t.cs"] and col(ws.impact_tests("A.Run"), "test_class") == ["T"]
    assert col(ws.impact_projects("A.Run"), "project") == ["App", "Tests"]
    assert col(ws.find_implementations("A"), "id", "depth") == [("B", 1), ("C", 2)]
    assert col(ws.find_registrations("addy"), "file", "line") == [("h.cs", 9), ("p.cs", 2)]
    assert col(ws.list_endpoints(), "endpoint") == ["MapGet('/a')", "/card/{Title}"]


def test_findings_and_runs(ws, spark):
    assert sorted(col(ws.get_diagnostics(run=2), "head", "positions")) == [("E1", "src/a.cs:1 x2"), ("W1", "src/b.cs:1")]
    assert sorted(col(ws.analyze_since_last(2, 1), "state")) == ["appeared", "appeared", "unchanged"]
    assert {s for s in col(ws.analyze_since_last(1, None), "state")} == {"baseline"}
    assert col(ws.dead_code(), "key") == ["RunHidden"]
    assert col(ws.test_summary(), "verdict") == ["FAILED"] and col(ws.slowest_tests(1), "test_name") == ["b"]
    assert col(ws.rerun_failed(ws["results"].select("test_name")), "test_name") == ["b"]
    assert col(ws.changed_tests(spark.createDataFrame([("Tests",), ("Other",)], "project string")), "project") == ["Tests"]
    assert col(ws.changed_files(), "status") == ["M"] and col(ws.changed_files("**/b.cs"), "path") == []
    assert sorted(col(ws.diff_symbols(), "hunk", "symbol", "confidence"), key=str) == [("src/a.cs:3", "A.Hid", "EXACT"), ("zzz:1", None, "HEURISTIC")]
    assert col(ws.history(contains="aa"), "seq") == [2, 1] and col(ws.history(message="THIRD"), "seq") == [3]


def test_resources_and_markup(ws, spark):
    assert col(ws.resx_files(), "missing") == [1]
    assert sorted(col(ws.resx_get("f", ["neutral", "de"]), "name", "neutral", "de")) == [("Open", "Open", "MISSING"), ("Save.Text", "Save", "Sichern")]
    assert col(ws.resx_find("SICH", "value"), "name") == ["Save.Text"]
    assert col(ws.resx_validate(("RESX001",)), "key") == ["Open"]
    exact, textual = spark.createDataFrame([("a", 1)], "path string, line int"), spark.createDataFrame([("a", 1), ("a", 2)], "path string, line int")
    assert col(ws.resx_usages(exact, textual), "line", "confidence") == [(1, "EXACT"), (2, "HEURISTIC")]
    assert col(ws.xaml_outline("v.xaml", 0), "line") == [1] and col(ws.xaml_names("v.xaml"), "line") == [2] and col(ws.xaml_resources("v.xaml"), "key") == ["k"]
    assert col(ws.xaml_resolve("Primary"), "scope") == ["local", "app"]
    assert col(ws.xaml_styles("Button"), "key", "chain") == [(None, None), ("Base", ["Base"]), ("Primary", ["Primary", "Base"])]
    assert col(ws.xaml_localization(), "uid", "names") == [("Save", "Save.Text")]
    assert col(ws.xaml_find("name", "binding"), "line") == [1] and col(ws.xaml_codebehind("v.xaml", ["Click"]), "handler") == ["OnClick"]
    members = spark.createDataFrame([("VM", "Name", "String")], "type string, member string, member_type string")
    assert col(ws.xaml_bindings("v.xaml", members, "VM"), "resolved", "broken") == [(False, "Length")]
    parsed = spark.createDataFrame([("v.xaml", True)], "file string, parsed boolean")
    refs = spark.createDataFrame([("v.xaml", 9, "gone")], "file string, line int, key string")
    got = col(ws.xaml_validate(parsed, refs, spark.createDataFrame([("n",)], "t string")), "rule", "key")
    assert sorted(got) == [("XAML003", "gone"), ("XAML004", "k")]
    uses = spark.createDataFrame([("p", 1, "Card", ["Odd"])], "path string, line int, component string, attributes array<string>")
    assert col(ws.component_validate(uses, spark.createDataFrame([], "component string")), "rule", "key") == [("RZR002", "Odd"), ("RZR003", "Title")]
    assert col(ws.component("Card"), "routes") == [["/card/{Title}"]] and col(ws.component_find("CARD", "route"), "path") == ["c.razor"]
