"""Keyed state, catalogues that are refreshed, property evaluation and overloads."""

import os

from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.plans.workspace import Workspace
from millrace.sources import files, properties
from millrace.sources.versions import Versions
from millrace.streaming import changes


def log(spark, source, *rows):
    spark.createDataFrame([(s, p, o, None, s) for s, p, o in rows], changes.CHANGES).coalesce(1).write.mode("append").parquet(source)


def held(spark, folder, until=None):
    return {r["path"]: r["length"] for r in changes.state(spark, folder, until).collect()}


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_a_drain_writes_what_changed(spark, tmp_path):
    source, folder = f"{tmp_path}/log", f"{tmp_path}/held"
    log(spark, source, *((i, f"f{i}.cs", "changed") for i in range(3000)))
    assert changes.drain(spark, source, folder)["events"] == 3000
    log(spark, source, (5000, "f1.cs", "changed"), (5001, "F2.cs", "deleted"), (5002, "new.xaml", "changed"))
    seen = changes.drain(spark, source, folder)
    assert seen == {"batches": 1, "events": 3, "requeued": 0, "reload": False}
    state = Versions(spark, f"{folder}/state", "path_key string", "path_key", "path_key")
    assert state.whole("base") == [0] and state.whole("delta")[-1] == 1
    assert spark.read.parquet(f"{folder}/state/delta/v=1").count() == 3 and size(f"{folder}/state/delta/v=1") < size(f"{folder}/state/base") / 3
    now = held(spark, folder)
    assert len(now) == 3000 and now["f1.cs"] == 5000 and "f2.cs" not in now and now["new.xaml"] == 5002
    assert len(held(spark, folder, until=0)) == 3000 and held(spark, folder, until=0)["f1.cs"] == 1
    log(spark, source, *((6000 + i, f"f{i}.cs", "changed") for i in range(1000)))
    changes.drain(spark, source, folder)
    assert state.whole("base") == [0, 2] and held(spark, folder)["f2.cs"] == 6002 and len(held(spark, folder)) == 3001
    assert {(r["kind"], r["generation"]) for r in changes.generations(changes.drains(spark, folder)).collect()} == {("Code", 3), ("Xaml", 1)}


def test_what_fails_comes_again_unless_it_is_old(spark, tmp_path):
    source, folder = f"{tmp_path}/log", f"{tmp_path}/held"
    log(spark, source, (1, "a.cs", "changed"), (2, "b.cs", "changed"), (3, "c.cs", "deleted"))
    refuse = lambda events: events.where(F.col("path_key").isin("a.cs", "b.cs"))
    seen = changes.drain(spark, source, folder, refuse)
    assert seen["requeued"] == 2 and held(spark, folder) == {}
    log(spark, source, (9, "B.cs", "changed"))
    assert changes.drain(spark, source, folder)["requeued"] == 0
    assert held(spark, folder) == {"a.cs": 1, "B.cs": 9}
    log(spark, source, (10, "b.cs", "deleted"))
    changes.drain(spark, source, folder)
    log(spark, source, (9, "B.cs", "changed"))
    changes.drain(spark, source, folder)
    assert held(spark, folder) == {"a.cs": 1}


def test_reload_is_told_from_the_whole_drain(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "RELOAD_AT", 4)
    source, folder = f"{tmp_path}/log", f"{tmp_path}/held"
    log(spark, source, (1, "a.cs", "changed"), (2, "b.cs", "changed"), (3, "c.cs", "changed"), (4, "d.txt", "changed"))
    assert changes.drain(spark, source, folder)["reload"] is False
    log(spark, source, *((10 + i, f"g{i}.cs", "changed") for i in range(4)))
    assert changes.drain(spark, source, folder)["reload"] is True


def test_a_number_written_twice_counts_once(spark, tmp_path):
    table = Versions(spark, f"{tmp_path}/t", "k string, n int", "k", "n")
    assert table.read().collect() == [] and table.compact() is False
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n int, gone boolean")
    table.put(rows(("a", 1, False), ("b", 1, False)), 0)
    table.put(rows(("a", 2, True)), 1)
    table.put(rows(("a", 2, True)), 1)
    assert [tuple(r) for r in table.read().collect()] == [("b", 1)]
    assert table.compact() and [tuple(r) for r in table.read().collect()] == [("b", 1)]
    table.put(rows(("a", 1, False)), 2)
    assert [tuple(r) for r in table.read().collect()] == [("b", 1)]


def test_a_refresh_reads_changed_files_alone(spark, tmp_path):
    root, folder = tmp_path / "root", f"{tmp_path}/catalogue"
    (root / "sub" / "bin").mkdir(parents=True)
    for name, text in (("a.cs", "one"), ("sub/b [1].cs", "two"), ("c.cs", "three"), ("sub/bin/x.cs", "never")):
        (root / name).write_text(text)
    assert files.refresh(spark, str(root), folder) == {"added": 3, "changed": 0, "removed": 0}
    texts = lambda: {r["rel_path"]: bytes(r["content"]).decode() for r in files.catalogue(spark, folder).collect()}
    assert texts() == {"a.cs": "one", "sub/b [1].cs": "two", "c.cs": "three"}
    assert files.refresh(spark, str(root), folder) == {"added": 0, "changed": 0, "removed": 0}
    # The content of a file whose stamp stays is not looked at.
    was = os.stat(root / "a.cs")
    (root / "a.cs").write_text("ONE")
    os.utime(root / "a.cs", ns=(was.st_atime_ns, was.st_mtime_ns))
    (root / "sub/b [1].cs").write_text("two and more")
    (root / "c.cs").unlink()
    (root / "d.cs").write_text("four")
    assert files.refresh(spark, str(root), folder) == {"added": 1, "changed": 1, "removed": 1}
    assert texts() == {"a.cs": "one", "sub/b [1].cs": "two and more", "d.cs": "four"}


def test_a_refresh_of_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_NAMED", 2)
    (tmp_path / "root").mkdir()
    for i in range(6):
        (tmp_path / "root" / f"f{i}").write_text(str(i))
    assert files.refresh(spark, f"{tmp_path}/root", f"{tmp_path}/c")["added"] == 6
    assert {bytes(r["content"]) for r in files.catalogue(spark, f"{tmp_path}/c").collect()} == {b"0", b"1", b"2", b"3", b"4", b"5"}


def told(spark, *rows):
    found = properties.evaluated(spark.createDataFrame(list(rows), "rel_path string, text string")).collect()
    return {(r["path"], r["name"]): (r["value"], r["file"]) for r in found}


def test_properties_in_order(spark):
    group = lambda body: f"<Project><PropertyGroup>{body}</PropertyGroup></Project>"
    got = told(
        spark,
        ("a/p.csproj", '<Project Sdk="x"><Import Sdk="s" Project="Sdk.props"/><PropertyGroup><N>$(N);2</N></PropertyGroup><Import Project="..\\x\\i.props"/><PropertyGroup Condition="\'$(I)\' == \'i\'"><Late>$(Gone)$(n)</Late></PropertyGroup><PropertyGroup Condition="\'$(I)\' != \'I\'"><Late>never</Late></PropertyGroup><Item>no</Item></Project>'),
        ("x/i.props", '<Project><Import Project="./j.props"/><Import Project="i.props"/><PropertyGroup><I>i</I><J>$(J)!</J></PropertyGroup></Project>'),
        ("x/j.props", '<Project><Import Project="i.props"/><PropertyGroup><J>j</J></PropertyGroup></Project>'),
        ("Directory.Build.props", group("<N>1</N><Far>far</Far>")),
        ("a/Directory.Build.targets", group("<N>$(N);3</N>")),
        ("b/Directory.Build.props", group("<N>b</N>")),
        ("b/c/q.csproj", group("<Q>&lt;$(N)</Q><Empty></Empty>")),
        ("b/c/none.csproj", None),
    )
    assert got == {
        ("a/p.csproj", "N"): ("1;2;3", "a/Directory.Build.targets"),
        ("a/p.csproj", "Far"): ("far", "Directory.Build.props"),
        ("a/p.csproj", "I"): ("i", "x/i.props"),
        ("a/p.csproj", "J"): ("j!", "x/i.props"),
        ("a/p.csproj", "Late"): ("1;2", "a/p.csproj"),
        ("b/c/q.csproj", "N"): ("b", "b/Directory.Build.props"),
        ("b/c/q.csproj", "Q"): ("<b", "b/c/q.csproj"),
        ("b/c/q.csproj", "Empty"): ("", "b/c/q.csproj"),
        ("b/c/none.csproj", "N"): ("b", "b/Directory.Build.props"),
    }


def test_overloads(spark):
    rows = [("Run", "N.A", "1", []), ("Run", "N.A", "2", ["int"]), ("Run", "N.A", "3", ["System.Collections.List<System.Int32>", "(int a, string b)"]), ("Run", "N.B", "4", ["int[]"]), ("Run", "N.B", "5", None)]
    rows += [("Many", f"M.T{i}", f"m{i}", []) for i in range(120)]
    symbols = spark.createDataFrame(rows, "name string, container string, id string, parameters array<string>")
    want = {"A.Run()": ("ok", "1"), "Run(int)": ("ok", "2"), "A.Run(List<Int32>, (int x, string))": ("ok", "3"), "A.Run(List<Int64>, (int, string))": ("missing", ""), "Run( , )": ("ok", "3"), "N.B.Run": ("ambiguous", "4,5"), "B.Run(int[])": ("ok", "4"), "B.Run(int)": ("missing", ""), "Many": ("saturated", None), "T7.Many": ("ok", "m7"), "Gone": ("missing", "")}
    got = {r["asked"]: (r["status"], r["ids"]) for r in joins.resolve_overloads(spark.createDataFrame([(x,) for x in want], "q string"), symbols, "q").collect()}
    assert {k: (s, None if s == "saturated" else i) for k, (s, i) in got.items()} == want


def test_analyze_and_components_among_symbols(spark):
    t = spark.createDataFrame
    ws = Workspace(
        spark,
        "w",
        {
            "diagnostics": t([(1, "E1", 3, "a.cs", 1, "m", False), (1, "E2", 3, "b.cs", 2, "n", False), (2, "E1", 3, "b.cs", 1, "o", False)], "run_id int, id string, severity int, path string, line int, message string, suppressed boolean"),
            "symbols": t([("S", "Hidden", "method", "private", "A", "b.cs", 4, False)], "id string, name string, kind string, accessibility string, container string, path string, start_line int, is_test boolean"),
            "refs": t([], "symbol_id string, path string"),
            "changed": t([("b.cs",), ("b.cs",)], "path string"),
            "component_files": t([("c/HiddenCard.razor", "HiddenCard"), ("c/x.razor", None)], "path string, component string"),
        },
    )
    assert sorted((r["id"], r["path"]) for r in ws.analyze(1).collect()) == [("DEAD001", "b.cs"), ("E1", "a.cs"), ("E2", "b.cs")]
    assert sorted(r["id"] for r in ws.analyze(1, ["E2", "DEAD001"], changed_only=True).collect()) == ["DEAD001", "E2"]
    assert [(r["id"], r["kind"]) for r in ws.search_symbols("hidden").collect()] == [("component:c/HiddenCard.razor", "component"), ("S", "method")]
