"""File sources and the change stream on temporary folders."""

from pyspark.sql import functions as F

from millrace.sources import documents, files
from millrace.streaming import changes

RESX = """<?xml version="1.0"?>
<root>
  <data name="Hello" xml:space="preserve"><value> hi </value></data>
  <data name="Icon" type="t"><value>x</value><comment>c</comment></data>
</root>"""

TRX = """<TestRun><Results>
<UnitTestResult testName="A.one" outcome="Passed" duration="00:00:01.5000000" />
<UnitTestResult testName="A.two" outcome="Failed" duration="bad"><Output><ErrorInfo><Message>no</Message><StackTrace>at x</StackTrace></ErrorInfo></Output></UnitTestResult>
<UnitTestResult testName="A.three" outcome="NotExecuted" duration="00:00:00" />
</Results></TestRun>"""


def test_scan_prune_decode(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/obj").mkdir()
    (tmp_path / "src/a.txt").write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "src/w.txt").write_bytes("wide".encode("utf-16"))
    (tmp_path / "src/b.bin").write_bytes(b"x\0y")
    (tmp_path / "src/c.dll").write_bytes(b"text")
    (tmp_path / "src/obj/skip.txt").write_text("no")
    found = files.scan(spark, str(tmp_path))
    assert sorted(r["rel_path"] for r in found.select("rel_path").collect()) == ["src/a.txt", "src/b.bin", "src/c.dll", "src/w.txt"]
    kept = files.prune(found, (".dll",)).select("rel_path", files.decode(F.col("content")).alias("text")).collect()
    assert {(r["rel_path"], r["text"]) for r in kept} == {("src/a.txt", "hello"), ("src/w.txt", "wide")}


def test_resources(spark):
    got = documents.resource_entries(spark.createDataFrame([("d/Strings.de-DE.resx", RESX), ("d/Strings.resx", RESX)], "path string, text string")).collect()
    assert len(got) == 4
    first = next(r for r in got if r["culture"] == "de-DE" and r["name"] == "Hello")
    assert (first["family"], first["value"], first["kind"], first["preserved"], first["line"]) == ("d/Strings", " hi ", "Text", True, 3)
    icon = next(r for r in got if r["culture"] is None and r["name"] == "Icon")
    assert (icon["kind"], icon["comment"], icon["preserved"], icon["line"]) == ("Typed", "c", False, 4)


def test_solutions_and_projects(spark):
    rows = [
        ("a.sln", 'Project("{X}") = "P", "src\\P\\P.csproj", "{Y}"\nEndProject'),
        ("b.slnx", '<Solution><Project Path="q/Q.csproj" /></Solution>'),
        ("c.slnf", '{"solution": {"path": "a.sln", "projects": ["r\\\\R.csproj"]}}'),
        ("d.slnf", '{"solution": 3}'),
        ("e.slnf", "broken"),
    ]
    got = documents.solution_projects(spark.createDataFrame(rows, "path string, text string")).collect()
    assert {(r["path"], r["project"]) for r in got} == {("a.sln", "src/P/P.csproj"), ("b.slnx", "q/Q.csproj"), ("c.slnf", "r/R.csproj")}
    project = spark.createDataFrame([("p", '<Project><PropertyGroup><A>1</A><B>2</B></PropertyGroup><PackageReference Include="X" Version="1.0" /><ProjectReference Include="..\\q.csproj" /></Project>')], "path string, text string")
    assert [(r["kind"], r["name"], r["version"]) for r in documents.project_references(project).collect()] == [("package", "X", "1.0"), ("project", "../q.csproj", None)]
    assert [(r["name"], r["value"]) for r in documents.project_properties(project, "a").collect()] == [("A", "1")]


def test_results(spark, tmp_path):
    (tmp_path / "r.trx").write_text(TRX)
    results = documents.test_results(spark, str(tmp_path / "r.trx"))
    assert {(r["test_name"], r["outcome"], r["duration_ms"], r["message"]) for r in results.collect()} == {("A.one", "Passed", 1500, None), ("A.two", "Failed", 0, "no"), ("A.three", "NotExecuted", 0, None)}
    total = documents.test_summary(results).first()
    assert (total["passed"], total["failed"], total["skipped"], total["total"], total["verdict"]) == (1, 1, 1, 3, "FAILED")
    assert documents.test_summary(results.limit(0)).first()["verdict"] == "EMPTY"


def test_diagnostics_and_names(spark):
    lines = spark.createDataFrame([("a.cs(3,4): error CS1: bad [p]",), ("a.cs(3,4): error CS1: bad [p]",), ("noise",), ("b.cs(1,1): warning CS2: hm",)], "value string")
    assert {(r["path"], r["line"], r["severity"], r["id"], r["message"]) for r in files.diagnostics(lines).collect()} == {("a.cs", 3, "error", "CS1", "bad"), ("b.cs", 1, "warning", "CS2", "hm")}
    names = spark.createDataFrame([(" B.b ",), ("A.a",), ("",), ("A.a",)], "value string")
    assert [r["name"] for r in files.test_names(names).collect()] == ["A.a", "B.b"]


def test_change_stream(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")

    def log(*rows):
        spark.createDataFrame([(s, p, o, None, 1) for s, p, o in rows], changes.CHANGES).coalesce(1).write.mode("append").parquet(source)

    log((1, "a.cs", "created"), (2, "A.cs", "changed"), (3, "b.xaml", "created"), (4, "x.tmp", "created"), (5, "readme.md", "created"))
    assert changes.drain(spark, source, folder)["batches"] == 1
    assert {(r["path"], r["kind"]) for r in changes.state(spark, folder).collect()} == {("A.cs", "Code"), ("b.xaml", "Xaml")}
    assert changes.drain(spark, source, folder)["batches"] == 0
    log((6, "a.cs", "deleted"), (7, "c.resx", "created"))
    changes.drain(spark, source, folder)
    assert {r["path"] for r in changes.state(spark, folder).collect()} == {"b.xaml", "c.resx"}
    assert {(r["kind"], r["generation"]) for r in changes.generations(changes.drains(spark, folder)).collect()} == {("Code", 2), ("Xaml", 1), ("Resx", 1)}
