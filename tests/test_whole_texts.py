"""Patterns across lines, mentions, hunks, lineage and long texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidQuery
from millrace.operators import components, diff, grep, joins, markdown, mentions, rules
from millrace.plans.workspace import Workspace

# ---------------------------------------------------------------- patterns


def plain_records(text, patterns):
    """(line, places of patterns, match) by the plainest search: one compiled pattern after another, from each place on."""
    compiled = [re.compile(p, re.MULTILINE) for p in patterns]
    out, at = [], 0
    while at < len(text):
        found = [(m.start(), q, m) for q, p in enumerate(compiled) if (m := p.search(text, at))]
        if not found:
            break
        start, q, m = min(found, key=lambda x: x[:2])
        inside = [i for i in range(m.start(), m.end()) if text[i] not in " \t\r\n\f\v"]
        place = inside[0] if inside else start
        line = text.count("\n", 0, place)
        own = text.split("\n")[line]
        out.append((line + 1, [i for i, p in enumerate(compiled) if i == q or p.search(own)] if len(patterns) > 1 else [q], m[0]))
        resumed = start if len(patterns) > 1 else max(m.end() - 1, start)
        end = text.find("\n", resumed)
        at = (len(text) if end < 0 else end) + 1
    return out


@pytest.mark.parametrize("patterns", [["a\\nb"], ["\\s+b"], ["^$"], ["b$"], ["\\n"], ["x*"], ["[^a]+"], ["a", "\\nb"], ["(a|b)+", "x"], ["b\\n+", "a.", "^x"]])
def test_records_like_a_plain_search(patterns):
    rng = random.Random(str(patterns))
    import regex

    compiled = [regex.compile(p, regex.MULTILINE) for p in patterns]
    for _ in range(300):
        text = "".join(rng.choice("abx \n\n") for _ in range(rng.randrange(0, 25)))
        got = [(line, on, hit) for line, hit, on, _, _ in grep.matches(text, compiled, matches_only=True)]
        want = [(line, on, m if m.strip() else text.split("\n")[line - 1]) for line, on, m in plain_records(text, patterns)]
        assert got == want, (text, patterns)


def test_context_of_records():
    import regex

    text = "one\ntwo\nthree\nfour\nfive"
    got = list(grep.matches(text, [regex.compile("three|one|five")], context=2))
    assert [(line, before, after) for line, _, _, before, after in got] == [(1, "", "two\nthree"), (3, "one\ntwo", "four\nfive"), (5, "three\nfour", "")]


def test_patterns_within_lines():
    assert all(grep.within_lines(p) for p in ("[A-Z][a-z]+", r"R\w+", r"a|b\.c", "x+y*?", "ab"))
    assert not any(grep.within_lines(p) for p in ("a\\nb", "[^a]+", r"\s", "(a+)+", "a.b", "^a", "a$", "a{2,}", "(?s)a", "a++", r"[\s]", r"\W"))


def test_grep_frames(spark):
    docs = spark.createDataFrame([(1, "a\n  \nb b\nab"), (2, None), (3, ""), (4, "A" * 50_000 + "!")], "doc_id long, text string")
    assert [tuple(r) for r in grep.grep(docs, r"\s+b", matches_only=True).collect()] == [(1, 3, "b")]
    late = docs.unionByName(spark.createDataFrame([(5, "b\n" + "a" * 60 + "!")], "doc_id long, text string"))
    slow = r"^b|(a|aa)+$"
    assert [tuple(r) for r in grep.grep(late, slow, seconds=0.3).where("doc_id = 5").collect()] == [(5, 1, "b")]
    assert {r["doc_id"] for r in grep.unfinished(late, slow, seconds=0.3).collect()} >= {5}
    with pytest.raises(InvalidQuery):
        grep.grep(docs, "(")
    with pytest.raises(InvalidQuery):
        grep.grep(docs, [])


# ---------------------------------------------------------------- mentions


def test_mentions(spark):
    rows = [("a.cs", "A.B.c = A;\nx9 _y"), ("b.cs", None), ("c.cs", "A.B 9z")]
    files = spark.createDataFrame(rows, "rel_path string, text string")
    got = sorted((r["rel_path"], r["line"], r["token"]) for r in mentions.index(files).collect())
    assert got == [("a.cs", 1, t) for t in ("A", "A.B.c", "B", "c")] + [("a.cs", 2, "_y"), ("a.cs", 2, "x9"), ("c.cs", 1, "A"), ("c.cs", 1, "A.B"), ("c.cs", 1, "B"), ("c.cs", 1, "z")]
    assert {(r["token"], r["lines"], r["texts"]) for r in mentions.counts(files).collect()} >= {("A", 2, 2), ("c", 1, 1)}
    keys = spark.createDataFrame([("B",), ("gone",), (None,)], "key string")
    assert sorted(tuple(r) for r in mentions.of_keys(files, keys).select("rel_path", "line", "key").collect()) == [("a.cs", 1, "B"), ("c.cs", 1, "B")]
    many = spark.range(100).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).unionByName(keys)
    assert mentions.of_keys(files, many).count() == 2


def test_key_usages(spark):
    text = '\n'.join(['GetString("Save.Now")', 'x . Save.Now;', '"Save.Now"', 'Save.Now', 'SaveXNow . y', 'localizer["Save.Now"]', '<a x:Uid="Save.Now"/>', 'a.Save.NowThen'])
    files = spark.createDataFrame([("a.cs", text), ("b.Designer.cs", text), ("c.txt", text), ("d.cs", 'GetString(a + "b")\nlocalizer[k]')], "rel_path string, text string")
    ws = Workspace(spark, "w", {"files": files})
    exact = spark.createDataFrame([("A.cs", 3, "S.Save")], "path string, line int, form string")
    got = ws.resx_key_usages("Save.Now", exact).collect()
    assert [(r["path"], r["line"], r["form"], r["confidence"]) for r in got] == [("A.cs", 3, "S.Save", "EXACT"), ("a.cs", 1, "GetString", "HEURISTIC"), ("a.cs", 2, "member", "HEURISTIC"), ("a.cs", 6, "localizer[]", "HEURISTIC"), ("a.cs", 7, "x:Uid", "HEURISTIC")]
    assert {r["composed"] for r in got} == {2}
    with pytest.raises(InvalidQuery):
        ws.resx_key_usages("")


# ---------------------------------------------------------------- hunks


def applied(old, found):
    out, at = [], 1
    for start, count, _, _, _, added in found:
        out += old[at - 1 : start - 1] + added
        at = start + count
    return out + old[at - 1 :]


def test_hunks_replay(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randrange(12))), "\n".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for i in range(200)]
    rows += [(200, None, "a"), (201, "a", None), (202, None, None), (203, "a\r\nb", "a\nb"), (204, "x\n" * 3000 + "y", "x\n" * 2999 + "z\ny")]
    pairs = spark.createDataFrame(rows, "id long, old string, new string")
    hunks = diff.hunks_between(pairs, "old", "new").cache()
    by = {}
    for r in hunks.orderBy("id", "hunk").collect():
        by.setdefault(r["id"], []).append(tuple(r)[2:])
    for i, old, new in rows:
        was, now = diff.lines_of(old), diff.lines_of(new)
        found = by.get(i, [])
        assert applied(was, found) == now
        for start, count, new_start, new_count, removed, added in found:
            assert was[start - 1 : start - 1 + count] == removed and now[new_start - 1 : new_start - 1 + new_count] == added and count + new_count
        # Between two hunks a line is kept.
        assert all(b[0] > a[0] + a[1] and b[2] > a[2] + a[3] for a, b in zip(found, found[1:], strict=False))
    assert {r["id"]: r["text"] for r in diff.replayed(pairs.select("id", "old"), hunks, ["id"], "old").collect()} == {i: "\n".join(diff.lines_of(new)) for i, _, new in rows}
    for r in diff.unified(hunks, ["id"], 7).collect():
        whole = [x for f in by[r["id"]] for x in [f"@@ -{f[0]},{f[1]} +{f[2]},{f[3]} @@", *("-" + y for y in f[4]), *("+" + y for y in f[5])]]
        assert r["diff"].split("\n") == whole[:7] and r["lines"] == len(whole) and r["changed"] == sum(max(f[1], f[3]) for f in by[r["id"]])


def test_equal_hunks_stay_apart(spark):
    hunks = spark.createDataFrame([("f", 3, 1), ("f", 3, 1), ("f", 3, 0), ("f", 3, 9)], "path string, start int, count int")
    symbols = spark.createDataFrame([("S", "f", 2, 5)], "id string, path string, start_line int, end_line int")
    got = sorted(((r["count"], r["symbol"]) for r in Workspace(spark, "w", {"hunks": hunks, "symbols": symbols}).diff_symbols().collect()), key=str)
    assert got == [(0, "S"), (1, "S"), (1, "S"), (9, None)]


# ---------------------------------------------------------------- members and lineage


def test_long_member_paths(spark):
    members = spark.createDataFrame([(f"T{i}", "m", f"T{i + 1}") for i in range(30)], "type string, member string, member_type string")
    paths = spark.createDataFrame([(".".join(["m"] * n),) for n in (1, 8, 9, 12, 30)] + [(".".join(["m"] * 11 + ["x", "m"]),)], "p string").withColumn("start", F.lit("T0"))
    got = {r["p"]: (r["resolved"], r["broken"]) for r in joins.member_walk(paths, members, "p", "start", None).collect()}
    assert got == {p: (False, "x") if "x" in p else (True, None) for p in got} and len(got) == 6
    nodes = spark.createDataFrame([("c.razor", 1, "Card", "Card", True, [("@bind-Value", ".".join(["m"] * 12))])], "path string, line int, tag string, node_path string, is_component boolean, attributes array<struct<name:string,expression:string>>")
    own = members.withColumnRenamed("type", "component").withColumn("settable", F.lit(True))
    context = spark.createDataFrame([("c.razor", "T0")], "path string, component string")
    assert components.checked_sites(nodes, own, context).first()["verdict"] == "OK"


def test_bases_come_before_interfaces(spark):
    edges = spark.createDataFrame([("C", "B", False), ("B", "A", False), ("C", "I", True), ("I", "J", True), ("K", "I", True)], "derived string, base string, is_interface boolean")
    members = spark.createDataFrame([("A", "x", "FromA", True), ("I", "x", "FromI", True), ("J", "y", "FromJ", False), ("C", "z", "Own", True), ("B", "z", "Hidden", True), ("Lone", "x", "L", True)], "component string, member string, member_type string, settable boolean")
    got = {(r["type"], r["member"]): r["member_type"] for r in components.inherited(members, edges).collect()}
    assert got[("C", "x")] == "FromA" and got[("C", "y")] == "FromJ" and got[("C", "z")] == "Own" and got[("K", "x")] == "FromI" and got[("K", "y")] == "FromJ" and got[("Lone", "x")] == "L"
    refs = spark.createDataFrame([("p", "C", t) for t in ("C", "B", "A", "I", "J", "K")], "path string, component string, field_type string")
    assert [r["detail"] for r in rules.reference_types(refs, edges.withColumnRenamed("derived", "type")).collect()] == ["K"]


def test_bindings_through_bases(spark):
    elements = spark.createDataFrame([("v", 1, {"A": "{Binding x.y}", "B": "{Binding x.gone}"})], "file string, line int, attributes map<string,string>")
    members = spark.createDataFrame([("Base", "x", "T"), ("TBase", "y", "S")], "type string, member string, member_type string")
    edges = spark.createDataFrame([("VM", "Base", False), ("T", "TBase", True)], "derived string, base string, is_interface boolean")
    got = Workspace(spark, "w", {"elements": elements, "type_edges": edges}).xaml_bindings("v", members, "VM").collect()
    assert [(r["binding"], r["resolved"], r["broken"]) for r in got] == [("x.y", True, None), ("x.gone", False, "gone")]


# ---------------------------------------------------------------- long texts


def test_markdown_of_very_many_lines(spark):
    n = 100_000
    text = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(n))
    heads = "\n".join("#" * (1 + i % 3) + f" h{i}" for i in range(n))
    docs = spark.createDataFrame([(1, text), (1, "| a |\n| q |")], "id long, text string")
    rows = markdown.table(docs, ["A"], "id", "text")
    assert rows.count() == n + 1 and rows.agg(F.max("line")).first()[0] == n + 2
    found = {r["start_line"]: r["end_line"] for r in markdown.sections(spark.createDataFrame([(1, heads)], "id long, text string"), "id", "text").collect()}
    assert len(found) == n and found[1] == 3 and found[2] == 3 and found[3] == 3 and found[n] == n
