"""What steps move does not follow the input through the driver, one task or all pairs."""

import numpy as np
import pytest

from millrace.llm import lm_scoring
from millrace.operators import graph, joins
from millrace.plans.workspace import Workspace


@pytest.fixture
def rounds(spark, monkeypatch):
    """The plans of what is cut with ``checkpoint()``."""
    kind, found = type(spark.range(0)), []
    cut = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: (found.append(self._jdf.queryExecution().executedPlan().toString()), cut(self, *a, **k))[1])
    monkeypatch.setattr(graph, "MOST_BROADCAST", 2, raising=False)
    return found


def _tree(spark):
    return spark.range(1, 40).selectExpr("concat('t', id) AS derived", "concat('t', id div 3) AS base")


def test_closure_broadcasts_only_small_fronts(spark, rounds):
    got = {r["reached"]: r["depth"] for r in graph.closure(_tree(spark), "base", "derived", spark.createDataFrame([("t1",)], "t string")).collect()}
    assert got == {"t1": 0} | {f"t{k}": 1 for k in (3, 4, 5)} | {f"t{k}": 2 for k in range(9, 18)} | {f"t{k}": 3 for k in range(27, 40)}
    # A front of one row goes to all tasks; edges and larger fronts do not.
    assert len(rounds) == 6 and "Broadcast" in rounds[2] and not any("Broadcast" in p for p in rounds[3:])


def test_doubled_closure_broadcasts_nothing(spark, rounds):
    line = spark.createDataFrame([(i, i + 1) for i in range(11)], "f long, t long")
    assert graph.closure(line, "f", "t").count() == 12 * 13 // 2
    assert not any("Broadcast" in p for p in rounds)


def test_explore_symbol_broadcasts_no_type_edges(spark, rounds):
    t = spark.createDataFrame
    refs = t([("t1", "a.cs", False, False), ("t1", "b.cs", False, False), ("t2", "a.cs", False, False)], "symbol_id string, path string, is_implicit boolean, is_generated boolean")
    ws = Workspace(spark, "w", {"symbols": t([("a.cs", True)], "path string, is_test boolean"), "refs": refs, "type_edges": _tree(spark)})
    assert [tuple(r) for r in ws.explore_symbol("t1").collect()] == [(2, 1, 2, 25)]
    assert len(rounds) == 6 and not any("Broadcast" in p for p in rounds[3:])


def test_explore_symbol_broadcasts_no_type_edges_as_executed(spark, monkeypatch):
    kind, ran = type(spark.range(0)), []
    cut = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: (cut(self, *a, **k), ran.append(_plan(self)))[0])
    monkeypatch.setattr(graph, "MOST_BROADCAST", 2, raising=False)
    ws = Workspace(spark, "w", {"symbols": spark.sql("SELECT 'a.cs' AS path, true AS is_test"), "refs": spark.sql("SELECT 't1' AS symbol_id, 'a.cs' AS path, false AS is_implicit, false AS is_generated"), "type_edges": _tree(spark)})
    assert [tuple(r) for r in ws.explore_symbol("t1").collect()] == [(1, 1, 1, 25)]
    # Adaptive execution, which could turn a planned shuffle into a broadcast, leaves the rounds of larger fronts as planned.
    assert all("isFinalPlan=true" in p and "Broadcast" not in p for p in ran[-3:])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_containment_keeps_one_span_of_the_same_lines(spark):
    hunks = spark.createDataFrame([(1, "f", 2, 2), (2, "f", 70, 70), (3, None, 1, 1)], "id long, path string, a int, b int")
    spans = spark.range(1000).selectExpr("concat('s', 1000 + id) AS span", "'f' AS path", "cast(id % 2 AS int) AS s", "cast(id % 2 + 2 AS int) AS e").unionByName(spark.createDataFrame([(None, "f", 0, 2)], "span string, path string, s int, e int"))
    found = joins.containment(hunks, spans, "path", "a", "b", "s", "e", "span", "id")
    # A span without an id comes last, as in SQL.
    assert {r["id"]: (r["span"], r["confidence"]) for r in found.collect()} == {1: ("s1000", "EXACT"), 2: (None, "HEURISTIC"), 3: (None, "HEURISTIC")}
    plan = _plan(found)
    assert "min(span" in plan and "Broadcast" not in plan


def test_diff_symbols_keeps_equal_hunks(spark):
    t = spark.createDataFrame
    hunks = t([("f", 2, 1)] * 3 + [("f", 2, 0), (None, 1, 1), (None, 1, 1), ("f", None, 1)], "path string, start int, count int")
    ws = Workspace(spark, "w", {"hunks": hunks, "symbols": t([("a", "f", 1, 3), ("b", "f", 1, 3)], "id string, path string, start_line int, end_line int")})
    found = ws.diff_symbols()
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted([("f", 2, 1, 2, "f:2", "a", "EXACT")] * 3 + [("f", 2, 0, 2, "f:2", "a", "EXACT")] + [(None, 1, 1, 1, "1", None, "HEURISTIC")] * 2 + [("f", None, 1, None, "f", None, "HEURISTIC")], key=str)
    assert "Broadcast" not in _plan(found)


def test_overloads_compare_shapes(spark, monkeypatch):
    kind, rows = type(spark.range(0)), []
    cut = kind.checkpoint

    def counted(self, *a, **k):
        done = cut(self, *a, **k)
        rows.append(done.count())
        return done

    monkeypatch.setattr(kind, "checkpoint", counted)
    symbols = spark.range(3000).selectExpr("'Run' AS name", "concat('N.C', id % 3) AS container", "cast(id AS string) AS id", "CASE WHEN id % 2 = 0 THEN array('X.int') END AS parameters")
    symbols = symbols.unionByName(spark.createDataFrame([("Run", None, "z", ["int"]), ("Run", "N.C1", None, ["int"])], "name string, container string, id string, parameters array<string>"))
    asked = spark.range(4000).selectExpr("concat('C', id % 4, '.Run(int)') AS q").unionByName(spark.createDataFrame([("Run(int)",), ("Run( )",), (None,), ("N.C2.Run",), ("N.C2.Run",)], "q string"))
    got = {r["asked"]: (r["status"], r["n"], r["ids"]) for r in joins.resolve_overloads(asked, symbols, "q").collect()}
    ids = lambda keep: ",".join(sorted(str(i) for i in range(3000) if keep(i))[:10])
    want = {f"C{c}.Run(int)": ("ambiguous", 500, ids(lambda i, c=c: i % 3 == c and i % 2 == 0)) for c in range(3)} | {"C3.Run(int)": ("missing", 0, ""), None: ("missing", 0, ""), "N.C2.Run": ("ambiguous", 1000, ids(lambda i: i % 3 == 2))}
    want |= {"Run(int)": ("saturated", 1501, ids(lambda i: i % 2 == 0)), "Run( )": ("saturated", 0, "")}
    assert got == want
    # References, kinds of symbols and what fits: none of them follows the equal ones.
    assert rows == [8, 7, 9]


def test_steps_take_the_bits_of_their_differences():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1 << 36, (1 << 36) + (1 << 29), 5000, dtype=np.uint64))
    blob = lm_scoring.to_steps(keys)
    assert (lm_scoring.from_steps(blob) == keys).all() and len(blob) < 2.7 * len(keys)
    for values in (keys, np.array([0, 1, 2, 1 << 63], np.uint64), keys[:0], rng.integers(0, 3, 5001).astype(np.uint64)):
        assert (lm_scoring.from_planes(lm_scoring.to_planes(values, True)) == values).all()
