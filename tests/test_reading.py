"""Bounded reading against a walk over the lines of each text."""

import random

import pytest

from millrace.errors import InvalidQuery
from millrace.operators import reading
from millrace.plans.workspace import Workspace


def walk(text, start=1, end=None, tail=None, most_lines=2000, budget=40_960, keep_blank=False):
    """(rows, next line, budget left) of one text, line by line."""
    lines = (text or "").split("\n")
    if lines[-1] == "":
        lines.pop()
    total = len(lines)
    if tail:
        start, end = max(1, total - tail + 1), None
    last = total if end is None else min(end, total)
    out, onward = [], None
    for number in range(start, last + 1):
        if len(out) >= most_lines or budget <= 0:
            onward = out[-1][0] + 1 if out else None
            break
        line = lines[number - 1].rstrip()
        if not line and not keep_blank:
            continue
        out.append((number, line if len(line) <= budget else f"{line[:budget]}... (+{len(line) - budget} chars)", len(line) > budget, total))
        budget -= min(len(line), budget)
    return out, onward, budget


def texts(seed):
    rng = random.Random(seed)
    line = lambda: rng.choice(["", "  ", "x", "ab \t", "é" * rng.randint(1, 30), "word " * rng.randint(1, 9)])
    made = ["\n".join(line() for _ in range(rng.randint(1, 14))) + rng.choice(["", "\n", "\n\n"]) for _ in range(60)]
    return [None, "", "\n", " ", "one", "one\r\ntwo\r\n", *made]


@pytest.mark.parametrize("how", [{}, {"start": 2, "end": 6}, {"tail": 3}, {"most_lines": 2, "keep_blank": True}, {"most_lines": 4, "most_chars": 25}, {"most_chars": 1}, {"start": 50}])
def test_windows(spark, how):
    made = list(enumerate(texts(3)))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in made], "doc_id long, text string, line string").repartition(4)
    got = {}
    for r in reading.windows(docs, **how).orderBy("doc_id", "line").collect():
        got.setdefault(r["doc_id"], []).append(r)
    same = {"budget" if k == "most_chars" else k: v for k, v in how.items()}
    for i, t in made:
        rows, onward, _ = walk(t, **same)
        assert [(r["line"], r["text"], r["is_cut"], r["total_lines"]) for r in got.get(i, [])] == rows, (i, t)
        assert {r["next_line"] for r in got.get(i, [])} == ({onward} if rows else set()), (i, t)
        assert all(r["bytes"] == len(t.encode()) for r in got.get(i, []))


def test_one_long_text_and_an_empty_table(spark):
    long = spark.createDataFrame([(1, "line of text \n" * 200_000)], "doc_id long, text string")
    rows = reading.windows(long, 150_000, most_lines=3).orderBy("line").collect()
    assert [(r["line"], r["text"], r["next_line"], r["bytes"]) for r in rows] == [(150_000 + i, "line of text", 150_003, 2_800_000) for i in range(3)]
    assert reading.windows(long.limit(0)).count() == 0
    for wrong in ({"start": 0}, {"start": 3, "end": 2}, {"tail": 0}):
        with pytest.raises(InvalidQuery):
            reading.windows(long, **wrong)


def test_a_batch_shares_one_budget(spark):
    made = {f"p{i}": t for i, t in enumerate(texts(5))}
    ws = Workspace(spark, "w", {"files": spark.createDataFrame(list(made.items()), "rel_path string, text string")})
    for paths, budget in ((["p20", "gone", "p0", "p9", "p30", "p4"], 40), (["p3", "p1", "p20"], 1000), (["p20", "p21", "p22"], len(walk(made["p20"])[0][0][1]))):
        want, left = [], budget
        for place, p in enumerate(paths, 1):
            rows, onward, after = walk(made.get(p), budget=left)
            size = None if p not in made else len((made[p] or "").encode())
            status = "NOT_FOUND" if p not in made else "CLIPPED" if left == 0 else "OK"
            want += [(place, p, status, n, t, onward, size) for n, t, _, _ in rows] or [(place, p, status, None, None, None, size)]
            left = after
        got = ws.read_texts(paths, most_chars=budget).orderBy("place", "line").collect()
        assert [(r["place"], r["rel_path"], r["status"], r["line"], r["text"], r["next_line"], r["bytes"]) for r in got] == want
    for wrong in ([], [" "], [f"p{i}" for i in range(11)]):
        with pytest.raises(InvalidQuery):
            ws.read_texts(wrong)
