"""Line difference of two texts: the one operator that is procedural, so it runs in Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Cells of one alignment table and depth of splitting; beyond both, a region is one replaced block.
MOST_CELLS = 2_000_000
MOST_DEPTH = 24
#: Lines of the text of a difference, unless more are asked for.
MOST_LINES = 1000
#: Characters of lines in an Arrow batch that goes out, about.
_BATCH_CHARACTERS = 4 << 20


def line_diff(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """Edit script: (' ', line), ('-', line) and ('+', line), removals before additions within a change.

    What both sides begin and end with is kept.  Between, a longest common subsequence is kept, additions going first where it can go either way;
    a region of more than ``MOST_CELLS`` is split at a line that is unique on both sides, else it is one replaced block.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    back = 0
    while back < min(len(old), len(new)) - head and old[-1 - back] == new[-1 - back]:
        back += 1
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(x, len(number)) for x in lines[head : len(lines) - back]], np.int64) for lines in (old, new))
    kept: list[tuple[int, int]] = []
    # A work list in reverse order, so a region's parts come out in sequence: (begin and end of both sides, depth).
    work = [(0, len(a), 0, len(b), 0)]
    while work:
        i, i_end, j, j_end, depth = work.pop()
        if (i_end - i) * (j_end - j) <= MOST_CELLS:
            kept += [(i + x, j + y) for x, y in _common(a[i:i_end], b[j:j_end])]
        elif depth < MOST_DEPTH and (pivot := _anchor(a[i:i_end].tolist(), b[j:j_end].tolist())) is not None:
            x, y = i + pivot[0], j + pivot[1]
            # The pivot is a region of one equal line.
            work += [(x + 1, i_end, y + 1, j_end, depth + 1), (x, x + 1, y, y + 1, depth + 1), (i, x, j, y, depth + 1)]
    out, i, j = [(" ", x) for x in old[:head]], 0, 0
    for x, y in [*kept, (len(a), len(b))]:
        out += [("-", k) for k in old[head + i : head + x]] + [("+", k) for k in new[head + j : head + y]]
        if x < len(a):
            out.append((" ", old[head + x]))
        i, j = x + 1, y + 1
    return out + [(" ", x) for x in old[len(old) - back :]]


def _anchor(a: list[int], b: list[int]) -> tuple[int, int] | None:
    """A line that is unique on both sides, nearest the middle of the first, the earlier of two."""
    once_a, once_b = Counter(a), Counter(b)
    place = {x: j for j, x in enumerate(b) if once_b[x] == 1}
    found = [(abs(i - len(a) // 2), i, place[x]) for i, x in enumerate(a) if once_a[x] == 1 and x in place]
    return min(found)[1:] if found else None


def _common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, from a table of suffix lengths that is filled by diagonals."""
    n, m = len(a), len(b)
    table = np.zeros((n + 1, m + 1), np.int32)
    for k in range(n + m - 2, -1, -1):
        i = np.arange(max(0, k - m + 1), min(n, k + 1))
        j = k - i
        table[i, j] = np.where(a[i] == b[j], table[i + 1, j + 1] + 1, np.maximum(table[i + 1, j], table[i, j + 1]))
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i, j + 1] >= table[i + 1, j]:
            j += 1
        else:
            i += 1
    return out


def lines_of(text: str | None) -> list[str]:
    """Lines with either ending; a null text is the empty text, one empty line."""
    return (text or "").replace("\r\n", "\n").split("\n")


def diff_texts(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """``pairs`` with ``added``, ``deleted`` and ``script`` (one line per kept, removed or added line); null is the empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scripts = [line_diff(lines_of(o), lines_of(n)) for o, n in zip(frame[old], frame[new], strict=True)]
            frame["added"] = [sum(k == "+" for k, _ in s) for s in scripts]
            frame["deleted"] = [sum(k == "-" for k, _ in s) for s in scripts]
            frame["script"] = ["\n".join(k + x for k, x in s) for s in scripts]
            yield frame

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{fields}, added long, deleted long, script string")


def changes(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(old start, old count, new start, new count) of what differs, starts from 1: the stretches of the edit script between kept lines."""
    out, i, j = [], 0, 0
    a, b = 0, 0
    for kind, _ in [*line_diff(old, new), (" ", "")]:
        if kind == " ":
            if (i, j) != (a, b):
                out.append((a + 1, i - a, b + 1, j - b))
            i, j = i + 1, j + 1
            a, b = i, j
        elif kind == "-":
            i += 1
        else:
            j += 1
    return out


_HUNK = "hunk int, old_start int, old_count int, new_start int, new_count int, removed array<string>, added array<string>"


def hunks_between(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """The columns of ``pairs`` but the two texts, with each of their hunks: number, places, and the lines removed and added.

    Texts are null or empty: one empty line.  Equal texts have no hunks.
    """
    kept = [f for f in pairs.schema.fields if f.name not in (old, new)]
    source = pairs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(old).alias("_old"), F.col(new).alias("_new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0

            def made() -> pa.RecordBatch:
                owner, *columns = zip(*rows, strict=True)
                kinds = [pa.int32()] * 5 + [pa.list_(pa.string())] * 2
                own = [batch.column(c).take(pa.array(owner, pa.int64())) for c in range(len(kept))]
                return pa.RecordBatch.from_arrays(own + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.name for f in kept] + [x.split()[0] for x in _HUNK.split(", ")])

            for r in range(batch.num_rows):
                was, now = (lines_of(batch.column(len(kept) + c)[r].as_py()) for c in (0, 1))
                for n, (i, x, j, y) in enumerate(changes(was, now), 1):
                    removed, added = was[i - 1 : i - 1 + x], now[j - 1 : j - 1 + y]
                    rows.append((r, n, i, x, j, y, removed, added))
                    held += sum(map(len, removed)) + sum(map(len, added))
                    if held > _BATCH_CHARACTERS or len(rows) >= 4096:
                        yield made()
                        rows, held = [], 0
            if rows:
                yield made()

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return source.mapInArrow(run, fields + _HUNK)


def unified(found: DataFrame, keys: list[str], most: int = MOST_LINES) -> DataFrame:
    """(keys, changed, lines, diff): the hunks of each pair as unified text of at most ``most`` lines.

    ``changed`` sums the longer side of each hunk, ``lines`` is how many lines the whole text has.  A hunk that begins beyond the bound is
    dropped before anything is gathered, so no task holds more than about ``most`` lines of a pair and the hunk that crosses it.
    """
    sign = lambda mark, lines: F.transform(lines, lambda x: F.concat(F.lit(mark), x))
    number = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit("@@ -"), number("old_start"), F.lit(","), number("old_count"), F.lit(" +"), number("new_start"), F.lit(","), number("new_count"), F.lit(" @@"))
    size = F.col("old_count") + F.col("new_count") + 1
    totals = found.groupBy(*keys).agg(F.sum(F.greatest("old_count", "new_count")).alias("changed"), F.sum(size).alias("lines"))
    above = F.coalesce(F.sum(size).over(W.partitionBy(*keys).orderBy("hunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shown = found.withColumn("_above", above).where(F.col("_above") < most)
    body = F.slice(F.concat(F.array(head), sign("-", F.col("removed")), sign("+", F.col("added"))), F.lit(1), (F.lit(most) - F.col("_above")).cast("int"))
    parts = shown.select(*keys, F.struct("hunk", body.alias("body")).alias("_part")).groupBy(*keys).agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    joined = totals.join(parts, [totals[k].eqNullSafe(parts[k]) for k in keys])
    return joined.select(*[totals[k] for k in keys], "changed", "lines", F.array_join(F.flatten(F.transform("_parts", lambda x: x["body"])), "\n").alias("diff"))


def replayed(texts: DataFrame, found: DataFrame, keys: list[str], old: str) -> DataFrame:
    """(keys, text): the old texts with their hunks applied, which gives the new ones; texts without hunks stay."""
    columns = ["old_start", "old_count", "added"]
    gathered = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("hunk", *columns))).alias("_hunks"))
    joined = texts.join(gathered, [texts[k].eqNullSafe(gathered[k]) for k in keys], "left").select(*[texts[k] for k in keys], F.split(F.regexp_replace(F.coalesce(old, F.lit("")), "\r\n", "\n"), "\n").alias("_was"), F.coalesce("_hunks", F.array().cast(gathered.schema["_hunks"].dataType)).alias("_hunks"))
    # Each hunk brings the kept lines since the one before and its own; the rest of the text follows the last.
    ends = joined.withColumn("_ends", F.concat(F.array(F.lit(1)), F.transform("_hunks", lambda h: h["old_start"] + h["old_count"])))
    pieces = F.transform("_hunks", lambda h, i: F.concat(F.slice("_was", F.get("_ends", i), h["old_start"] - F.get("_ends", i)), h["added"]))
    rest = F.slice("_was", F.get("_ends", F.size("_hunks")), F.greatest(F.size("_was") - F.get("_ends", F.size("_hunks")) + 1, F.lit(0)))
    return ends.select(*keys, F.array_join(F.concat(F.flatten(pieces), rest), "\n").alias("text"))


def hunks(unified: DataFrame, line_col: str, order_col: str) -> DataFrame:
    """(path, start, count) of the new side of unified diff lines; a missing count is 1."""
    header = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    path = F.last(F.when(F.startswith(line_col, F.lit("+++ b/")), F.substr(line_col, F.lit(7))), ignorenulls=True).over(W.partitionBy("file").orderBy(order_col))
    found = unified.withColumn("path", path).where(F.col(line_col).rlike(header))
    count = F.regexp_extract(line_col, header, 2)
    return found.select("path", F.regexp_extract(line_col, header, 1).cast("int").alias("start"), F.when(count == "", 1).otherwise(F.expr("try_cast(regexp_extract(" + line_col + ", '" + header.replace("\\", "\\\\") + "', 2) as int)")).alias("count"))
