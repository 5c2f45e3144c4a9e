"""Patterns over whole texts: a match may cross lines, and what the pattern sees is the text, not a line of it.

At most one record a line: after a match the search goes on behind the line that it ends in (of several patterns: that it begins in).
A match is reported at the line of its first character that is not blank.  Java's engine can neither say where a match is nor be stopped, and
it fails on deep groups; so texts are searched where they are read, in Arrow batches, by an engine that takes a time limit.  Patterns that
cannot leave their line and hold no groups stay with ``search.regex``, in the JVM (``within_lines``).
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.errors import InvalidQuery
from millrace.functions import text as tx
from millrace.operators import search

#: Seconds that the search of one text may take.
MOST_SECONDS = 2.0
#: Rows of an Arrow batch that goes out, and characters of text in it, about.
_BATCH = 4096
_BATCH_CHARACTERS = 4 << 20
_BLANK = " \t\r\n\f\v"
_PLAIN = re.compile(r"(?:[^\\\[\](){}*+?|^$.\n]|\\[dw.\\\[\](){}*+?|^$/-]|\[[^\]\[\\^][^\]\[\\]*+\]|\||[*+?](?!\+))++\Z")


def within_lines(pattern: str) -> bool:
    """Whether the pattern can match nothing across lines, has no groups, and so finds the same line by line."""
    return _PLAIN.match(pattern) is not None


def _compiled(patterns: list[str]) -> list:
    import regex

    out = []
    for p in patterns:
        try:
            out.append(regex.compile(p, regex.MULTILINE))
        except regex.error as e:
            raise InvalidQuery(f"the pattern {p!r} can't be read: {e}", "correct it") from e
    return out


def matches(text: str, compiled: list, matches_only: bool = False, context: int = 0, seconds: float = MOST_SECONDS) -> Iterator[tuple]:
    """(line, payload, places of patterns on it, before, after) of each record; ``TimeoutError`` if the time is up."""
    several, end = len(compiled) > 1, time.monotonic() + seconds
    ahead: list = [None] * len(compiled)
    at, line, counted = 0, 1, 0
    while at < len(text):
        best = None
        for q, pattern in enumerate(compiled):
            if ahead[q] is None or (ahead[q] and ahead[q].start() < at):
                left = end - time.monotonic()
                if left <= 0:
                    raise TimeoutError
                ahead[q] = pattern.search(text, at, timeout=left) or False
            if ahead[q] and (best is None or ahead[q].start() < ahead[best].start()):
                best = q
        if best is None:
            return
        found = ahead[best]
        hit = found[0]
        place = found.start() + (len(hit) - len(hit.lstrip(_BLANK)) if hit.strip(_BLANK) else 0)
        line += text.count("\n", counted, place)
        counted = place
        begin, stop = text.rfind("\n", 0, place) + 1, _line_end(text, place)
        own = text[begin:stop]
        on = [q for q, p in enumerate(compiled) if q == best or p.search(own, timeout=seconds)] if several else [best]
        before = text[_back(text, begin, context) : max(begin - 1, 0)] if context else ""
        after = text[stop + 1 : _forth(text, stop, context)] if context else ""
        yield line, hit if matches_only and hit.strip() else own, on, before, after
        at = _line_end(text, found.start() if several else max(found.end() - 1, found.start())) + 1


def _line_end(text: str, at: int) -> int:
    found = text.find("\n", at)
    return len(text) if found < 0 else found


def _back(text: str, begin: int, lines: int) -> int:
    for _ in range(lines):
        if not begin:
            break
        begin = text.rfind("\n", 0, begin - 1) + 1
    return begin


def _forth(text: str, stop: int, lines: int) -> int:
    for _ in range(lines):
        if stop >= len(text):
            break
        stop = _line_end(text, stop + 1)
    return stop


def grep(docs: DataFrame, patterns: str | list[str], id_col: str = "doc_id", text_col: str = "text", matches_only: bool = False, context: int = 0, seconds: float = MOST_SECONDS) -> DataFrame:
    """(id, line, text) of all records; of several patterns also the ``tags``, with ``context`` (0 to 5) also ``before`` and ``after``.

    A text whose search takes more than ``seconds`` keeps the records found until then; see ``unfinished``.  Null texts have none, and an
    empty text has no line to report.
    """
    return _searched(docs, patterns, id_col, text_col, matches_only, context, seconds).where("_line is not null").drop("_late").withColumnRenamed("_line", "line")


def unfinished(docs: DataFrame, patterns: str | list[str], id_col: str = "doc_id", text_col: str = "text", seconds: float = MOST_SECONDS) -> DataFrame:
    """(id) of the texts whose search ran out of time."""
    return _searched(docs, patterns, id_col, text_col, False, 0, seconds).where("_late").select(id_col)


def _searched(docs: DataFrame, patterns: str | list[str], id_col: str, text_col: str, matches_only: bool, context: int, seconds: float) -> DataFrame:
    asked = [patterns] if isinstance(patterns, str) else list(patterns)
    search._checked(asked)
    _compiled(asked)
    context = min(max(context, 0), search.MOST_CONTEXT)
    source = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _compiled(asked)
        for batch in batches:
            rows: list[tuple] = []
            held = 0

            def made() -> pa.RecordBatch:
                owner, line, text, on, before, after, late = zip(*rows, strict=True)
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(line, pa.int32()), pa.array(text, pa.string()), pa.array(on, pa.list_(pa.int32())), pa.array(before, pa.string()), pa.array(after, pa.string()), pa.array(late, pa.bool_())]
                return pa.RecordBatch.from_arrays(columns, names=["_id", "_line", "text", "_on", "before", "after", "_late"])

            for i in range(batch.num_rows):
                try:
                    for line, text, on, before, after in matches(batch.column(1)[i].as_py(), compiled, matches_only, context, seconds):
                        rows.append((i, line, text, on, before, after, False))
                        held += len(text) + len(before) + len(after)
                        if len(rows) >= _BATCH or held >= _BATCH_CHARACTERS:
                            yield made()
                            rows, held = [], 0
                except TimeoutError:
                    rows.append((i, None, None, [], None, None, True))
            if rows:
                yield made()

    found = source.mapInArrow(run, f"_id {kind}, _line int, text string, _on array<int>, before string, after string, _late boolean")
    tags = F.array_join(F.transform("_on", lambda q: F.concat(F.lit("q"), (q + 1).cast("string"))), ",")
    return found.select(
        F.col("_id").alias(id_col),
        "_line",
        tx.cut(tx.trim_any(F.col("text"))).alias("text"),
        *([tags.alias("tags")] if len(asked) > 1 else []),
        *(["before", "after"] if context else []),
        "_late",
    )
