"""Line search over texts: literal, regex and multi-pattern, with context, unique folding and near misses.

Texts are cut into lines inside the scan and only hits leave it, so a search has no shuffle; neighbours are sliced
from the text's own lines.  Whole texts without the literal are dropped before they are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import InvalidQuery
from millrace.functions import text as tx

MOST_PATTERNS = 10
MOST_CONTEXT = 5


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, text): lines from 1."""
    return docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("_pos", "text")).select(id_col, (F.col("_pos") + 1).alias("line"), "text")


def _checked(patterns: list[str]) -> None:
    if not patterns or any(not p.strip() for p in patterns):
        raise InvalidQuery("the query is blank", "name what to search for")
    if len(patterns) > MOST_PATTERNS:
        raise InvalidQuery(f"{len(patterns)} patterns", f"name at most {MOST_PATTERNS}")


def literal(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that contains the literal (case-sensitive): (id, line, text) with the line trimmed and cut."""
    _checked([query])
    held = docs.where(F.contains(F.col(text_col), F.lit(query)))
    return lines(held, id_col, text_col).where(F.contains("text", F.lit(query))).withColumn("text", tx.cut(tx.trim_any(F.col("text"))))


def regex(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", matches_only: bool = False) -> DataFrame:
    """One row per line that the pattern is found in; with ``matches_only`` its first match, or the line if that is blank."""
    _checked([query])
    hits = lines(docs, id_col, text_col).where(F.col("text").rlike(query))
    payload = tx.trim_any(F.col("text"))
    if matches_only:
        match = tx.trim_any(F.regexp_extract("text", query, 0))
        payload = F.when(match != "", match).otherwise(payload)
    return hits.withColumn("text", tx.cut(payload))


def multi(docs: DataFrame, queries: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that contain any of up to ten literals, tagged with all that they contain: ``q1,q3``."""
    _checked(queries)
    has = [F.contains("text", F.lit(q)) for q in queries]
    any_of = lambda c: [F.contains(c, F.lit(q)) for q in queries]
    held = docs.where(_or(any_of(F.col(text_col))))
    found = lines(held, id_col, text_col).where(_or(has))
    return found.withColumn("tags", _tags(has)).withColumn("text", tx.cut(tx.trim_any(F.col("text"))))


def _or(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def context(docs: DataFrame, query: str | list[str], around: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hits with up to ``around`` lines (0 to 5, clamped) before and after, joined by line feeds; of several literals also the tags."""
    queries = [query] if isinstance(query, str) else query
    _checked(queries)
    k = min(max(around, 0), MOST_CONTEXT)
    has = lambda c: [F.contains(c, F.lit(q)) for q in queries]
    held = docs.where(_or(has(F.col(text_col)))).select(id_col, F.split(F.col(text_col), "\n").alias("_lines"))
    hit = F.filter(F.transform("_lines", lambda line, i: F.struct((i + 1).alias("line"), line.alias("text"))), lambda h: _or(has(h["text"])))
    first = F.greatest(F.col("_hit.line") - k, F.lit(1))
    return (
        held.withColumn("_hit", F.explode(hit))
        .select(
            id_col,
            F.col("_hit.line").alias("line"),
            tx.cut(tx.trim_any(F.col("_hit.text"))).alias("text"),
            *([] if isinstance(query, str) else [_tags(has(F.col("_hit.text"))).alias("tags")]),
            F.array_join(F.slice("_lines", first, F.col("_hit.line") - first), "\n").alias("before"),
            F.array_join(F.slice("_lines", F.col("_hit.line") + 1, F.lit(k)), "\n").alias("after"),
        )
    )


def _tags(has: list[Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(h, F.lit(f"q{i}")) for i, h in enumerate(has, 1)])), ",")


def unique(hits: DataFrame, cap: int, id_col: str = "doc_id") -> DataFrame:
    """Equal payloads (with their tags and context, if any) among the first ``cap`` hits folded: the first one with ``n``."""
    capped = hits.orderBy(id_col, "line").limit(cap)
    payload = [c for c in ("text", "tags", "before", "after") if c in hits.columns]
    return capped.groupBy(*payload).agg(F.min(F.struct(id_col, "line")).alias("_first"), F.count("*").alias("n")).select(F.col(f"_first.{id_col}").alias(id_col), F.col("_first.line").alias("line"), *payload, "n")


def near_miss(docs: DataFrame, needle: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that share six leading characters with, or contain, the needle's first line of four characters or more."""
    anchor = next((x.strip() for x in needle.split("\n") if len(x.strip()) >= 4), None)
    if anchor is None:
        raise InvalidQuery("the needle has no line of four characters", "give a longer needle")
    line = tx.trim_any(F.col("text"))
    close = F.contains(line, F.lit(anchor))
    if len(anchor) >= 6:
        close = close | F.startswith(line, F.lit(anchor[:6]))
    return lines(docs, id_col, text_col).where(close).withColumn("text", tx.cut(line, 100))


def tail(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The last n lines of each text."""
    parts = F.split(F.col(text_col), "\n")
    start = F.greatest(F.size(parts) - n, F.lit(0))
    return docs.where(F.col(text_col).isNotNull()).select(id_col, start.alias("_s"), F.posexplode(F.slice(parts, start + 1, F.lit(n))).alias("_p", "text")).select(id_col, (F.col("_s") + F.col("_p") + 1).alias("line"), "text")
