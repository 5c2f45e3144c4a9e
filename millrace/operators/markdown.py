"""Markdown tables as rows and headings as intervals, within each text.

Only the lines of tables, or headings and fences, leave a text, each with its place; what belongs together is told by windows over the places
within a text.  Each line is touched a fixed number of times, so a text of very many lines costs time and memory in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.errors import InvalidQuery
from millrace.functions import text as tx

_UNESCAPED = r"(?<!\\)[|]"


def table(docs: DataFrame, columns: list[str], id_col: str, text_col: str) -> DataFrame:
    """Rows of all tables of each text with the asked columns, in the order asked: (id, line, columns...).

    A table is a run of lines that begin with ``|``; its first line is the header, matched ignoring case; delimiter
    lines are skipped; missing cells read ''.  A table that has none of the columns is skipped.
    """
    if not columns:
        raise InvalidQuery("no column is named", "name at least one column")
    trimmed = F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct((i + 1).alias("line"), tx.trim_any(x).alias("text")))
    only = F.filter(trimmed, lambda x: F.startswith(x["text"], F.lit("|")) & (F.length(x["text"]) > 1))
    held = docs.where(F.contains(F.col(text_col), F.lit("|"))).select(F.monotonically_increasing_id().alias("_text"), id_col, only.alias("_rows"))
    rows = held.select("_text", id_col, F.explode("_rows").alias("_r")).select("_text", id_col, F.col("_r.line").alias("line"), F.col("_r.text").alias("_line"))
    # Lines of one table follow each other, so line and place differ by the same number in all of them.
    run = F.col("line") - F.row_number().over(W.partitionBy("_text").orderBy("line"))
    in_table = W.partitionBy("_text", "_run").orderBy("line")
    rows = rows.withColumn("_run", run).withColumn("_head", F.first("_line").over(in_table)).withColumn("_nth", F.row_number().over(in_table)).where("_nth > 1")
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, r"^[|]|(?<!\\)[|]$", ""), _UNESCAPED), lambda c: F.replace(tx.trim_any(c), F.lit("\\|"), F.lit("|")))
    rows = rows.where(~F.col("_line").rlike(r"^[|:\-\s]*-[|:\-\s]*$")).select(id_col, "line", F.transform(cells("_head"), F.lower).alias("_names"), cells("_line").alias("_cells"))
    place = {c: F.array_position("_names", c.lower()) for c in columns}
    wanted = None
    for p in place.values():
        wanted = p > 0 if wanted is None else wanted | (p > 0)
    value = lambda p: F.when(p > 0, F.coalesce(F.get("_cells", (p - 1).cast("int")), F.lit("")))
    return rows.where(wanted).select(id_col, "line", *[value(p).alias(c) for c, p in place.items()])


def headers(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, header): the lower-cased names in the first line of every table, for refusing an unknown column with what there is."""
    trimmed = F.transform(F.split(F.col(text_col), "\n"), lambda x: tx.trim_any(x))
    is_row = lambda x: F.startswith(x, F.lit("|")) & (F.length(x) > 1)
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, trimmed.alias("_l"))
    firsts = F.filter("_l", lambda x, i: is_row(x) & ((i == 0) | ~F.coalesce(is_row(F.get("_l", i - 1)), F.lit(False))))
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, r"^[|]|(?<!\\)[|]$", ""), _UNESCAPED), lambda c: F.lower(F.replace(tx.trim_any(c), F.lit("\\|"), F.lit("|"))))
    return rows.select(id_col, F.explode(F.flatten(F.transform(firsts, cells))).alias("header")).distinct()


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, heading, level, start_line, end_line): headings outside fences, each to before the next of its level or higher."""
    is_fence = lambda x: x.rlike(r"^\s{0,3}(```|~~~)")
    is_heading = lambda x: x.rlike(r"^#{1,6}\s")
    lines = docs.where(F.contains(F.col(text_col), F.lit("#"))).select(F.monotonically_increasing_id().alias("_text"), id_col, F.split(F.col(text_col), "\n").alias("_l"))
    marks = F.filter(F.transform("_l", lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda x: is_fence(x["text"]) | is_heading(x["text"]))
    rows = lines.select("_text", id_col, F.size("_l").alias("_n"), F.explode(marks).alias("_m")).select("_text", id_col, "_n", F.col("_m.line").alias("start_line"), F.col("_m.text").alias("_line"))
    # A heading stands outside of fences if an even number of them stand before it.
    before = W.partitionBy("_text").orderBy("start_line").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_fences", F.coalesce(F.sum(is_fence(F.col("_line")).cast("int")).over(before), F.lit(0)))
    rows = rows.where(is_heading(F.col("_line")) & (F.col("_fences") % 2 == 0)).withColumn("level", F.length(F.regexp_extract("_line", r"^(#{1,6})\s", 1)))
    # Backwards, the least line seen so far of each level or higher is that of the next such heading.
    behind = W.partitionBy("_text").orderBy(F.col("start_line").desc()).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"_next{k}": F.min(F.when(F.col("level") <= k, F.col("start_line"))).over(behind) for k in range(1, 7)})
    after = F.coalesce(*[F.when(F.col("level") == k, F.col(f"_next{k}")) for k in range(1, 7)])
    heading = tx.trim_any(F.regexp_extract("_line", r"^#{1,6}\s+(.*)$", 1))
    return rows.select(id_col, heading.alias("heading"), "level", "start_line", F.coalesce(after - 1, F.col("_n")).alias("end_line"))
