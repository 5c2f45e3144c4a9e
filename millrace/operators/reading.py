"""Bounded reading of many texts at once: a range of lines of each, within a number of lines and a budget of characters.

Lines are cut out, stripped at the end and numbered where the text is read, and at most ``most_lines`` of each text leave it; a window over a text, or
over a batch of texts that share one budget, tells where the budget ends.

Defined results
---------------
* a line feed at the end of a text begins no line; a null text is an empty one, and an empty text has no rows;
* blank lines are left out and cost nothing, unless ``keep_blank``; they keep their numbers;
* the line that the budget ends in is cut there, with a mark of what is missing; later lines are left out;
* ``next_line`` is where to go on reading, null if the range was read to its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.errors import InvalidQuery

# What is read where nothing else is asked, and the most that can be asked.
LINES, MOST_LINES = 2_000, 20_000
CHARACTERS, MOST_CHARACTERS = 40_960, 131_072


def windows(docs: DataFrame, start: int = 1, end: int | None = None, tail: int | None = None, most_lines: int = 0, most_chars: int = 0, keep_blank: bool = False, id_col: str = "doc_id", text_col: str = "text", batch: list[str] | None = None) -> DataFrame:
    """(id, line, text, is_cut, is_last, total_lines, next_line, bytes) of each text; ``is_last`` tells where the budget ends, ``bytes`` is the UTF-8 length of the whole text.

    Zero limits are the usual ones.  With ``tail`` the range is the last lines.  ``batch`` names columns whose order (then the id) is that of texts that
    share one budget: all texts then meet in one window, so hand in only as many as one answer holds.
    """
    if start < 1 or (end is not None and end < start) or (tail is not None and tail < 1):
        raise InvalidQuery("the range of lines is empty", "start at 1 or later and end at the start or later")
    n = min(most_lines, MOST_LINES) if most_lines > 0 else LINES
    budget = min(most_chars, MOST_CHARACTERS) if most_chars > 0 else CHARACTERS
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = batch or []
    held = docs.select(F.monotonically_increasing_id().alias("_text"), id_col, *order, F.octet_length(text).cast("long").alias("bytes"), F.split(F.regexp_replace(text, r"\n\z", ""), "\n").alias("_l"), (F.length(text) > 0).alias("_any"))
    held = held.where("_any").withColumn("total_lines", F.size("_l"))
    first = F.greatest(F.col("total_lines") - (tail - 1), F.lit(1)) if tail else F.lit(start)
    last = F.least(F.lit(end), F.col("total_lines")) if end is not None and not tail else F.col("total_lines")
    numbered = F.transform("_l", lambda x, i: F.struct((i + 1).alias("line"), F.regexp_replace(x, r"\s+\z", "").alias("text")))
    asked = F.filter(numbered, lambda x: x["line"].between(F.col("_first"), F.col("_last")) & (F.lit(keep_blank) | (x["text"] != "")))
    held = held.withColumns({"_first": first, "_last": last})
    rows = held.select("_text", id_col, *order, "bytes", "total_lines", "_last", F.posexplode(F.slice(asked, 1, n)).alias("_nth", "_r"))
    rows = rows.select("_text", id_col, *order, "bytes", "total_lines", "_last", "_nth", "_r.*").withColumn("_size", F.length("text").cast("long"))
    along = W.partitionBy(F.lit(0)).orderBy(*order, id_col, "_text", "line") if batch else W.partitionBy("_text").orderBy("line")
    rows = rows.withColumn("_before", F.sum("_size").over(along) - F.col("_size")).where(F.col("_before") < budget)
    left = F.lit(budget) - F.col("_before")
    shown = F.when(F.col("_size") > left, F.concat(F.left("text", left.cast("int")), F.lit("... (+"), (F.col("_size") - left).cast("string"), F.lit(" chars)"))).otherwise(F.col("text"))
    ended = (F.col("_nth") == n - 1) | (F.col("_size") >= left)
    onward = F.max(F.when(ended & (F.col("line") < F.col("_last")), F.col("line") + 1)).over(W.partitionBy("_text"))
    return rows.select(id_col, "line", shown.alias("text"), (F.col("_size") > left).alias("is_cut"), (F.col("_size") >= left).alias("is_last"), "total_lines", onward.alias("next_line"), "bytes", *order)
