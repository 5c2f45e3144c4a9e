"""Caps, ranking and first-wins distinct, each over an explicit total order.

Totals come from an aggregate of their own and the rows from a top-k, so no window ever holds an unbounded input in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.errors import InvalidQuery


def shown(total: Column, cap: int) -> Column:
    """Rows shown of ``total``: all within a tenth above the cap, else the cap."""
    return F.when((F.lit(cap) > 0) & (total <= cap + cap // 10), total).otherwise(F.least(total, F.lit(cap)))


def slack_cap(df: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """The first rows with their ``rank`` and the ``total``; up to a tenth above the cap is still shown whole."""
    if cap < 1:
        raise InvalidQuery("the cap must be positive", "name a cap of at least 1")
    total = df.agg(F.count("*").alias("total")).scalar()
    top = df.orderBy(*order).limit(cap + cap // 10)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(*order))).withColumn("total", total)
    return ranked.where(F.col("rank") <= shown(F.col("total"), cap))


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order."""
    columns = df.columns
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_nth = 1").select(*columns)


def ceiling(df: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """Distinct over at most the first ``max(min(cap, 1024) * 8, 256)`` rows.

    Above that ceiling ``total`` is the raw count and ``exact`` is false.
    """
    most = max(min(cap, 1024) * 8, 256)
    raw = df.agg(F.count("*").alias("n")).scalar()
    head = df.orderBy(*order).limit(most)
    unique = first_wins(head, keys, order)
    kept = unique.orderBy(*order).limit(cap + cap // 10).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    n_unique = unique.agg(F.count("*").alias("n")).scalar()
    out = kept.withColumn("_raw", raw).withColumn("exact", F.col("_raw") <= most).withColumn("total", F.when(F.col("exact"), n_unique).otherwise(F.col("_raw")))
    return out.where(F.col("rank") <= shown(F.col("total"), cap)).drop("_raw")


def withhold(df: DataFrame, secondary: Column) -> DataFrame:
    """If rows of both halves are there, the secondary half is withheld and counted in ``withheld``; alone it is shown."""
    flagged = df.withColumn("_second", F.coalesce(secondary, F.lit(False)))
    counts = flagged.agg(F.count_if("_second").alias("s"), F.count_if(~F.col("_second")).alias("p"))
    seconds, firsts = counts.select("s").scalar(), counts.select("p").scalar()
    out = flagged.withColumn("_s", seconds).withColumn("_p", firsts)
    both = (F.col("_s") > 0) & (F.col("_p") > 0)
    return out.withColumn("withheld", F.when(both, F.col("_s")).otherwise(F.lit(0))).where(~both | ~F.col("_second")).drop("_second", "_s", "_p")
