"""Folding of repeated rows into lines, occurrence keys, and deltas between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MOST_POSITIONS = 20


def findings(df: DataFrame, head: str, position: str, message: str) -> DataFrame:
    """(head, message, positions, n): one row per head and message.

    Inside, equal positions become ``pos xN``; labels are sorted; above twenty the rest is told as ``, +k more``.
    """
    labelled = df.groupBy(head, message, position).agg(F.count("*").alias("_n"))
    label = F.when(F.col("_n") == 1, F.col(position)).otherwise(F.concat(F.col(position), F.lit(" x"), F.col("_n").cast("string")))
    labelled = labelled.withColumn("_label", label)
    totals = labelled.groupBy(head, message).agg(F.count("*").alias("_k"), F.sum("_n").alias("n"))
    # A group limit: each task passes on at most twenty labels of a group, however many it has.
    first = labelled.withColumn("_rn", F.row_number().over(W.partitionBy(head, message).orderBy("_label"))).where(F.col("_rn") <= MOST_POSITIONS)
    listed = first.groupBy(head, message).agg(F.sort_array(F.collect_list("_label")).alias("_labels"))
    keys = [F.col("l.head").eqNullSafe(F.col("t.head")), F.col("l.message").eqNullSafe(F.col("t.message"))]
    listed = listed.select(F.col(head).alias("head"), F.col(message).alias("message"), "_labels").alias("l")
    totals = totals.select(F.col(head).alias("head"), F.col(message).alias("message"), "_k", "n").alias("t")
    more = F.col("_k") - MOST_POSITIONS
    text = F.concat(F.array_join("_labels", ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    return listed.join(totals, keys).select("l.head", "l.message", text.alias("positions"), "n")


def occurrence_keys(df: DataFrame, key: str) -> DataFrame:
    """Each row's key made distinct: ``key``, ``key  [2]``, ``key  [3]``."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(key))
    return df.withColumn("_nth", nth).withColumn("occurrence", F.when(F.col("_nth") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("  ["), F.col("_nth").cast("string"), F.lit("]")))).drop("_nth")


def occurrence_names(df: DataFrame, key: str, chunk: int = 65536) -> DataFrame:
    """Only the distinct names of ``occurrence_keys``, made from counts: a key that very many rows share is not gathered.

    Its names are made in chunks, which are dealt out before they are unfolded.
    """
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    chunks = counted.select(key, "_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"), F.lit(chunk).cast("long"))).alias("_from")).repartition(F.col(key), F.col("_from"))
    nth = chunks.select(key, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + chunk - 1, F.col("_n")))).alias("_nth"))
    return nth.select(F.when(F.col("_nth") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("  ["), F.col("_nth").cast("string"), F.lit("]"))).alias("occurrence"))


def delta(now: DataFrame, before: DataFrame | None, key: str) -> DataFrame:
    """(key, state): ``appeared``, ``fixed`` or ``unchanged`` against the previous run; ``baseline`` if there was none."""
    if before is None:
        return now.select(key).distinct().withColumn("state", F.lit("baseline"))
    a, b = now.select(key).distinct().withColumn("_a", F.lit(True)), before.select(key).distinct().withColumn("_b", F.lit(True))
    state = F.when(F.col("_b").isNull(), "appeared").when(F.col("_a").isNull(), "fixed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def usages(df: DataFrame, keys: list[str], order: list[str], position: str) -> DataFrame:
    """One row per key tuple with its positions in order."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, position))), lambda x: x[position].cast("string")), ",").alias("positions"), F.count("*").alias("n"))


def per_group_threshold(df: DataFrame, group: Column, label: Column, most: int, suffix: str) -> DataFrame:
    """Rows of small groups stay as they are; a group above ``most`` becomes one ``group/**  xN`` row."""
    grouped = df.withColumn("_g", group).withColumn("_label", label)
    counted = grouped.join(grouped.where(F.col("_g").isNotNull()).groupBy("_g").agg(F.count("*").alias("_n")), "_g", "left")
    row = F.when(F.col("_g").isNull() | (F.col("_n") <= most), F.col("_label")).otherwise(F.concat(F.col("_g"), F.lit("/**  x"), F.col("_n").cast("string"), F.lit(suffix)))
    return counted.withColumn("row", row).groupBy("row").agg(F.count("*").alias("files"))


def rollup(df: DataFrame, path: str, depth: int) -> DataFrame:
    """(row, files): paths grouped by their first ``depth`` segments; a group of one stays the file's own row."""
    parts = F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/")
    prefix = F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/"))
    return per_group_threshold(df, prefix, F.col(path), 1, " files")


def untracked(df: DataFrame, path: str, most: int = 5) -> DataFrame:
    """(row, files): paths grouped by top directory where it has more than ``most`` of them."""
    parts = F.split(F.col(path), "/")
    return per_group_threshold(df, F.when(F.size(parts) > 1, parts[0]), F.col(path), most, " untracked")
