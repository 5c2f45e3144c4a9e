"""Files as rows: recursive scan with pruning, text decoding, and the line-wise outputs of tools."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.versions import Versions

# Folders that are never entered, and the size above which a file is not text to search.
SKIPPED_FOLDERS = ("bin", "obj", ".git", ".claude", "node_modules", ".vs", ".idea", "artifacts", "TestResults")
MOST_BYTES = 16 * 1024 * 1024


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(full_path, rel_path, modified, length, content) of all files below a root, without skipped folders.

    ``content`` is read only if it is used.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/") + "/")
    plain = F.regexp_replace("path", r"^file:/*", "/")
    rel = F.when(F.startswith(plain, base), F.substr(plain, F.length(base) + 1)).otherwise(plain)
    skipped = F.arrays_overlap(F.slice(F.split("rel_path", "/"), 1, F.greatest(F.size(F.split("rel_path", "/")) - 1, F.lit(0))), F.array(*[F.lit(x) for x in SKIPPED_FOLDERS]))
    return found.select(F.col("path").alias("full_path"), rel.alias("rel_path"), F.col("modificationTime").alias("modified"), "length", "content").where(~skipped)


#: Changed files up to which a catalogue names them to the reader; of more, it reads what has the stamps of changed ones.
MOST_NAMED = 2_000
CATALOGUE = "rel_path string, number bigint, full_path string, modified timestamp, length bigint, content binary"


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(full_path, rel_path, modified, length, content) of all files as of the last ``refresh``."""
    return Versions(spark, folder, CATALOGUE, "rel_path", "number").read().select("full_path", "rel_path", "modified", "length", "content")


def refresh(spark: SparkSession, root: str, folder: str) -> dict[str, int]:
    """Bring the catalogue in ``folder`` up to the files below ``root``: how many were added, changed and removed.

    Files are listed without being opened and their stamps (time and length) joined with those of the last refresh; only files whose stamp
    differs are read, and only they are written.
    """
    held = Versions(spark, folder, CATALOGUE, "rel_path", "number")
    base, deltas = held.parts()
    number = max([-1, *([base] if base is not None else []), *deltas]) + 1
    now = scan(spark, root).select("full_path", "rel_path", "modified", "length").persist()
    try:
        known = held.read().select(F.col("rel_path").alias("_p"), F.col("modified").alias("_m"), F.col("length").alias("_n"))
        told = now.join(known, F.col("rel_path") == F.col("_p"), "full")
        state = F.when(F.col("_p").isNull(), "added").when(F.col("rel_path").isNull(), "removed").when((F.col("modified") != F.col("_m")) | (F.col("length") != F.col("_n")), "changed")
        told = told.select(F.coalesce("rel_path", "_p").alias("rel_path"), "full_path", "modified", "length", state.alias("state")).where(F.col("state").isNotNull()).persist()
        counts = {r["state"]: r["count"] for r in told.groupBy("state").count().collect()}
        if counts:
            fresh = told.where(F.col("state") != "removed")
            gone = told.where(F.col("state") == "removed").select("rel_path", F.lit(number).cast("long").alias("number"), "full_path", "modified", "length", F.lit(None).cast("binary").alias("content"), F.lit(True).alias("gone"))
            held.put(_contents(spark, root, fresh).select("rel_path", F.lit(number).cast("long").alias("number"), "full_path", "modified", "length", "content", F.lit(False).alias("gone")).unionByName(gone), number)
            held.compact()
        told.unpersist()
    finally:
        now.unpersist()
    return {k: counts.get(k, 0) for k in ("added", "changed", "removed")}


def _contents(spark: SparkSession, root: str, fresh: DataFrame) -> DataFrame:
    """``fresh`` files with their contents."""
    some = [r["full_path"] for r in fresh.select("full_path").limit(MOST_NAMED + 1).collect()]
    if not some:
        return fresh.withColumn("content", F.lit(None).cast("binary"))
    if len(some) <= MOST_NAMED:
        read = spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in some])
    else:
        # The reader opens no file whose time or length lies outside of those of changed ones.
        low = fresh.agg(F.min("modified").alias("t"), F.max("modified").alias("u"), F.min("length").alias("a"), F.max("length").alias("b")).first()
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        read = read.where(F.col("modificationTime").between(low["t"], low["u"]) & F.col("length").between(low["a"], low["b"]))
    return fresh.select("rel_path", "full_path", "modified", "length").join(read.select(F.col("path").alias("full_path"), "content"), "full_path")


def prune(files: DataFrame, extensions: tuple[str, ...] = ()) -> DataFrame:
    """``files`` with ``skipped`` (too large) and without binary ones: listed extension, or NUL among the first 4096 bytes of
    content that has no UTF-16 mark."""
    from millrace.functions import text as tx

    kept = files.where(~tx.extension(F.col("rel_path")).isin(*extensions)) if extensions else files
    head = F.substring("content", 1, 4096)
    wide = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    binary = ~wide & (F.regexp_count(F.hex(head), F.lit("^(?:[0-9A-F]{2})*?00")) > 0)
    return kept.withColumn("skipped", F.col("length") > MOST_BYTES).where(F.col("skipped") | ~binary)


def decode(content: Column) -> Column:
    """Text of bytes: UTF-16 by its mark, else UTF-8 without its mark."""
    mark = F.hex(F.substring(content, 1, 3))
    body = lambda skip: F.substr(content, F.lit(skip + 1))
    return (
        F.when(F.startswith(mark, F.lit("FFFE")), F.decode(body(2), "UTF-16LE"))
        .when(F.startswith(mark, F.lit("FEFF")), F.decode(body(2), "UTF-16BE"))
        .when(mark == "EFBBBF", F.decode(body(3), "UTF-8"))
        .otherwise(F.decode(content, "UTF-8"))
    )


def diagnostics(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, line, col, severity, id, message) of compiler output; each distinct line once."""
    pattern = r"^(.*?)\((\d+),(\d+)\): (error|warning) ([A-Z]+\d+): (.*?)(?: \[.*\])?$"
    part = lambda i: F.regexp_extract(column, pattern, i)
    return lines.select(column).where(F.col(column).rlike(pattern)).distinct().select(part(1).alias("path"), part(2).cast("int").alias("line"), part(3).cast("int").alias("col"), part(4).alias("severity"), part(5).alias("id"), part(6).alias("message"))


def test_names(lines: DataFrame, contains: str | None = None, column: str = "value") -> DataFrame:
    """Distinct trimmed names of a discovery listing, in ordinal order."""
    name = F.trim(column)
    found = lines.select(name.alias("name")).where(F.col("name") != "")
    if contains:
        found = found.where(F.contains(F.lower("name"), F.lit(contains.lower())))
    return found.distinct().orderBy("name")


def changed(numstat: DataFrame, statuses: DataFrame) -> DataFrame:
    """(path, added, deleted, status): a file without a status counts as modified."""
    return numstat.join(statuses.select("path", F.col("status").alias("_s")), "path", "left").select("path", "added", "deleted", F.coalesce("_s", F.lit("M")).alias("status"))
