"""Change capture: a log of path events drained on demand into a state table.

Pull, not push: ``drain`` runs a stream with ``availableNow`` over a folder of change rows.  Each micro-batch keeps the
latest event of each path, classifies it, adds it to the state and bumps one generation per kind that changed.  State is a keyed table of
a base and deltas (``sources.versions``), a delta for each batch, so a batch that is run twice gives the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.sources.files import SKIPPED_FOLDERS
from millrace.sources.versions import Versions

# The kind of a file by its extension.
KINDS = {"Code": (".cs",), "Project": (".csproj", ".props", ".targets", ".sln", ".slnx"), "Xaml": (".xaml", ".axaml"), "Razor": (".razor", ".cshtml"), "Resx": (".resx", ".resw")}
#: Changed paths in one drain from which on a full reload is asked for.
RELOAD_AT = 5000

# Endings and beginnings of temporary names.
TEMPORARY = r"(?i)(~|\.tmp|\.swp|\.swx|\.orig|\.rej)$"
TEMPORARY_NAMES = r"^(~\$|\.#)"

CHANGES = "seq BIGINT, path STRING, op STRING, modified TIMESTAMP, length BIGINT"


def kind_of(path: Column) -> Column:
    """Kind of a file, null for one that no kind claims."""
    suffix = tx.extension(path)
    out = F.lit(None).cast("string")
    for kind, suffixes in KINDS.items():
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out


def latest(changes: DataFrame) -> DataFrame:
    """The last event of each path, paths compared ignoring case; temporary, excluded and unclassified files are ignored."""
    folders = F.split(tx.directory(F.col("path")), r"[/\\]")
    counts = ~F.col("path").rlike(TEMPORARY) & ~tx.file_name(F.col("path")).rlike(TEMPORARY_NAMES) & ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SKIPPED_FOLDERS]))
    kept = changes.where(F.col("path").isNotNull() & counts).withColumn("kind", kind_of(F.col("path"))).where(F.col("kind").isNotNull())
    last = kept.groupBy(F.lower("path").alias("path_key")).agg(F.max_by(F.struct("seq", "path", "op", "modified", "length", "kind"), "seq").alias("e"))
    return last.select("path_key", "e.*")


def generations(batches: DataFrame) -> DataFrame:
    """(kind, generation): drains in which a kind changed; batches: (drain, kind)."""
    return batches.groupBy("kind").agg(F.count_distinct("drain").alias("generation"))


STATE = ["path_key", "path", "modified", "length", "kind"]


def _table(spark: SparkSession, folder: str) -> Versions:
    return Versions(spark, f"{folder}/state", "path_key string, seq bigint, path string, modified timestamp, length bigint, kind string", "path_key", "seq")


def drain(spark: SparkSession, source: str, folder: str, absorb: Callable[[DataFrame], DataFrame | None] | None = None) -> dict[str, object]:
    """Take all that is new in ``source`` (Parquet files of change rows) into the state in ``folder``.

    A micro-batch writes its own events only, so a drain costs what it changes; the state is put in order again (``Versions.compact``) once enough has
    changed.  ``absorb`` may do something with the events of a batch and return those (path_key) that it could not: they are put back into
    the source, are no change of this drain, and come again with the next one, unless a later event of their path has come by then.  Returns the batches and the
    events taken, how many were put back, and whether a full reload is due, which is told from all events of the drain.  A drain that fails is
    taken again by the next one.
    """
    seen = {"batches": 0, "events": 0, "requeued": 0, "reload": False}
    table = _table(spark, folder)

    def take(batch: DataFrame, number: int) -> None:
        events = latest(batch).persist()
        try:
            n = events.count()
            if not n:
                return
            failed = absorb(events) if absorb is not None else None
            done = events
            if failed is not None:
                failed = failed.select("path_key").distinct().persist()
                back = events.join(failed, "path_key", "left_semi")
                done = events.join(failed, "path_key", "left_anti")
                if again := back.count():
                    # A batch that is run twice may put them back twice; equal events count once.
                    back.select("seq", "path", "op", "modified", "length").write.mode("append").parquet(source)
                    seen["requeued"] += again
            seen["batches"] += 1
            seen["events"] += n
            seen["reload"] = seen["events"] >= RELOAD_AT
            table.put(done.withColumn("gone", F.col("op") == "deleted"), number)
            done.select(F.lit(number).alias("drain"), "kind").distinct().write.mode("overwrite").parquet(f"{folder}/drains/n={number}")
        finally:
            events.unpersist()

    stream = spark.readStream.schema(CHANGES).parquet(source).writeStream.option("checkpointLocation", f"{folder}/progress").foreachBatch(take).trigger(availableNow=True).start()
    stream.awaitTermination()
    if seen["batches"]:
        table.compact()
    return seen


def state(spark: SparkSession, folder: str, until: int | None = None) -> DataFrame:
    """The state after the last drain (or after batch ``until``, as long as no later base has taken its place)."""
    return _table(spark, folder).read(until).select(*STATE)


def drains(spark: SparkSession, folder: str) -> DataFrame:
    """(drain, kind) of all drains that changed something."""
    whole = Versions(spark, f"{folder}", "drain int, kind string", "kind", "drain").whole("drains")
    if not whole:
        return spark.createDataFrame([], "drain int, kind string")
    return spark.read.parquet(*[f"{folder}/drains/n={v}" for v in whole]).select("drain", "kind")
