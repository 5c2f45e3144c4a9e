"""Token counts of documents in flat, unindexed token files, by a separator scan.

A flat token file is a run of fixed-width identifiers in which an end-of-document identifier closes each document;
nothing says where documents begin.  The scan takes byte ranges of files of any length, or blocks that a table holds: each is
searched for separators with one vector comparison where it is read, and boundaries are stitched across blocks by a prefix scan over what the blocks report (tokens,
separators, where the last one is).  The prefix scan has two levels (blocks within stretches of ``STRETCH`` blocks, then
stretches of a file), so a huge file is not one task.

Defined results
---------------
* a document of no tokens counts 0; tokens behind the last separator are a last document, a file that ends with a
  separator has none;
* null or empty blocks hold no tokens; a document longer than a block, or than many, is counted whole;
* repeated blocks (same file and number) count once: the one with the fewest tokens, then the first separators; blocks without a
  file or a number belong to no file;
* a file whose length is not a whole number of identifiers: the odd bytes at its end are no token;
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.llm import bpe, common

#: The free identifier of the public rank file.
END_OF_DOCUMENT = 50256
TOKEN_TYPE = "<u2"
#: Tokens in a range of a flat file; ranges in a stretch of the prefix scan; bytes of flat files that a task reads on average.
BLOCK_TOKENS = 1 << 18
STRETCH = 1024
TASK_BYTES = 128 << 20

_REPORT = "block long, n long, seps long, first long, last long, inner array<long>"


def report(files: pa.Array, numbers: pa.Array, data: np.ndarray, offsets: np.ndarray, separator: int, token_type: str) -> pa.RecordBatch:
    """(file, block, n, seps, first, last, inner) of blocks of tokens, one after another in ``data``.

    Tokens, separators, places of the first and last of them (-1 if none), and lengths of the documents between two of them.
    """
    blocks = len(numbers)
    tokens = np.frombuffer(np.ascontiguousarray(data), token_type)
    at = offsets // np.dtype(token_type).itemsize
    seps = np.flatnonzero(tokens == separator)
    edges = np.searchsorted(seps, at)
    count = np.diff(edges)
    first = np.full(blocks, -1, np.int64)
    last = np.full(blocks, -1, np.int64)
    some = count > 0
    first[some] = seps[edges[:-1][some]] - at[:-1][some]
    last[some] = seps[edges[1:][some] - 1] - at[:-1][some]
    gaps = np.diff(seps) - 1
    owner = np.searchsorted(edges, np.arange(1, len(seps)), side="right") - 1
    inner = gaps[edges[owner] < np.arange(1, len(seps))] if len(seps) else gaps
    lengths = np.maximum(count - 1, 0)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(inner.astype(np.int64)))
    return pa.RecordBatch.from_arrays([files, numbers, pa.array(np.diff(at)), pa.array(count.astype(np.int64)), pa.array(first), pa.array(last), lists], names=["file", "block", "n", "seps", "first", "last", "inner"])


def scan(blocks: DataFrame, file_col: str = "file", block_col: str = "block", tokens_col: str = "tokens", separator: int = END_OF_DOCUMENT, token_type: str = TOKEN_TYPE) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in blocks of flat token files; a block holds whole identifiers."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = common.text_buffers(batch.column(2))
        return report(batch.column(0), batch.column(1), data, offsets, separator, token_type)

    source = blocks.select(F.col(file_col).alias("file"), F.col(block_col).cast("long").alias("block"), F.coalesce(F.col(tokens_col), F.lit(b"")).alias("tokens"))
    source = source.where(F.col("file").isNotNull() & F.col("block").isNotNull())
    kind = source.schema["file"].dataType.simpleString()
    return stitched(common.map_arrow(source, kernel, f"file {kind}, {_REPORT}"))


def flat_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, length) of the files of a folder or pattern; only their listing is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "path", "length")


def scan_files(files: DataFrame, separator: int = END_OF_DOCUMENT, token_type: str = TOKEN_TYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in flat files (file, path, length) of any length.

    Byte ranges are dealt to tasks, read there and searched at once; only what they report goes on.
    """
    width = np.dtype(token_type).itemsize
    size = block_tokens * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                path, block = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if path != opened:
                    store, place = common.open_store(path)
                    source, opened = store.open_input_file(place), path
                data = source.read_at(min(size, batch.column(3)[i].as_py() // width * width - block * size), block * size)
                yield report(batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), np.frombuffer(data, np.uint8), np.array([0, len(data)]), separator, token_type)

    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    whole = F.floor(F.col("length") / width) * width
    ranges = files.where(whole > 0).select("file", "path", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(whole / size) - 1)).alias("block"), "length")
    dealt = ranges.repartition(max(1, -(-total // TASK_BYTES)), "path", F.floor(F.col("block") * size / (TASK_BYTES // 8))).sortWithinPartitions("path", "block")
    kind = files.schema["file"].dataType.simpleString()
    return stitched(dealt.mapInArrow(run, f"file {kind}, {_REPORT}"))


def stitched(reports: DataFrame) -> DataFrame:
    """Document lengths from what the blocks of files report."""
    found = reports.withColumn("stretch", F.floor(F.col("block") / STRETCH)).repartition("file", "stretch")
    again = W.partitionBy("file", "stretch", "block").orderBy("n", "inner", "first")
    found = common.materialise(found.withColumn("_nth", F.row_number().over(again)).where(F.col("_nth") == 1).drop("_nth"), "separator-blocks")

    before = W.partitionBy("file", "stretch").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    local = found.withColumn("start", earlier("n")).withColumn("docs", earlier("seps"))
    local = local.withColumn("after", F.when(F.col("seps") > 0, F.col("start") + F.col("last") + 1)).withColumn("open", F.max("after").over(before))
    stretches = local.groupBy("file", "stretch").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max("after").alias("after"))
    over = W.partitionBy("file").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    stretches = stretches.withColumn("s_start", F.coalesce(F.sum("n").over(over), F.lit(0))).withColumn("s_docs", F.coalesce(F.sum("seps").over(over), F.lit(0)))
    stretches = stretches.withColumn("s_after", F.col("s_start") + F.col("after")).withColumn("s_open", F.coalesce(F.max("s_after").over(over), F.lit(0)))
    placed = local.drop("n", "after").join(stretches.select("file", "stretch", "s_start", "s_docs", "s_open"), ["file", "stretch"]).where(F.col("seps") > 0)
    lead = F.col("s_start") + F.col("start") + F.col("first") - F.coalesce(F.col("s_start") + F.col("open"), F.col("s_open"))
    closed = placed.select("file", (F.col("s_docs") + F.col("docs")).alias("base"), F.posexplode(F.concat(F.array(lead), F.col("inner"))).alias("nth", "n_tokens")).select("file", (F.col("base") + F.col("nth")).alias("ordinal"), "n_tokens")
    tails = stretches.groupBy("file").agg(F.sum("n").alias("n"), F.sum("seps").alias("ordinal"), F.coalesce(F.max("s_after"), F.lit(0)).alias("done"))
    tails = tails.where(F.col("n") > F.col("done")).select("file", "ordinal", (F.col("n") - F.col("done")).alias("n_tokens"))
    return closed.unionByName(tails)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Encode documents into flat token files in the shared folder, one for each task.

    Returns the files (file, path, length) and, apart from them, which document went where (file, ordinal, id).  A file is
    named after the attempt that wrote it, and only what finished attempts wrote is known, so a lost task leaves no trace.
    """
    spark = docs.sparkSession
    folder = common.qualified(spark, f"{common.shared_dir(spark)}/token-files-{uuid.uuid4().hex}")
    common.written(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bpe.codec(rank_path)
        context = TaskContext.get()
        file, ordinal = context.partitionId(), 0
        path = f"{folder}/{file}-{context.taskAttemptId()}.tokens"
        store, place = common.open_store(path)
        sink, length = None, 0

        def rows(kind: str, numbers: np.ndarray, ids: pa.Array, path: str | None) -> pa.RecordBatch:
            n = len(numbers)
            return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array(np.full(n, file, np.int64)), pa.array(numbers), ids, pa.array([path] * n, pa.string())], names=["kind", "file", "number", "id", "path"])

        for batch in batches:
            for part in common.slices(batch, "text"):
                if sink is None:
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(place)
                for text in part.column(1):
                    blob = np.array([*c.encode(text.as_py()), END_OF_DOCUMENT], TOKEN_TYPE).tobytes()
                    sink.write(blob)
                    length += len(blob)
                yield rows("doc", np.arange(ordinal, ordinal + part.num_rows), part.column(0), None)
                ordinal += part.num_rows
        if sink is not None:
            sink.close()
            yield rows("file", np.array([length]), pa.nulls(1, pa.int64()), path)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = common.materialise(source.mapInArrow(run, "kind string, file long, number long, id long, path string"), "token-places", ("kind",))
    files = packed.where(F.col("kind") == "file").select("file", "path", F.col("number").alias("length"))
    return files, packed.where(F.col("kind") == "doc").select("file", F.col("number").alias("ordinal"), "id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files, places = pack(docs)
    return scan_files(files).join(places, ["file", "ordinal"]).select(F.col("id").alias("doc_id"), "n_tokens")
