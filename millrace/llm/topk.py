"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query, block by block, and only *histograms* of scores leave the tasks.  A first
pass counts scores in wide bins over the whole possible range; the bin that holds the k-th highest score of a query is
refined until it is one score wide.  Then a last pass keeps what lies above the k-th score, and of the
rows that tie with it the smallest ids: each task keeps at most as many ties as are wanted, which the
final ranking reduces to the exact answer.

Queries are taken in blocks of at most ``QUERY_BLOCK``; only such a block (a fixed number of vectors) is broadcast, and
only its thresholds come back to the driver.  The answers of a block are written before the next one is taken, so neither plans nor
broadcasts pile up.  Scoring a block against a candidate costs far more than reading the candidate, so reading them again for
each block is no loss.  Candidates stay where they are read, so a group of equal vectors, however large, neither moves nor meets in one task.

Components are quantised to ``floor(scale * x)``, so scores are integers and selection is exact.

Defined results
---------------
* vectors that are null or hold null or non-finite components take no part, nor do rows with a null id;
* vectors of different lengths are not compared; a vector of no components scores 0 with its like;
* fewer than k candidates: all of them; ties: the smaller id; rows that repeat a candidate's id and vector keep
  their own ranks; a query's own id is never its candidate; a query given twice is answered once, with
  the least of its usable vectors;
* components so large that scores may be beyond 2**61 raise ``ValueError``;
* extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.llm import common

QUERY_BLOCK = 4096
BINS = 512
SCALE = 256
K = 5
ANSWER = "query_id long, rank int, vec_id long, score long"
_MOST_SCORE = 2.0**61
_TOO_LARGE = "scores may be beyond 2**61 and do not fit"
#: Scores held at once in a task.
_TILE = 1 << 20


def quantise(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows, vectors) of those usable: floor(scale * x) as float64 integers."""
    rows, out = [], []
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)  # null components become nan
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.nancumsum(lengths).astype(np.int64)
    for i, n in enumerate(lengths):
        if n != n:
            continue
        v = values[ends[i] - int(n) : ends[i]]
        if np.isfinite(v).all():
            rows.append(i)
            out.append(np.floor(scale * v))
    return np.array(rows, np.int64), out


def _by_length(ids: np.ndarray, vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    lengths = np.array([len(v) for v in vectors])
    return {int(n): (ids[lengths == n], np.array([v for v in vectors if len(v) == n], np.float64).reshape(int((lengths == n).sum()), n)) for n in np.unique(lengths)}


def _tiles(batch: pa.RecordBatch, queries: dict[int, tuple[np.ndarray, np.ndarray]], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query positions, candidate ids, scores, usable) of one batch of candidates, in tiles."""
    rows, vectors = quantise(batch.column(1), scale)
    ids = batch.column(0).to_numpy(zero_copy_only=False)[rows].astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    first = 0
    groups = _by_length(ids, vectors)
    for n, (query_ids, matrix) in queries.items():
        positions = np.arange(first, first + len(query_ids))
        first += len(query_ids)
        if n not in groups:
            continue
        cand, points = groups[n]
        bound = float(np.abs(points).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * n
        if bound >= _MOST_SCORE:
            raise ValueError(_TOO_LARGE)
        if bound >= 2**53:  # doubles would round
            points, matrix = points.astype(np.int64), matrix.astype(np.int64)
        step = max(1, _TILE // max(1, len(query_ids)))
        for a in range(0, len(cand), step):
            scores = (matrix @ points[a : a + step].T).astype(np.int64)
            yield positions, cand[a : a + step], scores, cand[a : a + step][None] != query_ids[:, None]


def _histograms(vectors: DataFrame, block: dict, low: np.ndarray, width: np.ndarray, scale: int) -> pa.Table:
    """(query, bin, n): scores of each query by bin; bin b covers ``low + b * width`` onward, what lies above the last counts in bin BINS."""
    shared = vectors.sparkSession.sparkContext.broadcast((block, low, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, low, width = shared.value
        total = np.zeros((len(low), BINS + 1), np.int64)
        for batch in batches:
            for positions, _, scores, usable in _tiles(batch, queries, scale):
                bins = (scores - low[positions, None]) // width[positions, None]
                keep = usable & (bins >= 0)
                flat = (positions[:, None] * (BINS + 1) + np.minimum(bins, BINS))[keep]
                total += np.bincount(flat, minlength=total.size).reshape(total.shape)
        query, at = np.nonzero(total)
        for a in range(0, len(query), 65536):
            q, b = query[a : a + 65536], at[a : a + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[q, b])], names=["query", "bin", "n"])

    counted = vectors.mapInArrow(run, "query int, bin int, n long")
    got = counted.groupBy("query", "bin").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    return got


def _refine(vectors: DataFrame, block: dict, count: int, biggest: float, k: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(threshold, wanted): the k-th highest score of each query, and how many of the rows that tie with it belong."""
    reach = 1.0
    for n, (_, matrix) in block.items():
        if n and len(matrix):
            reach = max(reach, float(np.abs(matrix).sum(axis=1).max()))
    if reach * (scale * biggest + 1) >= _MOST_SCORE:
        raise ValueError(_TOO_LARGE)
    top = int(reach * (scale * biggest + 1)) + 1
    low = np.full(count, -top, np.int64)
    width = np.full(count, (2 * top) // BINS + 1, np.int64)
    wanted = np.full(count, k, np.int64)
    open_ = np.ones(count, bool)
    while True:
        table = np.zeros((count, BINS + 1), np.int64)
        got = _histograms(vectors, block, low, width, scale)
        if got.num_rows:
            table[got["query"].to_numpy(), got["bin"].to_numpy()] = got["n"].to_numpy()
        above = table[:, ::-1].cumsum(axis=1)[:, ::-1]  # scores in this bin or a higher one
        short = open_ & (above[:, 0] < k)
        low[short], wanted[short], width[short], open_[short] = -top - 1, k, 1, False  # fewer than k: all of them
        for q in np.flatnonzero(open_):
            b = int(np.flatnonzero(above[q] >= k)[-1])
            wanted[q] = k - (above[q, b + 1] if b < BINS else 0)
            low[q] += b * width[q]
            if width[q] == 1:
                open_[q] = False
            width[q] = max(1, -(-width[q] // BINS))
        if not open_.any():
            return low, wanted


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query."""
    spark = vectors.sparkSession
    candidates = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    wanted_rows = queries.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    finite = F.transform(F.col("vector"), lambda x: F.when(F.abs(x.cast("double")) < float("inf"), F.abs(x.cast("double"))))
    biggest = candidates.select(F.max(F.array_max(finite)).alias("m")).first()["m"] or 0.0
    usable = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    # Stored once in the order of ids, so that each block reads only its part of the files.
    wanted_rows = common.materialise(wanted_rows.where(usable).groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id"), "top-k-queries")
    path = f"{common.shared_dir(spark)}/top-k-{uuid.uuid4().hex}"
    common.written(path)
    last = None
    while True:
        # The next block of queries by id: a bounded number of vectors.
        rest = wanted_rows if last is None else wanted_rows.where(F.col("id") > last)
        got = rest.orderBy("id").limit(query_block).toArrow()
        if not got.num_rows:
            break
        last = int(got["id"][-1].as_py())
        rows, found = quantise(got["vector"], scale)
        block = _by_length(got["id"].to_numpy()[rows], found)
        _write_answers(candidates, block, len(rows), biggest, k, scale, path)
        if got.num_rows < query_block:
            break
    if last is None:
        return spark.createDataFrame([], ANSWER)
    return spark.read.schema(ANSWER).parquet(path)


def _write_answers(candidates: DataFrame, block: dict, count: int, biggest: float, k: int, scale: int, path: str) -> None:
    threshold, ties = _refine(candidates, block, count, biggest, k, scale)
    shared = candidates.sparkSession.sparkContext.broadcast((block, threshold, ties))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, threshold, ties = shared.value
        query_ids = np.concatenate([ids for ids, _ in queries.values()])
        tied = [np.zeros(0, np.int64)] * len(threshold)
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        for batch in batches:
            for positions, cand, scores, usable in _tiles(batch, queries, scale):
                q, c = np.nonzero(usable & (scores > threshold[positions, None]))
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[positions[q]]), pa.array(cand[c]), pa.array(scores[q, c])], schema=schema)
                same = usable & (scores == threshold[positions, None])
                for i in np.flatnonzero(same.any(axis=1)):
                    p = positions[i]
                    pool = np.concatenate([tied[p], cand[same[i]]])
                    tied[p] = np.sort(pool)[: ties[p]]
        counts = [len(t) for t in tied]
        if sum(counts):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, counts)), pa.array(np.concatenate(tied)), pa.array(np.repeat(threshold, counts))], schema=schema)

    found = candidates.mapInArrow(run, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    shared.destroy()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
