"""Hard negatives for contrastive training, by blocked dense products of anchors and candidates.

Anchors are dealt into passes of at most about ``ANCHOR_BYTES`` of float64 vectors.  A pass broadcasts its anchors; every task multiplies them,
in blocks, with the blocks of candidates that it reads, where they are read.  Components are quantised to ``floor(scale * x)``, so the products
are integers, exact in float64 below 2**53 (beyond that they are taken in int64).

A pass reads the candidates twice.  First each task keeps the best ``positives`` rows of each anchor's own label, and these lists are merged.
The scores of the positives then bound a window for each of them, ``share`` of the positive's score up to that score, and the second reading keeps
the best ``negatives`` rows of other labels in each window.  What a task holds is the anchors and these lists, whatever the candidates; a group of equal
vectors or a label with most of the rows neither moves nor meets in one task.  The answers of a pass are written before the next begins.

Defined results
---------------
* rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of other lengths are not compared;
* an id is never its own positive or negative, whatever row it comes from; an anchor given twice is answered once, with the least of its
  (label, vector) pairs; a candidate row that repeats keeps a place of its own;
* fewer positives or negatives than asked: all of them; an anchor without positives, or a positive with an empty window, has no rows;
* a negative score has an empty window (its share lies above it), as the condition says;
* components so large that scores may be beyond 2**55 raise ``ValueError``; an empty table gives an empty result; extra columns are ignored.
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

#: float64 vectors of the anchors of one pass: what is broadcast.
ANCHOR_BYTES = 32 << 20
#: Anchors and candidates of one product.
ANCHOR_BLOCK = 1024
CANDIDATE_BLOCK = 512
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
SHARE = (80, 100)
ANSWER = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_MOST_SCORE = 2.0**55
_NONE = -(1 << 62)
_LAST = np.iinfo(np.int64).max


def usable_rows(ids: pa.Array, labels: pa.Array, vectors: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (ids, labels, matrix of floor(scale * x)) of rows without nulls whose components are finite."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)  # null components become nan
    known = np.asarray(vectors.is_valid().to_numpy(zero_copy_only=False), bool)
    known &= np.asarray(ids.is_valid()) & np.asarray(labels.is_valid())
    lengths = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    starts = np.append(0, np.cumsum(lengths))[:-1]
    ids, labels = np.asarray(ids.fill_null(0), np.int64), np.asarray(labels.fill_null(0), np.int64)
    out = {}
    for n in np.unique(lengths[known]):
        rows = np.flatnonzero(known & (lengths == n))
        matrix = values[starts[rows][:, None] + np.arange(n)]
        good = np.isfinite(matrix).all(axis=1)
        if good.any():
            out[int(n)] = (ids[rows[good]], labels[rows[good]], np.floor(scale * matrix[good]))
    return out


class Best:
    """The k highest scores, with their ids, of each window of each anchor; ties by the smaller id."""

    def __init__(self, anchors: int, windows: int, k: int):
        self.k = k
        self.scores = np.full((anchors, windows, k), _NONE, np.int64)
        self.ids = np.full((anchors, windows, k), _LAST, np.int64)

    def take(self, first: int, window: int, scores: np.ndarray, ids: np.ndarray, usable: np.ndarray) -> None:
        """Candidates (columns) for the anchors from ``first`` on (rows)."""
        k = self.k
        held_s, held_i = self.scores[first : first + len(scores), window], self.ids[first : first + len(scores), window]
        hit = usable & (scores >= held_s[:, -1:])
        rows = np.flatnonzero(hit.any(axis=1))
        if not len(rows):
            return
        hit = hit[rows]
        if scores.shape[1] > k:  # what is below the k-th of the block can't be among the first k
            masked = np.where(hit, scores[rows], _NONE)
            kth = np.partition(masked, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            hit &= masked >= kth[:, None]
        r, c = np.nonzero(hit)
        owner = np.concatenate([r, np.repeat(np.arange(len(rows)), k)])
        score = np.concatenate([scores[rows[r], c], held_s[rows].ravel()])
        ident = np.concatenate([ids[c], held_i[rows].ravel()])
        order = np.lexsort((ident, -score, owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        order = order[place < k]  # every anchor has k at least, as the held ones count
        held_s[rows], held_i[rows] = score[order].reshape(-1, k), ident[order].reshape(-1, k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, window, score, id) of all that is held."""
        a, w, j = np.nonzero(self.scores > _NONE)
        return a, w, self.scores[a, w, j], self.ids[a, w, j]


def _collect(batches: Iterator[pa.RecordBatch], block: dict, same: bool, low: np.ndarray, high: np.ndarray, k: int, scale: int) -> Best:
    best = Best(len(low), low.shape[1], k)
    for batch in batches:
        for n, (ids, labels, points) in usable_rows(batch.column(0), batch.column(1), batch.column(2), scale).items():
            if n not in block:
                continue
            first, own_ids, own_labels, matrix = block[n]
            bound = float(np.abs(points).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * n
            if bound >= _MOST_SCORE:
                raise ValueError("scores may be beyond 2**55 and do not fit")
            if bound >= 2**53:  # doubles would round
                points, matrix = points.astype(np.int64), matrix.astype(np.int64)
            for a in range(0, len(own_ids), ANCHOR_BLOCK):
                z = min(a + ANCHOR_BLOCK, len(own_ids))
                lo, hi = low[first + a : first + z], high[first + a : first + z]
                for c in range(0, len(ids), CANDIDATE_BLOCK):
                    d = slice(c, c + CANDIDATE_BLOCK)
                    scores = (matrix[a:z] @ points[d].T).astype(np.int64)
                    alike = labels[d][None] == own_labels[a:z, None]
                    usable = (alike if same else ~alike) & (ids[d][None] != own_ids[a:z, None])
                    for w in range(low.shape[1]):
                        best.take(first + a, w, scores, ids[d], usable & (scores >= lo[:, w, None]) & (scores <= hi[:, w, None]))
    return best


def _best(candidates: DataFrame, block: dict, same: bool, low: np.ndarray, high: np.ndarray, k: int, scale: int) -> DataFrame:
    """(anchor, window, score, id, rank): the lists of all tasks, merged; of each only its k best rows travel."""
    shared = candidates.sparkSession.sparkContext.broadcast((block, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, low, high = shared.value
        a, w, score, ident = _collect(batches, block, same, low, high, k, scale).rows()
        for i in range(0, len(a), 65536):
            part = slice(i, i + 65536)
            yield pa.RecordBatch.from_arrays([pa.array(a[part].astype(np.int32)), pa.array(w[part].astype(np.int32)), pa.array(score[part]), pa.array(ident[part])], names=["anchor", "window", "score", "id"])

    found = candidates.mapInArrow(run, "anchor int, window int, score long, id long")
    order = W.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = SHARE, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``anchors`` against all of ``vectors``.

    A negative's score must be at least ``share`` (numerator, denominator) of the positive's and at most that.
    """
    spark = vectors.sparkSession
    columns = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")]
    known = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    candidates = vectors.select(*columns).where(known)
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    wanted = anchors.select(*columns).where(known & finite).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a")).select("id", "a.label", "a.vector")
    wanted = common.materialise(wanted, "anchors")
    total = wanted.agg(F.coalesce(F.sum(F.size("vector") * 8 + 16), F.lit(0))).first()[0]
    passes = max(1, -(-total // anchor_bytes))
    if passes > 1:
        wanted = common.materialise(wanted.withColumn("pass", F.pmod(F.xxhash64("id"), F.lit(passes)).cast("int")).repartition("pass"), "anchor-passes", ("pass",))
    path = f"{common.shared_dir(spark)}/hard-negatives-{uuid.uuid4().hex}"
    common.written(path)
    done = False
    for p in range(passes):
        got = (wanted.where(F.col("pass") == p) if passes > 1 else wanted).select("id", "label", "vector").toArrow()
        if not got.num_rows:
            continue
        block, first = {}, 0
        for n, (ids, labels, matrix) in usable_rows(got["id"].combine_chunks(), got["label"].combine_chunks(), got["vector"], scale).items():
            block[n] = (first, ids, labels, matrix)
            first += len(ids)
        _write_pass(candidates, block, first, positives, negatives, share, scale, path)
        done = True
    return spark.read.schema(ANSWER).parquet(path) if done else spark.createDataFrame([], ANSWER)


def _write_pass(candidates: DataFrame, block: dict, count: int, positives: int, negatives: int, share: tuple[int, int], scale: int, path: str) -> None:
    spark = candidates.sparkSession
    everything = np.full((count, 1), -_NONE, np.int64)
    # At most ``positives`` rows for each anchor of the pass.
    found = _best(candidates, block, True, -everything, everything, positives, scale).select("anchor", "rank", "score", "id").toArrow()
    anchor, rank = found["anchor"].to_numpy(), found["rank"].to_numpy() - 1
    score = found["score"].to_numpy()
    # Without a positive a window is empty: its lower end is above its upper end.
    low, high = np.full((count, positives), 1, np.int64), np.zeros((count, positives), np.int64)
    low[anchor, rank], high[anchor, rank] = -((-share[0] * score) // share[1]), score
    ids = np.zeros(count, np.int64)
    for first, own, _, _ in block.values():
        ids[first : first + len(own)] = own
    names = pa.table({"anchor": found["anchor"], "window": pa.array(rank.astype(np.int32)), "anchor_id": pa.array(ids[anchor]), "positive_id": found["id"], "positive_score": found["score"]})
    best = _best(candidates, block, False, low, high, negatives, scale)
    named = spark.createDataFrame(names) if names.num_rows else spark.createDataFrame([], "anchor int, window int, anchor_id long, positive_id long, positive_score long")
    # As many rows as the pass has positives, which its anchors bound.
    joined = best.join(F.broadcast(named), ["anchor", "window"])
    joined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))
    return mine(moved, moved.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS alike, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS nth FROM s WHERE alike
), n AS (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
   row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank
  FROM p JOIN s ON p.nth <= 5 AND s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
