"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Every vector is hashed where it is read by the signs of its products with random +1/-1 hyperplanes (computed on
integers, so every machine agrees on every bit); the signs of one table name its bucket there.  Only ids and signs are dealt to the
buckets, and equal vectors are folded into one representative with a count before that.  In a bucket, rows whose first ``SKETCH`` signs
differ in so few places that their cosine may reach the threshold, and that share no earlier table as far as these signs tell, ask
for their vectors.  Only these vectors travel, once for each table in which they have such a partner, and are compared by
exact cosine in double precision; a pair that meets in several tables counts in the first alone.  A bucket larger than ``BLOCK`` is cut
into seeded blocks and every pair of blocks is a task of its own, so no pair is lost and no task grows with the bucket.  Tasks return
link counts per row and a spanning forest of their links, never all pairs.

The number of bits grows with the logarithm of the table and the number of tables follows from the recall wanted at the
threshold itself (closer pairs are found more surely).

Defined results
---------------
* null or zero vectors, and those with null or non-finite components, link with nothing: no links, a component of their own;
* vectors of different lengths do not link;
* equal vectors are found by two 64-bit hashes; repeated vectors link with each other; rows with the same id and vector count as separate rows; a null id is
  reported with ``kept`` true and links with nothing;
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common, components

THRESHOLD = 0.95
#: Recall at exactly the threshold; pairs that are closer are found more surely.
RECALL = 0.998
#: Vectors a bucket holds on average, and most vectors in one block.  Fuller buckets need fewer tables, and comparing signs is cheap.
PER_BUCKET = 512
BLOCK = 1024
#: Signs by which rows of a bucket are told apart, and standard deviations by which a pair at the threshold may exceed its mean distance.
SKETCH = 128
SLACK = 4.0
#: Equal vectors beyond which a representative's result is broadcast, and most rows of a table that is.
MANY_EQUAL = 1000
MOST_BROADCAST = 500_000
_GRID = float(1 << 20)


def hyperplanes(dim: int, count: int) -> np.ndarray:
    """(dim, count) of +1 and -1, the same on every machine."""
    cell = np.arange(dim * count, dtype=np.uint64) + np.uint64(0xE3B0C442)
    return np.where(common.mix64(cell) >> np.uint64(63) == 1, 1.0, -1.0).reshape(dim, count)


def signs(matrix: np.ndarray, count: int) -> np.ndarray:
    """(n, count) of booleans; exact, whatever the number of rows hashed together."""
    grid = np.rint(matrix / np.abs(matrix).max(axis=1, keepdims=True) * _GRID)
    return (grid @ hyperplanes(matrix.shape[1], count)) >= 0


def buckets_of(bits_of: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(n, tables) bucket numbers from signs."""
    return (bits_of[:, : tables * bits].reshape(len(bits_of), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def signatures(matrix: np.ndarray, tables: int, bits: int) -> np.ndarray:
    return buckets_of(signs(matrix, sign_count(tables, bits)), tables, bits)


def sign_count(tables: int, bits: int) -> int:
    """Signs kept of a vector: those of all tables and at least ``SKETCH``, in whole words."""
    return -(-max(tables * bits, SKETCH) // 64) * 64


def most_apart(threshold: float) -> int:
    """Most places in which the sketches of a pair at the threshold differ, but for about one pair in 10,000."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + SLACK * math.sqrt(SKETCH * p * (1 - p)))


def plan_tables(n: int, threshold: float, recall: float, per_bucket: int) -> tuple[int, int]:
    """(tables, bits) for n vectors."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / per_bucket + 1)))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - together))), bits


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, per_bucket: int = PER_BUCKET, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``."""
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.where("usable").select("id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.reverse("vector"), F.lit(1)).alias("h2"))
    tables, bits = plan_tables(vectors.count(), threshold, recall, per_bucket)
    words = [f"s{i}" for i in range(sign_count(tables, bits) // 64)]
    apart = most_apart(threshold)

    def hash_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = batch.column(1).value_lengths().to_numpy()
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        first = np.cumsum(dims) - dims
        packed = np.zeros((batch.num_rows, len(words)), np.int64)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            packed[at] = np.packbits(signs(flat[first[at][:, None] + np.arange(d)], 64 * len(words)), axis=1, bitorder="little").view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(dims.astype(np.int32)), *(pa.array(np.ascontiguousarray(packed[:, i])) for i in range(len(words)))], names=["id", "h1", "h2", "dim", *words])

    made = common.materialise(common.map_arrow(good.select("id", "vector", "h1", "h2"), hash_rows, "id long, h1 long, h2 long, dim int, " + ", ".join(f"{w} long" for w in words)), "embedding-signs")
    # One row for each vector: the smallest id that has it, the rows that have it and how many of these have that id.
    same = made.groupBy("h1", "h2", "id").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("dim", *words)])
    folded = same.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.sum("c").alias("n"), F.min_by("c", "id").alias("own"), *[F.first(x).alias(x) for x in ("dim", *words)])
    folded = common.materialise(folded, "embedding-fold")

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = np.stack([batch.column(2 + i).to_numpy() for i in range(len(words))], axis=1)
        sig = buckets_of(np.unpackbits(packed.view(np.uint8), axis=1, bitorder="little"), tables, bits)
        which = pa.array(np.repeat(np.arange(batch.num_rows), tables))
        return pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)), pa.array(sig.reshape(-1)), *(batch.column(i).take(which) for i in range(4))], names=["tbl", "bucket", "dim", "rep", "s0", "s1"])

    hashed = common.map_arrow(folded.select("dim", "rep", *words), spread, "tbl int, bucket long, dim int, rep long, s0 long, s1 long")

    def in_cells(table: DataFrame) -> DataFrame:
        """Rows by bucket; of a bucket of more than ``block`` rows, by pair of blocks."""
        large = table.groupBy("tbl", "bucket", "dim").agg(F.count("*").alias("m")).where(F.col("m") > block).select("tbl", "bucket", "dim", F.ceil(F.col("m") / (block // 2)).cast("int").alias("blocks"))
        large = common.few(common.materialise(large, "embedding-large"), MOST_BROADCAST)
        parts = table.join(large, ["tbl", "bucket", "dim"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        cells = parts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rest = [c for c in table.columns if c not in ("tbl", "bucket", "dim")]
        return cells.select("tbl", "bucket", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *rest)

    keys = ["tbl", "bucket", "dim", "i", "j"]
    visible = SKETCH // bits  # tables whose signs are all in the sketch

    def ask(cell: pa.RecordBatch) -> pa.RecordBatch | None:
        if cell.num_rows < 2:
            return None
        table, i, j = cell.column(0)[0].as_py(), cell.column(3)[0].as_py(), cell.column(4)[0].as_py()
        side, rep = cell.column(5).to_numpy(), cell.column(6).to_numpy()
        sketch = np.stack([cell.column(k).to_numpy() for k in (7, 8)], axis=1).view(np.uint64)
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        distance = sum(np.bitwise_count(sketch[left, w][:, None] ^ sketch[right, w][None]).astype(np.int16) for w in (0, 1))
        a, b = np.nonzero(distance <= apart)
        a, b = left[a], right[b]
        a, b = a[a != b], b[a != b]
        earlier = min(table, visible)
        if earlier and len(a):
            sig = buckets_of(np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8), axis=1, bitorder="little"), earlier, bits)
            fresh = np.ones(len(a), bool)
            for lo in range(0, len(a), 65536):
                s = slice(lo, lo + 65536)
                fresh[s] = ~(sig[a[s]] == sig[b[s]]).any(axis=1)
            a, b = a[fresh], b[fresh]
        if not len(a):
            return None
        return pa.RecordBatch.from_arrays([pa.array(rep[np.unique(np.concatenate([a, b]))]), pa.array(np.full(len(np.unique(np.concatenate([a, b]))), table, np.int32))], names=["rep", "tbl"])

    asked = common.map_runs(in_cells(hashed), keys, ask, "rep long, tbl int")
    wanted = common.materialise(asked.groupBy("rep").agg(F.collect_set("tbl").alias("tables")).join(folded.select("h1", "h2", "rep", "own", "n"), "rep"), "embedding-asked")
    # The vectors asked for; a row that is there several times is taken once.
    fetched = good.join(common.few(wanted, MOST_BROADCAST), [good["h1"] == wanted["h1"], good["h2"] == wanted["h2"], good["id"] == wanted["rep"]]).select("rep", "n", "tables", "own", "vector")
    fetched = fetched.where(F.col("own") == 1).drop("own").unionByName(fetched.where(F.col("own") > 1).dropDuplicates(["rep"]).drop("own")) if wanted.where(F.col("own") > 1).limit(1).count() else fetched.drop("own")

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, tables_of = batch.column(3), batch.column(2)
        dims = column.value_lengths().to_numpy()
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        first = np.cumsum(dims) - dims
        sig = np.zeros((batch.num_rows, tables), np.int64)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            sig[at] = signatures(flat[first[at][:, None] + np.arange(d)], tables, bits)
        tbl = tables_of.flatten().to_numpy().astype(np.int32)
        owner = np.repeat(np.arange(batch.num_rows), tables_of.value_lengths().to_numpy())
        which = pa.array(owner)
        return pa.RecordBatch.from_arrays([pa.array(tbl), pa.array(sig[owner, tbl]), pa.array(dims[owner].astype(np.int32)), batch.column(0).take(which), batch.column(1).take(which), column.take(which)], names=["tbl", "bucket", "dim", "rep", "n", "vector"])

    element = good.schema["vector"].dataType
    dealt_type = T.StructType([T.StructField("tbl", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("rep", T.LongType()), T.StructField("n", T.LongType()), T.StructField("vector", element)])
    dealt = common.materialise(common.map_arrow(fetched.select("rep", "n", "tables", "vector"), deal, dealt_type), "embedding-vectors")

    def compare(cell: pa.RecordBatch) -> pa.RecordBatch | None:
        if cell.num_rows < 2:
            return None
        table, d = cell.column(0)[0].as_py(), cell.column(2)[0].as_py()
        i, j = cell.column(3)[0].as_py(), cell.column(4)[0].as_py()
        raw = cell.column(8).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(cell.num_rows, d)
        scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
        unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        side = cell.column(5).to_numpy()
        left, right = (np.flatnonzero(side == i), np.flatnonzero(side == j))
        close = unit[left] @ unit[right].T >= threshold
        if i == j:
            close = np.triu(close, 1)
        a, b = np.nonzero(close)
        a, b = left[a], right[b]
        if not len(a):
            return None
        if table:
            used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            sig = signatures(raw[used], tables, bits)[:, :table]
            fresh = np.ones(len(a), bool)
            for lo in range(0, len(a), 65536):
                s = slice(lo, lo + 65536)
                fresh[s] = ~(sig[back[: len(a)][s]] == sig[back[len(a) :][s]]).any(axis=1)
            a, b = a[fresh], b[fresh]
            if not len(a):
                return None
        rep, n = cell.column(6).to_numpy(), cell.column(7).to_numpy()
        order = np.argsort(rep, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        links = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
        root = common.forest(len(rep), place[a], place[b])
        touched = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(rep[touched]), pa.array(links[touched].astype(np.int64)), pa.array(rep[order][root[place[touched]]])], names=["rep", "links", "root"])

    found = common.materialise(common.map_runs(in_cells(dealt), keys, compare, "rep long, links long, root long"), "embedding-links")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts_of = components.connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_rep = folded.select("h1", "h2", "rep", "n").join(totals, "rep", "left").join(parts_of.withColumnRenamed("node", "rep"), "rep", "left")
    per_rep = per_rep.select("h1", "h2", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    per_rep = common.materialise(per_rep, "embedding-labels")
    # A vector that very many rows have does not gather them: its result goes to them.
    ids = made.select("id", "h1", "h2").join(common.few(per_rep.where(F.col("n") > MANY_EQUAL), MOST_BROADCAST).select("h1", "h2", "n_links", "component_id"), ["h1", "h2"], "left")
    hot = ids.where(F.col("component_id").isNotNull()).select("id", "n_links", "component_id")
    linked = ids.where(F.col("component_id").isNull()).select("id", "h1", "h2").join(per_rep.where(F.col("n") <= MANY_EQUAL).select("h1", "h2", "n_links", "component_id"), ["h1", "h2"])
    linked = hot.unionByName(linked.select("id", "n_links", "component_id"))
    alone = rows.where(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
