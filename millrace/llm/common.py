"""Shared pieces of the training-data operators: shared storage, Arrow text access and word hashing.

Texts are handled as UTF-8 bytes straight from the Arrow buffers.  A *word* is a maximal run of
bytes outside ``0x20, 0x09-0x0D`` with A-Z lower-cased; a null text counts as empty.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text a kernel looks at in one go; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20

#: Lets Spark delete the shuffle files of a statement at its end.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_WORD_BASE = np.uint64(0x5851F42D4C957F2D)
_SHINGLE_BASE = np.uint64(0xD1342543DE82EF95)


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on a single machine (a test) a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


class _Runs(threading.local):
    """The folders that each open run of this thread wrote; the first list is that of no run."""

    def __init__(self) -> None:
        self.open: list[list[str]] = [[]]


_RUNS = _Runs()


@contextmanager
def run() -> Iterator[list[str]]:
    """A run with a list of its own of the folders that are written inside it, by this thread, for ``clean``.

    Runs in other threads, or around this one, have other lists; what is left in it at the end goes to the run around it.
    """
    paths: list[str] = []
    _RUNS.open.append(paths)
    try:
        yield paths
    finally:
        _RUNS.open.remove(paths)
        _RUNS.open[-1].extend(paths)


def written(path: str) -> None:
    """Remember a folder for ``clean``."""
    _RUNS.open[-1].append(path)


class _Dropping:
    """Statements inside lose their shuffle files when they end; the session's setting comes back with the last of them."""

    def __init__(self) -> None:
        self.lock, self.inside, self.before = threading.Lock(), 0, "false"

    @contextmanager
    def __call__(self, spark: SparkSession) -> Iterator[None]:
        with self.lock:
            if not self.inside:
                self.before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
                spark.conf.set(_SHUFFLE_CLEANUP, "true")
            self.inside += 1
        try:
            yield
        finally:
            with self.lock:
                self.inside -= 1
                if not self.inside:
                    spark.conf.set(_SHUFFLE_CLEANUP, self.before)


_dropping = _Dropping()


def materialise(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; cuts lineage, survives lost executors.

    Its shuffle files go as soon as it is written: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    written(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _dropping(spark):
        writer.parquet(path)
    schema = T.StructType([f for f in df.schema.fields if f.name not in partition_by] + [f for f in df.schema.fields if f.name in partition_by])
    return spark.read.schema(schema).parquet(path)


def clean(spark: SparkSession, paths: list[str] | None = None, keep: DataFrame | None = None) -> int:
    """Delete the folders of a run (without one, those that this thread wrote outside any), but not those that ``keep`` reads.

    Call it once what was made of them is stored.
    """
    paths = _RUNS.open[0] if paths is None else paths
    read = [] if keep is None else keep.inputFiles()
    kept = [p for p in paths if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in read)]
    gone = [p for p in paths if p not in kept]
    paths[:] = kept
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(gone)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a qualified path, for reading and writing from Python tasks: any store that Arrow can open."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def few(df: DataFrame, most: int) -> DataFrame:
    """A written table, broadcast in joins if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def crc_bucket(column: str, modulus: int) -> Column:
    """``crc32(column as text) mod modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


# ---------------------------------------------------------------- Arrow


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; text i is ``bytes[offsets[i]:offsets[i+1]]``, null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw_offsets, raw = column.buffers()
    if not len(column) or raw_offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(raw_offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; whole texts only, so a longer text stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``PIECE_BYTES`` of a text or list column each, whole rows only."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = values.value_lengths() if pa.types.is_list(values.type) else pc.binary_length(values)
    width = 8 if pa.types.is_list(values.type) else 1
    offsets = np.append(0, np.cumsum(pc.fill_null(sizes, 0).to_numpy().astype(np.int64) * width + 16))
    for lo, hi in pieces(offsets):
        yield batch.slice(lo, hi - lo)


def binary_array(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str, sliced_by: str | None = None) -> DataFrame:
    """``mapInArrow`` with a kernel that takes one batch at a time.

    With ``sliced_by``, a batch is cut into slices of about ``PIECE_BYTES`` of that column (text or list), which bounds what a kernel
    that makes Python objects holds at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in [batch] if sliced_by is None else slices(batch, sliced_by):
                if part.num_rows and (out := kernel(part)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def with_outputs(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """Schema of ``df`` with the result columns appended; an input column of the same name gives way."""
    names = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + fields)


def append_columns(batch: pa.RecordBatch, names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in names]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + columns, names=[n for n, _ in kept] + names)


# ---------------------------------------------------------------- words and hashes


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _byte_values() -> np.ndarray:
    values = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED27)) | np.uint64(1)
    values[65:91] = values[97:123]
    return values


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTES = np.where(_SPACE, np.uint64(0), _byte_values())
_POWERS = powers(_WORD_BASE, 4096)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words and, per text, the index of its first word (n + 1 entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): a 64-bit hash of each lower-cased word, and per text the index of its first word."""
    global _POWERS
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    longest = int((ends - starts).max())
    table = _POWERS if longest <= len(_POWERS) else powers(_WORD_BASE, longest)
    place = np.arange(len(data), dtype=np.int64)
    gaps = np.diff(np.append(starts, len(data)))
    place[starts[0] :] -= np.repeat(starts, gaps)
    place[: starts[0]] = 0
    np.minimum(place, len(table) - 1, out=place)
    weighted = _BYTES[data] * table[place]
    sums = np.add.reduceat(weighted, starts)
    return mix64(sums + (ends - starts).astype(np.uint64)), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner): all shingles of ``width`` words with the text they are in; a shorter text gives one of all its words."""
    counts = np.diff(first)
    total = len(words)
    bases = powers(_SHINGLE_BASE, width)
    found, owners = [], []
    texts = np.arange(len(counts))
    if total >= width:
        acc = np.zeros(total - width + 1, np.uint64)
        for k in range(width):
            acc += words[k : total - width + 1 + k] * bases[k]
        owner = np.repeat(texts, counts)[: total - width + 1]
        whole = np.arange(total - width + 1) + width <= first[owner + 1]
        found.append(mix64(acc[whole]))
        owners.append(owner[whole])
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[first[t] : first[t + 1]]
        found.append(mix64(np.atleast_1d((own * bases[: len(own)]).sum(dtype=np.uint64) + np.uint64(0xABCD) * np.uint64(len(own)))))
        owners.append(np.full(1, t))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


# ---------------------------------------------------------------- groups of bounded size


def map_runs(df: DataFrame, keys: list[str], kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """Deal ``df`` by ``keys``, sort by them and call ``kernel`` once per group, without a Python group each in pandas.

    Groups must be bounded by the caller; a partition streams, so only one group and one batch are in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key = None
        out: list[pa.RecordBatch] = []

        def flush() -> None:
            if held:
                one = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                if (got := kernel(one)) is not None and got.num_rows:
                    out.append(got)
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            changed = np.zeros(batch.num_rows, bool)
            changed[0] = True
            for c in columns:
                changed[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(changed)
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                key = tuple(c[a] for c in columns)
                if key != held_key:
                    flush()
                    held_key = key
                held.append(batch.slice(int(a), int(b - a)))
            if sum(x.num_rows for x in out) >= 4096:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out.clear()
        flush()
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInArrow(run, schema)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links (a, b): the smallest node of each node's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


# ---------------------------------------------------------------- bounded membership


class BoundedFilter:
    """A bit per hash of what is in a column: what it denies is certainly absent.

    It has sixteen bits for each row up to ``MOST_BITS`` (16 MiB), which bounds what is collected and broadcast
    whatever the size of the column; beyond that it lets more through.  An exact join must follow.
    """

    MOST_BITS = 1 << 27

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, df: DataFrame, column: str, hashed: bool = False) -> BoundedFilter:
        """Of the values of a column, or of a long column that is itself a hash."""
        rows = df.agg(F.count("*")).first()[0]
        size = 1 << min(cls.MOST_BITS.bit_length() - 7, max(10, int(16 * rows // 64).bit_length()))
        h = F.col(column) if hashed else F.xxhash64(column)
        bits = df.select(h.alias("h")).select(F.pmod(F.shiftright("h", 6), F.lit(size)).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
        got = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(size, np.uint64)
        words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        return cls(words)

    def admits(self, hashes: np.ndarray) -> np.ndarray:
        """For the hashes (int64, ``xxhash64`` of the values unless ``hashed``): whether each may be in the column."""
        word = (hashes >> 6) % np.int64(len(self.words))
        return (self.words[word] >> (hashes & 63).astype(np.uint64)) & np.uint64(1) == 1
