"""Language-model scoring with a log-frequency Bloom filter (Talbot and Osborne, 2007).

Training counts words, word pairs and word triples exactly, then keeps of each count only its level ``1 + floor(log2(count))``.  A
gram of level q is put into a Bloom filter q times, as (gram, 1) to (gram, q); reading probes (gram, 1), (gram, 2), ... until one is
missing.  The filter gives the counts of an interpolated model whose weights follow the context (Jelinek and Mercer, 1980): an order's estimate
is ``count / count of the context``, its weight ``LAMBDA * (1 - D / count of the context)`` with ``D = n1 / (n1 + 2 n2)`` of the counts of counts of
that order, and all the rest goes to the order below; an unseen context leaves everything to it.  The lowest order keeps one part for all words never
met.  So what follows any context sums to one as far as counts are exact.  A count read from the filter is the mean of all counts of its order and
level, so the counts of a level sum up to what they should, and single contexts are off by what theirs differ from the mean.

Counting is by blocks: each task folds a block of texts into sorted arrays of distinct hashes with counts.  Blocks are merged by a
butterfly: hashes are cut into parts by their leading bits and blocks are put into groups of about 256; a node merges one part of
one group.  At the next level nodes of 256 groups merge a part 256 times finer, and so on until one group is left.  So a node
gets at most one entry for a word from each of its children, however often it occurs in the corpus: no node grows with the corpus, only
the number of levels does, with its logarithm (one level up to 2 GB of text, two up to 512 GB).  Answers go back the same way.

The filter is made of one segment per part of the last level, ``BITS_PER_ITEM`` bits per entry, of training grams alone.  A gram occurs at
least as often as its level says, so the training tokens bound its size before anything is merged.  Up to ``MOST_BROADCAST`` bytes of that bound the segments
are written as a table, collected and broadcast, and workers probe them while they score their blocks; only training grams are shuffled.  Beyond it
the filter is nowhere in one piece: grams of all texts go up, each segment is probed where it is made, and the levels go back to the blocks.  The segments
are the same bit for bit, so scores are the same both ways.

Defined results
---------------
* null text is the empty text: one token, the end;
* nothing to learn from: all counts are 0, ``train_tokens`` is 0 and the base is that of an empty model;
* very long texts are read whole; ties do not arise; repeated rows are counted and scored as often as they come;
* a null id hashes like the empty id (and so is a training row or not);
* extra columns are ignored.

Words are compared by 64-bit hashes; longer grams by so many bits that about one in 500 meets another by chance.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: Most weight of an order's estimate against that of the order below, and the longest grams.
LAMBDA = 0.6
ORDER = 3
BITS_PER_ITEM = 10
PROBES = 4
#: Text in one counting block; log2 of the blocks in a group and of the parts that a node cuts its hashes into.
BLOCK_BYTES = 8 << 20
FAN_BITS = 8
#: Most bytes that the filter may have, by its bound, to be broadcast.
MOST_BROADCAST = 64 << 20
_END = np.uint64(0xE0D0E0D0E0D0E0D1)
_LEVELS = 48


def pair_hashes(contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return common.mix64(contexts * np.uint64(0x9DDFEA08EB382D69) + (tokens ^ (tokens >> np.uint64(17))))


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, ends): word hashes of all texts, each text closed by the end token, and where the ends are."""
    words, first = common.word_hashes(data, offsets)
    texts = len(offsets) - 1
    ends = first[1:] + np.arange(texts)
    stream = np.empty(len(words) + texts, np.uint64)
    stream[np.arange(len(words)) + np.repeat(np.arange(texts), np.diff(first))] = words
    stream[ends] = _END
    return stream, ends


def to_planes(values: np.ndarray, skewed: bool = False) -> bytes:
    """Whole numbers in as few bits as the largest needs: all first bytes, then all second ones and so on, what is left of a byte bit by bit.

    ``skewed`` ones, of which most are small, are bits throughout: those of the upper planes are nearly all zero and compress well.
    """
    wide = values.astype("<u8")
    bits = max(1, int(wide.max(initial=0)).bit_length())
    whole = 0 if skewed else bits // 8
    top = wide >> np.uint64(8 * whole)
    planes = [np.packbits(((top >> np.uint64(i)) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes() for i in range(bits - 8 * whole)]
    return bytes([whole, len(planes), -len(wide) % 8]) + wide.view(np.uint8).reshape(-1, 8)[:, :whole].T.tobytes() + b"".join(planes)


def from_planes(blob: bytes) -> np.ndarray:
    whole, rest, spare = blob[:3]
    data = np.frombuffer(blob, np.uint8, offset=3)
    eighth = (len(data) + whole * spare) // (8 * whole + rest)
    n = 8 * eighth - spare
    out = np.zeros((n, 8), np.uint8)
    out[:, :whole] = data[: whole * n].reshape(whole, n).T
    values = out.view("<u8").reshape(-1)
    for i, plane in enumerate(data[whole * n :].reshape(rest, eighth)):
        values |= np.unpackbits(plane, count=n, bitorder="little").astype(np.uint64) << np.uint64(8 * whole + i)
    return values


def to_steps(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and the differences."""
    return keys[:1].astype("<u8").tobytes() + to_planes(np.diff(keys))


def from_steps(blob: bytes) -> np.ndarray:
    steps = from_planes(blob[8:] if len(blob) > 8 else blob)
    return np.cumsum(np.concatenate([np.frombuffer(blob[:8], "<u8"), steps]), dtype=np.uint64) if len(blob) > 8 else steps


# ---------------------------------------------------------------- the filter


def _salt(level: int) -> np.uint64:
    return np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)


def _positions(keys: np.ndarray, level: int, base: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
    a = common.mix64(keys + _salt(level))
    b = common.mix64(a) | np.uint64(1)
    for i in range(PROBES):
        yield base + (((a + np.uint64(i) * b) >> np.uint64(16)) % bits)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + (counts > 0)


def segment(keys: np.ndarray, counts: np.ndarray, most_bytes: int | None = None) -> bytes:
    """Bloom filter of the grams of one bucket; its size follows their number, up to ``most_bytes`` if given."""
    levels = levels_of(counts)
    size = max(8, -(-int(levels.sum()) * BITS_PER_ITEM // 64) * 8)
    if most_bytes is not None:
        size = min(size, max(8, most_bytes // 8 * 8))
    out = np.zeros(size * 8, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        held = keys[levels >= level]
        for at in _positions(held, level, np.uint64(0), np.uint64(size * 8)):
            out[at] = True
    return np.packbits(out, bitorder="little").tobytes()


@dataclass
class LogFrequencyFilter:
    """Segments of all buckets in one array of bytes."""

    data: np.ndarray
    base: np.ndarray  # first bit of each bucket
    bits: np.ndarray

    @classmethod
    def of(cls, segments: dict[int, bytes], buckets: int) -> LogFrequencyFilter:
        blobs = [segments.get(i, b"\0" * 8) for i in range(buckets)]
        sizes = np.array([len(b) * 8 for b in blobs], np.uint64)
        return cls(np.frombuffer(b"".join(blobs), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def levels(self, keys: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Level of each gram: probe (gram, 1), (gram, 2), ... until one is missing."""
        found = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        base, bits = self.base[buckets], self.bits[buckets]
        for level in range(1, _LEVELS):
            for at in _positions(keys, level, base, bits):
                hit = (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    # Later probes of this level read only what is still alive; positions follow by recomputing them.
                    live, keys, base, bits = live[hit], keys[hit], base[hit], bits[hit]
                    if not len(live):
                        return found
                    return self._rest(found, live, keys, base, bits, level)
            found[live] = level
        return found

    def _rest(self, found: np.ndarray, live: np.ndarray, keys: np.ndarray, base: np.ndarray, bits: np.ndarray, level: int) -> np.ndarray:
        while len(live) and level < _LEVELS:
            a = common.mix64(keys + _salt(level))
            b = common.mix64(a) | np.uint64(1)
            for i in range(PROBES):
                at = base + (((a + np.uint64(i) * b) >> np.uint64(16)) % bits)
                hit = (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    live, keys, base, bits, a, b = live[hit], keys[hit], base[hit], bits[hit], a[hit], b[hit]
            found[live] = level
            level += 1
        return found


def level_means(stats: np.ndarray) -> np.ndarray:
    """The count that each level stands for: the mean of those that share it; a level that no training gram has, its middle."""
    grams, sums = stats[:_LEVELS], stats[_LEVELS : 2 * _LEVELS]
    middle = (3.0 * 2.0 ** (np.arange(_LEVELS) - 1) - 1) / 2
    out = np.where(grams > 0, sums / np.maximum(grams, 1), middle)
    out[0] = 0.0
    return out


def probed(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Levels that the segment of one bucket tells of its grams; those of count 0 are asked for only."""
    seen = counts > 0
    held = LogFrequencyFilter.of({0: segment(keys[seen], counts[seen])}, 1)
    return held.levels(keys, np.zeros(len(keys), np.int64)).astype(np.uint8)


# ---------------------------------------------------------------- grams


def gram_hashes(stream: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n up to ``order``, the hash of the gram of n tokens that ends at each token; ends stand before a text."""
    out, pad = [stream], np.array([_END])
    for _ in range(1, order):
        out.append(pair_hashes(before(out[-1], starts, pad[0]), stream))
        pad = pair_hashes(pad, np.array([_END]))
    return out


def before(values: np.ndarray, starts: np.ndarray, first: np.generic | float) -> np.ndarray:
    """The value of the token before each; ``first`` for the first token of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = first
    return out


def key_bits(blocks: int) -> int:
    """Bits by which grams of several words are compared: a block has under 2**22 grams, so about one in 2**9 meets another."""
    return min(62, 31 + int(blocks).bit_length())


def parts_of(keys: np.ndarray, bits: int, lead: int) -> np.ndarray:
    """The part of each key of so many bits: its leading ones."""
    return (keys >> np.uint64(bits - lead)).astype(np.int64)


# ---------------------------------------------------------------- counting


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(block id, stream, ends, training flags, rows) of blocks of texts; the id depends on the split and the order read."""
    nth, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        data, offsets = common.text_buffers(batch.column(1))
        for lo, hi in common.pieces(offsets, block_bytes):
            for a in range(lo, hi, 32768):
                b = min(hi, a + 32768)
                streams, ends, base = [], [], 0
                for x, y in common.pieces(offsets[a : b + 1] - offsets[a]):
                    s, e = token_stream(data[offsets[a + x] : offsets[a + y]], offsets[a + x : a + y + 1] - offsets[a + x])
                    streams.append(s)
                    ends.append(e + base)
                    base += len(s)
                yield (part << 32) | nth, np.concatenate(streams), np.concatenate(ends), batch.column(2)[a:b].to_numpy(zero_copy_only=False).astype(bool), batch.slice(a, b - a)
                nth += 1


def _rows(items: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.get(k) for x in items], t) for k, t in kinds.items()], names=list(kinds))


_TEXT = {"block": pa.int64(), "hashes": pa.binary(), "counts": pa.binary(), "stream": pa.binary(), "ids": pa.binary(), "nulls": pa.binary(), "trains": pa.binary(), "trained": pa.int64(), "taught": pa.int64()}


def blocks_of(docs: DataFrame, block_bytes: int) -> DataFrame:
    """One row for each block of texts: its distinct words in order with their training counts, all texts as places among
    these (one past them is the end), and what else is known of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, stream, ends, train, rows in _blocks(batches, block_bytes):
            inside = np.ones(len(stream), bool)
            inside[ends] = False
            distinct, local = np.unique(stream[inside], return_inverse=True)
            places = np.full(len(stream), len(distinct), np.uint32)
            places[inside] = local
            taught = np.repeat(train, np.diff(np.append(-1, ends)))
            counts = np.bincount(places[taught & inside], minlength=len(distinct))
            ids = rows.column(0)
            yield _rows([{"block": block, "hashes": to_steps(distinct), "counts": to_planes(counts, True), "stream": to_planes(places), "ids": ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), "nulls": np.asarray(ids.is_null()).tobytes(), "trains": train.tobytes(), "trained": int(train.sum()), "taught": int(taught.sum())}], _TEXT)

    return docs.mapInArrow(run, "block long, hashes binary, counts binary, stream binary, ids binary, nulls binary, trains binary, trained long, taught long")


_NODE = {"ord": pa.int32(), "child": pa.int64(), "part": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
_NODE_TYPE = "ord int, child long, part long, keys binary, counts binary"


def _cut(order: int, child: int, keys: np.ndarray, counts: np.ndarray, bits: int, lead: int) -> Iterator[pa.RecordBatch]:
    """The entries of a node, a row for each of the parts that go on."""
    part = parts_of(keys, bits, lead)
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
    found = [{"ord": order, "child": child, "part": int(part[a]), "keys": to_steps(keys[a:b]), "counts": to_planes(counts[a:b], True)} for a, b in zip(edges[:-1], edges[1:], strict=True)]
    if found:
        yield _rows(found, _NODE)


def word_entries(texts: DataFrame, fan_bits: int) -> DataFrame:
    """The words of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield from _cut(1, block, from_steps(hashes), from_planes(counts), 64, fan_bits)

    return texts.select("block", "hashes", "counts").mapInArrow(run, _NODE_TYPE)


def _opened(hashes: bytes, stream: bytes, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(words, places, ends, grams) of a block."""
    words, places = from_steps(hashes), from_planes(stream).astype(np.int64)
    ends = np.flatnonzero(places == len(words))
    tokens = np.append(words, _END)[places]
    return words, places, ends, gram_hashes(tokens, np.append(0, ends[:-1] + 1), order)


def gram_entries(texts: DataFrame, order: int, bits: int, fan_bits: int, training_only: bool = False) -> DataFrame:
    """The grams of two words and more of every block; those of no training text are there with a count of 0, to be asked for, unless
    only training ones are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, hashes, stream, train = (batch.column(k)[i].as_py() for k in range(4))
                _, _, ends, grams = _opened(hashes, stream, order)
                taught = np.repeat(np.frombuffer(train, bool), np.diff(np.append(-1, ends))).astype(np.uint64)
                for n in range(2, order + 1):
                    # The last bit tells whether a training text has the gram here.
                    keys = ((grams[n - 1] >> np.uint64(64 - bits)) << np.uint64(1)) | taught
                    keys.sort()
                    seen, keys = keys & np.uint64(1), keys >> np.uint64(1)
                    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    counts = np.add.reduceat(seen, starts)
                    wanted = counts > 0 if training_only else slice(None)
                    yield from _cut(n, block, keys[starts][wanted], counts[wanted], bits, fan_bits)

    return texts.select("block", "hashes", "stream", "trains").mapInArrow(run, _NODE_TYPE)


def _merged(group: pa.RecordBatch) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """(children, places of each child's keys, distinct keys, their counts) of a node."""
    column = lambda n: group.column(group.schema.get_field_index(n))
    keys = [from_steps(x) for x in column("keys").to_pylist()]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, np.concatenate([from_planes(x) for x in column("counts").to_pylist()]), len(distinct)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    return column("child").to_pylist(), [where[e - len(k) : e] for k, e in zip(keys, ends, strict=True)], distinct, total


_ANSWER = {"ord": pa.int32(), "child": pa.int64(), "part": pa.int64(), "totals": pa.binary(), "levels": pa.binary(), "stats": pa.list_(pa.int64())}
_ANSWER_TYPE = "ord int, child long, part long, totals binary, levels binary, stats array<long>"


def _given(order: int, part: int, children: list[int], places: list[np.ndarray], totals: np.ndarray | None, levels: np.ndarray) -> list[dict]:
    return [{"ord": order, "child": c, "part": part, "totals": None if totals is None else to_planes(totals[w], True), "levels": to_planes(levels[w], True)} for c, w in zip(children, places, strict=True)]


def _statistics(total: np.ndarray) -> dict:
    """Of the counts of a part: training grams by level, their occurrences by level, and how many occur twice."""
    levels = levels_of(total)
    by_level = np.bincount(levels, total > 0, _LEVELS), np.bincount(levels, total, _LEVELS)
    return {"stats": np.concatenate([*by_level, [(total == 2).sum()]]).astype(np.int64).tolist()}


def _summed(found: DataFrame) -> DataFrame:
    """(ord, at, n): the statistics of all parts together, ``at`` their place in ``_statistics``."""
    return found.where(F.col("stats").isNotNull()).select("ord", F.posexplode("stats").alias("at", "n")).groupBy("ord", "at").agg(F.sum("n").alias("n"))


def _layers(entries: DataFrame, blocks: int, bits: int, fan_bits: int) -> list[DataFrame]:
    """The children of the nodes of each level of the butterfly, the last level last."""

    def up(level: int) -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
        def kernel(group: pa.RecordBatch) -> pa.RecordBatch | None:
            order, node = group.column(0)[0].as_py(), group.column(1)[0].as_py()
            _, _, distinct, total = _merged(group)
            return next(_cut(order, node, distinct, total, 64 if order == 1 else bits, (level + 1) * fan_bits), None)

        return kernel

    fan, layers, groups = 1 << fan_bits, [], blocks
    while True:
        groups = -(-groups // fan)
        spread = F.pmod(F.xxhash64("child") if not layers else F.col("child"), F.lit(groups))
        layers.append(entries.select("ord", spread.alias("node"), "part", "child", "keys", "counts"))
        if groups <= 1:
            return layers
        entries = common.materialise(common.map_runs(layers[-1], ["ord", "node", "part"], up(len(layers)), _NODE_TYPE), "lm-nodes")


def answers(entries: DataFrame, blocks: int, bits: int, fan_bits: int) -> tuple[DataFrame, DataFrame]:
    """(answers, statistics by order).  For every block and part, levels of its grams (and, of words, exact totals) in the order of their keys."""

    def top(group: pa.RecordBatch) -> pa.RecordBatch:
        order, part = group.column(0)[0].as_py(), group.column(2)[0].as_py()
        children, places, distinct, total = _merged(group)
        out = _given(order, part, children, places, total if order == 1 else None, probed(distinct, total))
        out[0] |= _statistics(total)
        return _rows(out, _ANSWER)

    def down(group: pa.RecordBatch) -> pa.RecordBatch | None:
        order, part = group.column(0)[0].as_py(), group.column(2)[0].as_py()
        asked = group.filter(group.column(group.schema.get_field_index("keys")).is_valid())
        told = group.filter(group.column(group.schema.get_field_index("keys")).is_null())
        children, places, _, _ = _merged(asked)
        rows = sorted((r for r in told.select(["sub", "totals", "levels"]).to_pylist()), key=lambda r: r["sub"])
        totals = np.concatenate([from_planes(r["totals"]) for r in rows]) if order == 1 else None
        return _rows(_given(order, part, children, places, totals, np.concatenate([from_planes(r["levels"]) for r in rows])), _ANSWER)

    layers = _layers(entries, blocks, bits, fan_bits)
    found = common.materialise(common.map_runs(layers[-1], ["ord", "node", "part"], top, _ANSWER_TYPE), "lm-answers")
    stats = _summed(found)
    for layer in reversed(layers[:-1]):
        told = found.select("ord", F.col("child").alias("node"), F.shiftright("part", fan_bits).alias("part"), F.col("part").alias("sub"), "totals", "levels")
        found = common.materialise(common.map_runs(layer.unionByName(told, allowMissingColumns=True), ["ord", "node", "part"], down, _ANSWER_TYPE), "lm-answers")
    return found, stats


_SEGMENT = {"ord": pa.int32(), "part": pa.int64(), "bits": pa.binary(), "stats": pa.list_(pa.int64())}


def segments(entries: DataFrame, blocks: int, bits: int, fan_bits: int) -> tuple[DataFrame, DataFrame, int]:
    """(the filter: a segment for each order and part; statistics by order; leading bits that tell a part) of training grams."""

    def top(group: pa.RecordBatch) -> pa.RecordBatch:
        _, _, distinct, total = _merged(group)
        return _rows([{"ord": group.column(0)[0].as_py(), "part": group.column(2)[0].as_py(), "bits": segment(distinct, total)} | _statistics(total)], _SEGMENT)

    layers = _layers(entries, blocks, bits, fan_bits)
    found = common.materialise(common.map_runs(layers[-1], ["ord", "node", "part"], top, "ord int, part long, bits binary, stats array<long>"), "lm-segments")
    return found, _summed(found), len(layers) * fan_bits


@dataclass
class Whole:
    """The filters of all orders as workers hold them, with what tells the part of a gram."""

    filters: dict[int, tuple[np.ndarray, LogFrequencyFilter]]
    bits: int
    lead: int

    @classmethod
    def of(cls, table: pa.Table, bits: int, lead: int) -> Whole:
        filters = {}
        orders = table["ord"].to_numpy()
        for n in np.unique(orders):
            rows = table.filter(pa.array(orders == n)).sort_by("part")
            # Parts without a training gram share an empty segment behind the others.
            held = dict(enumerate(rows["bits"].to_pylist()))
            filters[int(n)] = rows["part"].to_numpy(), LogFrequencyFilter.of(held, len(held) + 1)
        return cls(filters, bits, lead)

    def levels(self, order: int, keys: np.ndarray) -> np.ndarray:
        if order not in self.filters:
            return np.zeros(len(keys), np.int64)
        parts, held = self.filters[order]
        part = parts_of(keys, self.bits, self.lead)
        at = np.minimum(np.searchsorted(parts, part), len(parts) - 1)
        return held.levels(keys, np.where(parts[at] == part, at, len(parts)))


def discount(stats: np.ndarray) -> float:
    ones, twos = float(stats[1]), float(stats[2 * _LEVELS])
    return ones / (ones + 2 * twos) if ones else 0.0


def score_blocks(texts: DataFrame, found: DataFrame, order: int, bits: int, train_tokens: int, distinct: int, train_texts: int, means: list[np.ndarray], discounts: list[float], weight: float, whole: Broadcast | None = None) -> DataFrame:
    """(id, train, n_tokens, sum_log, known, score) of every text, from what was given back to its block and the filter that workers hold, if any.

    ``sum_log`` and ``known`` are sums over its words from exact counts; ``score`` is its log10 probability under the
    interpolated model, from levels.
    """

    def kernel(group: pa.RecordBatch) -> pa.RecordBatch:
        parts = {n: group.column(group.schema.get_field_index(n)) for n in group.schema.names}
        orders, at = parts["ord"].to_pylist(), parts["part"].to_pylist()
        info = orders.index(None)
        words, places, ends, grams = _opened(parts["hashes"][info].as_py(), parts["stream"][info].as_py(), order)
        starts = np.append(0, ends[:-1] + 1)

        def given(n: int, column: str, read: Callable[[bytes], np.ndarray]) -> np.ndarray:
            rows = sorted((at[i], i) for i, o in enumerate(orders) if o == n)
            return np.concatenate([np.zeros(0, np.int64), *(read(parts[column][i].as_py()).astype(np.int64) for _, i in rows)])

        levels = lambda n: given(n, "levels", from_planes)
        counts = np.append(given(1, "totals", from_planes), 0)
        held = np.append(means[1][levels(1)], float(train_texts))[places]
        p = np.minimum(1.0, (held + 1) / (train_tokens + distinct + 1))
        for n in range(2, order + 1):
            context = before(held, starts, float(train_texts))
            keys, which = np.unique(grams[n - 1] >> np.uint64(64 - bits), return_inverse=True)
            held = means[n][levels(n) if whole is None else whole.value.levels(n, keys)][which]
            # A gram that the filter tells to be more frequent than its context is as frequent.
            context = np.maximum(context, held)
            own = weight * np.maximum(context - discounts[n], 0.0) / np.maximum(context, 1.0)
            p = own * held / np.maximum(context, 1.0) + (1 - own) * p
        each = lambda values: pa.array(np.add.reduceat(values, starts))
        ids = pa.array(np.frombuffer(parts["ids"][info].as_py(), np.int64), mask=np.frombuffer(parts["nulls"][info].as_py(), bool))
        n_tokens = pa.array(np.diff(np.append(-1, ends)).astype(np.int64))
        train = pa.array(np.frombuffer(parts["trains"][info].as_py(), bool))
        return pa.RecordBatch.from_arrays([ids, train, n_tokens, each(np.log10(counts + 1.0)[places]), each((counts > 0).astype(np.int64)[places]), each(np.log10(p))], names=["id", "train", "n_tokens", "sum_log", "known", "score"])

    every = texts.select("block", "hashes", "stream", "ids", "nulls", "trains").unionByName(found.select(F.col("child").alias("block"), "ord", "part", "totals", "levels"), allowMissingColumns=True)
    return common.map_runs(every, ["block"], kernel, "id long, train boolean, n_tokens long, sum_log double, known long, score double")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", weight: float = LAMBDA, order: int = ORDER, block_bytes: int = BLOCK_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """(id, in_training, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``; ``train`` marks the rows to learn from."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    texts = common.materialise(blocks_of(source, block_bytes), "lm-blocks")
    held = texts.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("trained"), F.lit(0)).alias("t"), F.coalesce(F.sum("taught"), F.lit(0)).alias("tokens")).first()
    bits, train_texts = key_bits(held["blocks"]), int(held["t"])
    entries, whole = word_entries(texts, fan_bits), None
    # The levels of all grams of one order sum up to no more than the training tokens; each of its segments is rounded up to 8 bytes.
    parts = 1 << fan_bits * max(1, math.ceil(math.log(max(held["blocks"], 2), 1 << fan_bits)))
    bound = (order - 1) * (int(held["tokens"]) * BITS_PER_ITEM // 8 + 8 * parts)
    if bound <= MOST_BROADCAST:
        found, stats = answers(entries, held["blocks"], bits, fan_bits)
        table, more, lead = segments(gram_entries(texts, order, bits, fan_bits, True), held["blocks"], bits, fan_bits)
        stats = stats.unionByName(more)
        whole = spark.sparkContext.broadcast(Whole.of(table.select("ord", "part", "bits").toArrow(), bits, lead))
    else:
        # Made again from the blocks where they are read twice: they are larger than what they are made from.
        found, stats = answers(entries.unionByName(gram_entries(texts, order, bits, fan_bits)), held["blocks"], bits, fan_bits)
    known = np.zeros((order + 1, 2 * _LEVELS + 1), np.int64)
    for r in stats.collect():  # fewer than a hundred rows for each order
        known[r["ord"], r["at"]] = r["n"]
    train_tokens = int(known[1, _LEVELS : 2 * _LEVELS].sum()) + train_texts
    distinct = int(known[1, :_LEVELS].sum()) + (train_texts > 0)
    means, discounts = [level_means(x) for x in known], [discount(x) for x in known]
    scored = score_blocks(texts, found, order, bits, train_tokens, distinct, train_texts, means, discounts, weight, whole)
    total = float(np.log10(train_tokens + distinct + 1))
    end = float(np.log10(train_texts + 1))
    return scored.select(
        F.col("id").alias(id_col),
        F.col("train").alias("in_training"),
        "n_tokens",
        (F.col("known") + F.lit(int(train_texts > 0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("sum_log") + F.lit(end) - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, common.crc_bucket("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
