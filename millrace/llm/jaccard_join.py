"""Exact n-gram Jaccard join with a count-vector R-tree.

The shingles of a text are hashed into groups, and the counts of the groups make the text a point.  The overlap of
two texts is at most the sum of their coordinates' minima; an R-tree over the points applies that bound to whole nodes (by their
coordinates' maxima and least size) and then to single pairs.  Pairs that survive are verified on their shingle sets.

One tree over the whole corpus would compare its nodes with each other quadratically, since hashed counts of unrelated texts
look much alike.  So texts are first *routed* by whole groups: if two texts differ in at most ``d`` shingles, then of any
grouping at most ``d`` groups differ, and they must agree on one of the first ``d + 1`` of their groups in a
fixed order (the prefix principle).  Texts that agree on such a group meet under the smallest id that has it (its *hub*), and every
hub's texts form one R-tree.  Routing loses no pair: it is a pigeonhole argument, not a sample.

The principle holds for any fixed order, so groups that very many texts have (lines that unrelated texts share) come last in it: groups
on which more than ``BLOCK`` texts meet, and those that so many of these texts have at all, are put into a filter, and the texts they are
routed by are routed again with what the filter admits behind everything else.  They meet there only if they have too few other groups.

Steps: route, equal sets but once; link each text with the hub it shares most groups with, if their sets allow;
then, for hubs whose texts are still in several components, search the R-trees for pairs across components; last, fold equal
sets.  In hubs of more than ``BLOCK`` texts those outside the largest component are cut into blocks and meet all blocks; pairs of texts
within the largest component are not looked at, as only links between components matter to the result.

Defined results
---------------
* null text, empty text or white space only: no shingles, linked with nothing, a component of its own;
* fewer words than a shingle has: all words are one shingle; very long texts are taken whole;
* repeated texts link with each other; a null id takes part in no link and has a null component;
* rows with the same id are one document whose sets must agree, else each row keeps its own size and they share a component;
* an empty table gives an empty result; extra columns are ignored.

Shingles are compared by 64-bit hashes when sets are built and folded, by 48 bits when pairs are verified.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, components

WIDTH = 4
THRESHOLD = (85, 100)
#: Texts in one block of a tree, and texts in one leaf.
BLOCK = 1024
LEAF = 16
#: Growth of the size classes that share a grouping.
CLASS_STEP = 1.3
_GROUP_BITS = (6, 16)
#: Texts of at most so many shingles are routed by single shingles: they have too few groups of several.
SINGLE = 32
#: Most rows of a table that is broadcast (three longs each at most).
MOST_BROADCAST = 500_000


# ---------------------------------------------------------------- routing


@lru_cache(maxsize=16)
def _load(num: int, den: int) -> float:
    """Shingles of each routing group: so many that the groups in use outnumber the differing ones well."""
    wanted = min(0.95, 1.6 * (den - num) / (den + num) * (1 + den / num))
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (1 - math.exp(-mid)) / mid > wanted else (lo, mid)
    return lo


def size_classes(most: int) -> np.ndarray:
    """Lower bounds of the size classes, up to one above ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS_STEP)))
    return np.array(out + [max(out[-1] + 1, int(out[-1] * CLASS_STEP))])


def route_tokens(hashes: np.ndarray, sizes: np.ndarray, num: int, den: int, last: common.BoundedFilter | None = None, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts per text): the groups on which a text may meet a similar one.

    ``hashes`` holds the distinct shingles of the texts one after another, ``sizes`` their numbers.  Two texts with
    ``den * |A n B| >= num * |A u B|`` share a token, if both are routed with the same ``last`` or have no token that it admits.
    Tokens that it admits come last in the order.  With ``every``, all groups of the texts and not only the first.
    """
    texts = len(sizes)
    bounds = size_classes(int(sizes.max(initial=1)))
    load = _load(num, den)
    first = np.cumsum(sizes) - sizes
    own = np.searchsorted(bounds, sizes, side="right") - 1
    slots = []  # (text, class, differing shingles at most)
    filled = np.flatnonzero(sizes > 0)
    n = sizes[filled]
    slots.append((filled, own[filled], (den - num) * (n + n * den // num) // (den + num)))
    lower = 1
    while True:  # also the classes in which a smaller partner may be
        c = own[filled] - lower
        partner = bounds[np.maximum(c, 0) + 1] - 1
        meets = (c >= 0) & (partner * den >= n * num)
        if not meets.any():
            break
        slots.append((filled[meets], c[meets], (den - num) * (n[meets] + partner[meets]) // (den + num)))
        lower += 1
    tokens: list[list[np.ndarray]] = [[] for _ in range(texts)]
    for text, cls, differ in slots:
        count = sizes[text]
        single = bounds[cls + 1] - 1 <= SINGLE
        groups = np.where(single, count, np.maximum(1, np.ceil((bounds[cls + 1] - 1) / load)).astype(np.int64))
        base = np.cumsum(groups) - groups
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        h = hashes[np.repeat(first[text], count) + nth]
        key = np.where(np.repeat(single, count), nth, ((h >> np.uint64(33)) % np.repeat(groups, count).astype(np.uint64)).astype(np.int64)) + np.repeat(base, count)
        total = int(groups.sum())
        content = np.zeros(total, np.uint64)
        np.add.at(content, key, common.mix64(h ^ np.uint64(0x5DEECE66D)))
        held = np.bincount(key, minlength=total)
        which = np.where(np.repeat(single, groups), 0, np.arange(total) - np.repeat(base, groups))
        mark = common.mix64(content + which.astype(np.uint64) * np.uint64(0x9E3779B1) + np.repeat(cls, groups).astype(np.uint64) * np.uint64(0x85EBCA77C2B2AE3D))
        # Fuller groups first: they meet by chance least.
        ranked = ((255 - np.minimum(held, 255)).astype(np.uint64) << np.uint64(56)) | (mark >> np.uint64(8))
        common_ = np.zeros(total, bool) if last is None else last.admits(ranked.view(np.int64))
        for k, t in enumerate(text):
            own_groups = slice(base[k], base[k] + groups[k])
            mine = ranked[own_groups][held[own_groups] > 0]
            d = int(differ[k])
            if last is None:
                mine.sort()
            else:
                mine = mine[np.lexsort((mine, common_[own_groups][held[own_groups] > 0]))]
            tokens[t].append(mine if every else mine[: d + 1])
            if len(mine) <= d:  # too few groups for the principle: such texts of a class all meet
                tokens[t].append((np.uint64(0xFF) << np.uint64(56)) | (common.mix64(np.array([cls[k]], np.uint64)) >> np.uint64(8)))
    flat = [x for own_tokens in tokens for x in own_tokens]
    return (np.concatenate(flat) if flat else np.zeros(0, np.uint64)), np.array([sum(map(len, x)) for x in tokens], np.int64)


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the sorted distinct shingles of each text, one text after another."""
    words, first = common.word_hashes(data, offsets)
    hashes, owner = common.shingle_hashes(words, first, width)
    texts = len(offsets) - 1
    if len(owner) and (np.diff(owner) < 0).any():
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    edges = np.searchsorted(owner, np.arange(texts + 1))
    for t in range(texts):
        hashes[edges[t] : edges[t + 1]].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], np.bincount(owner[keep], minlength=texts)


def _ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values, kind))


def profiles(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, only: common.BoundedFilter | None = None, last: common.BoundedFilter | None = None, every: bool = False) -> DataFrame:
    """(id, n, h1, h2, tokens): set size, digest of the set and routing tokens of every text; equal sets of a batch have tokens once.

    ``only`` limits it to the ids that a filter admits; see ``route_tokens`` for ``last`` and ``every``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((only, last))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        only, last = shared.value
        if only is not None:
            batch = batch.filter(pa.array(only.admits(batch.column(2).to_numpy())))
            if not batch.num_rows:
                return None
        data, offsets = common.text_buffers(batch.column(1))
        sizes, h1, h2, tokens, counts = [], [], [], [], []
        for lo, hi in common.pieces(offsets):
            hashes, n = distinct_shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
            filled = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[filled]
            for out, values in ((h1, hashes), (h2, common.mix64(hashes ^ np.uint64(0xC0FFEE)))):
                sums = np.zeros(hi - lo, np.uint64)
                if len(filled):
                    sums[filled] = np.add.reduceat(values, begin)
                out.append(sums)
            got, count = route_tokens(hashes, n, num, den, last, every)
            sizes.append(n)
            tokens.append(got)
            counts.append(count)
        joined = lambda parts: np.concatenate(parts).view(np.int64)
        a, b, routes, count = joined(h1), joined(h2), joined(tokens), np.concatenate(counts)
        # Of equal sets in a batch one with an id is routed; the fold brings the others to its component.
        valid = np.flatnonzero(batch.column(0).is_valid())
        _, leaders = np.unique(np.stack([a, b], axis=1)[valid], axis=0, return_index=True)
        leads = np.zeros(len(a), bool)
        leads[valid[leaders]] = True
        routes, count = routes[np.repeat(leads, count)], np.where(leads, count, 0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(a), pa.array(b), _ragged(routes, count, pa.int64())], names=["id", "n", "h1", "h2", "tokens"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("long")).alias("hash"))
    if only is not None:
        source = source.where(F.col("id").isNotNull())
    return common.map_arrow(source, kernel, "id long, n long, h1 long, h2 long, tokens array<long>")


# ---------------------------------------------------------------- points and sets


def group_bits(n: int) -> int:
    """log2 of the number of groups whose counts make the point of a set of n shingles."""
    return min(max(int(n - 1).bit_length() + 1, _GROUP_BITS[0]), _GROUP_BITS[1])


def point_of(hashes: np.ndarray) -> np.ndarray:
    bits = group_bits(len(hashes))
    counts = np.bincount((hashes & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32)


def read_point(blob: bytes, n: int) -> np.ndarray:
    bits = group_bits(n)
    return np.frombuffer(blob, np.uint8 if len(blob) == 1 << bits else np.uint32)


def folded(point: np.ndarray, bits: int) -> np.ndarray:
    """The point with fewer groups: groups that agree on their lower bits become one."""
    return point.reshape(-1, 1 << bits).sum(axis=0, dtype=np.uint32)


def pack_set(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, ascending."""
    return (hashes >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def read_sets(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes) of a column of packed sets."""
    data, offsets = common.text_buffers(blobs)
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = data.reshape(-1, 6)
    return out.view(np.uint64).reshape(-1), np.diff(offsets) // 6


def shared_counts(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of two columns of sets: hashes with their row in the upper 16 bits, sorted, meet as neighbours.

    Sets hold 48 bits of each hash; rows are taken 65,536 at a time.
    """
    out = np.zeros(len(na), np.int64)
    ends_a, ends_b = np.append(0, np.cumsum(na)), np.append(0, np.cumsum(nb))
    for lo in range(0, len(na), 1 << 16):
        hi = min(len(na), lo + (1 << 16))
        owner = np.arange(hi - lo, dtype=np.uint64) << np.uint64(48)
        both = np.concatenate([a[ends_a[lo] : ends_a[hi]] | np.repeat(owner, na[lo:hi]), b[ends_b[lo] : ends_b[hi]] | np.repeat(owner, nb[lo:hi])])
        both.sort()
        twice = both[1:][both[1:] == both[:-1]]
        out[lo:hi] = np.bincount((twice >> np.uint64(48)).astype(np.int64), minlength=hi - lo)
    return out


def _sets(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """(id, n, shingles, point) of a batch of (id, text)."""
    data, offsets = common.text_buffers(batch.column(1))
    sizes, sets, points = [], [], []
    for lo, hi in common.pieces(offsets):
        hashes, n = distinct_shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
        for e, k in zip(np.cumsum(n), n, strict=True):
            own = hashes[e - k : e]
            sets.append(pack_set(own))
            points.append(point_of(own).tobytes())
        sizes.append(n)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes).astype(np.int64)), common.binary_array(sets), common.binary_array(points)], names=["id", "n", "shingles", "point"])


# ---------------------------------------------------------------- the R-tree


class CountTree:
    """R-tree over count vectors; a node keeps the maximum of each coordinate and the range of sizes below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        order = self._packed(points.astype(np.float32), np.arange(len(points)))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = []  # from the leaves up: (maxima, least size, greatest size)
        high, low, top = self.points, self.sizes, self.sizes
        while len(high) > LEAF:
            starts = np.arange(0, len(high), LEAF)
            high, low, top = np.maximum.reduceat(high, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(top, starts)
            self.levels.append((high, low, top))

    def _packed(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows in leaf order: halve along the coordinate of largest variance."""
        if len(rows) <= LEAF:
            return rows
        axis = int(points[rows].var(axis=0).argmax())
        rows = rows[np.argsort(points[rows, axis], kind="stable")]
        half = -(-len(rows) // 2 // LEAF) * LEAF or LEAF
        if half >= len(rows):
            half = LEAF
        return np.concatenate([self._packed(points, rows[:half]), self._packed(points, rows[half:])])

    def _passing(self, point: np.ndarray, size: int, high: np.ndarray, low: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Where the summed minima allow the threshold: (den + num) * overlap >= num * (size + size)."""
        fit = (top * self.den >= size * self.num) & (low * self.num <= size * self.den)
        at = np.flatnonzero(fit)
        bound = np.minimum(high[at], point).sum(axis=1, dtype=np.int64)
        return at[bound * (self.den + self.num) >= self.num * (size + np.maximum(low[at], -(-size * self.num // self.den)))]

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Rows (as given) whose bound with this point reaches the threshold."""
        nodes = None
        for high, low, top in reversed(self.levels):
            nodes = np.arange(len(high)) if nodes is None else nodes
            nodes = nodes[self._passing(point, size, high[nodes], low[nodes], top[nodes])]
            below = len(self.points) if high is self.levels[0][0] else len(self.levels[[x[0] is high for x in self.levels].index(True) - 1][0])
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
            nodes = nodes[nodes < below]
        nodes = np.arange(len(self.points)) if nodes is None else nodes
        return self.order[nodes[self._passing(point, size, self.points[nodes], self.sizes[nodes], self.sizes[nodes])]]


def tree_pairs(blobs: list[bytes], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, component: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of ``left``, one of ``right``) in different components that the bound lets pass.

    Points of one class of sizes have the same number of groups; a class meets the next larger one on its own groups.
    """
    bits = np.array([group_bits(int(n)) for n in sizes])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for b in np.unique(bits):
        rows = np.flatnonzero((bits == b) | (bits == b + 1))
        level = {int(r): folded(read_point(blobs[r], int(sizes[r])), int(b)) for r in rows}
        right_rows = right[np.isin(right, rows)]
        left_rows = left[np.isin(left, rows)]
        if not len(right_rows) or not len(left_rows):
            continue
        points = np.array([level[int(r)] for r in right_rows])
        points = points.astype(np.uint8 if points.max(initial=0) < 256 else np.uint32)
        tree = CountTree(points, sizes[right_rows], num, den)
        for r in left_rows:
            query = np.minimum(level[int(r)], np.iinfo(points.dtype).max).astype(points.dtype)
            hits = right_rows[tree.search(query, int(sizes[r]))]
            hits = hits[component[hits] != component[r]]
            if bits[r] != b:
                hits = hits[bits[hits] == b]  # both larger: met on their own groups
            if same:
                hits = hits[hits > r]
            found.append((np.full(len(hits), r), hits))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


# ---------------------------------------------------------------- the join


def _tokens(routed: DataFrame, admitted: common.BoundedFilter | None = None) -> DataFrame:
    """(doc, token) of the tokens that the filter admits; others leave here without a shuffle."""
    rows = routed.where(F.size("tokens") > 0).select("id", "tokens")
    if admitted is None:
        return rows.select(F.col("id").alias("doc"), F.explode("tokens").alias("token"))
    shared = routed.sparkSession.sparkContext.broadcast(admitted)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = batch.column(1)
        keep = shared.value.admits(tokens.flatten().to_numpy())
        owner = np.repeat(np.arange(batch.num_rows), tokens.value_lengths().to_numpy())[keep]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), tokens.flatten().filter(pa.array(keep))], names=["doc", "token"])

    return common.map_arrow(rows, kernel, "doc long, token long")


def _outside(rows: DataFrame, column: str, admitted: common.BoundedFilter, hashed: bool) -> DataFrame:
    """The rows whose key the filter does not admit."""
    shared = rows.sparkSession.sparkContext.broadcast(admitted)
    names = rows.columns
    keyed = rows.withColumn("_hash", F.col(column) if hashed else F.xxhash64(column))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(~shared.value.admits(batch.column(len(names)).to_numpy()))).select(names)

    return common.map_arrow(keyed, kernel, rows.schema)


def _leaders(made: DataFrame) -> DataFrame:
    """The routed rows, each set but once in the whole table: a set that was routed in several batches keeps its smallest id."""
    key = ["n", "h1", "h2"]
    rows = made.where(F.size("tokens") > 0)
    several = rows.groupBy(*key).agg(F.min("id").alias("least"), F.count("*").alias("c")).where(F.col("c") > 1).drop("c")
    more = common.materialise(rows.select("id", *key).join(several, key).where(F.col("id") != F.col("least")).select("id", *key).distinct(), "shingle-copies")
    return rows.join(common.few(more, MOST_BROADCAST), ["id", *key], "left_anti").select("id", "tokens")


def _meetings(tokens: DataFrame) -> DataFrame:
    """(token, hub, m): tokens of several texts, the smallest of these and their number."""
    met = tokens.groupBy("token").agg(F.min("doc").alias("hub"), F.max("doc").alias("last"), F.count("*").alias("m"))
    return met.where(F.col("hub") < F.col("last")).select("token", "hub", "m")


def _routes(docs: DataFrame, made: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(routed texts with their tokens, meetings), after tokens on which more than ``most`` texts meet went to the end of the order."""
    routed = _leaders(made)
    met = common.materialise(_meetings(_tokens(routed)), "shingle-tokens")
    often = met.where(F.col("m") > most).select("token")
    if often.limit(1).count() == 0:
        return routed, met
    # Of the texts with such a token, all groups that very many of them have.
    held = lambda tokens: common.BoundedFilter.of(_tokens(routed, common.BoundedFilter.of(tokens, "token", hashed=True)).select("doc").distinct(), "doc")
    full = profiles(docs, id_col, text_col, width, num, den, only=held(often), every=True)
    widely = _tokens(full).groupBy("token").count().where(F.col("count") > most).select("token")
    often = common.materialise(often.unionByName(widely).distinct(), "shingle-frequent")
    last = common.BoundedFilter.of(often, "token", hashed=True)
    # Every text that is routed by a token at the end of the order is routed anew; the others keep their tokens.
    again = held(often)
    fresh = common.materialise(profiles(docs, id_col, text_col, width, num, den, only=again, last=last), "shingle-profiles")
    moved = _leaders(fresh)
    stayed = _outside(routed, "id", again, False)
    before = _tokens(routed.join(moved.select("id"), "id", "left_semi"))
    touched = common.BoundedFilter.of(before.unionByName(_tokens(moved)).select("token").distinct(), "token", hashed=True)
    routed = common.materialise(stayed.unionByName(moved), "shingle-routed")
    kept = _outside(met, "token", touched, True)
    met = common.materialise(kept.unionByName(_meetings(_tokens(routed, touched))), "shingle-tokens")
    return routed, met


def _sets_of_active(docs: DataFrame, shared: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Sets and points of the texts that are routed to a hub, and of few others; texts are not shuffled for it."""
    active = docs.sparkSession.sparkContext.broadcast(common.BoundedFilter.of(shared.select("doc").distinct(), "doc"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = batch.filter(pa.array(active.value.admits(batch.column(2).to_numpy())))
        return _sets(rows, width) if rows.num_rows else None

    return common.map_arrow(source.withColumn("hash", F.xxhash64("id")), kernel, "id long, n long, shingles binary, point binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) whose shingle sets reach the threshold.

    An ``a`` of very many pairs is dealt out: its set goes to as many places as its pairs fill.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        need = num * (batch.column(2).to_numpy() + batch.column(3).to_numpy())
        sizes = pc.add(pc.binary_length(batch.column(4)), pc.binary_length(batch.column(5))).to_numpy()
        keep = []
        for lo, hi in common.pieces(np.append(0, np.cumsum(sizes))):
            one, two = (read_sets(batch.column(k)[lo:hi]) for k in (4, 5))
            keep.append(shared_counts(*one, *two) * (den + num) >= need[lo:hi])
        keep = pa.array(np.concatenate(keep))
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    pairs = common.materialise(pairs, "shingle-pairs")
    many = common.materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("places")).where(F.col("places") > 1), "shingle-places")
    many = common.few(many, MOST_BROADCAST)
    place = F.coalesce(F.pmod(F.xxhash64("b"), F.col("places")).cast("int"), F.lit(0))
    pairs = pairs.join(many, "a", "left").select("a", "b", place.alias("place"))
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")).join(many, "a", "left")
    one = one.withColumn("place", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("places"), F.lit(1)) - 1))).drop("places")
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    joined = pairs.join(one, ["a", "place"]).join(two, "b").select("a", "b", "na", "nb", "sa", "sb")
    return common.map_arrow(joined, kernel, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id`` (smallest id reachable by links, itself included).

    Two documents link when ``threshold[1] * |A n B| >= threshold[0] * |A u B|``.
    """
    spark = docs.sparkSession
    num, den = threshold
    made = common.materialise(profiles(docs, id_col, text_col, width, num, den), "shingle-profiles")
    slim = made.select("id", "n", "h1", "h2")

    # Routing: texts that share a token, with the smallest text that has it.
    routed, met = _routes(docs, made, id_col, text_col, width, num, den, block)
    admitted = common.BoundedFilter.of(met, "token", hashed=True)
    shared = common.materialise(_tokens(routed, admitted).join(met.select("token", "hub"), "token").groupBy("hub", "doc").agg(F.count("*").alias("tokens")), "shingle-routes")

    sets = common.materialise(_sets_of_active(docs, shared, id_col, text_col, width), "shingle-sets")

    # First links: each text with the hub it shares most with.
    best = shared.where(F.col("hub") != F.col("doc")).groupBy("doc").agg(F.max(F.struct("tokens", (-F.col("hub")).alias("h"))).alias("best"))
    links = common.materialise(_verified(best.select((-F.col("best.h")).alias("a"), F.col("doc").alias("b")), sets, num, den), "shingle-links")
    parts = common.materialise(components.connected(links), "shingle-parts")

    # Hubs whose texts are still apart: their trees are searched across components.
    placed = shared.select("hub", "doc").join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    size = placed.groupBy("hub", "component").agg(F.count("*").alias("m")).groupBy("hub").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.max("m").alias("most"), F.max_by("component", "m").alias("main"))
    # In a large hub its largest component is cut into blocks that only the rest meets; in others all are the rest.
    large = F.col("m") > block
    blocks = lambda n: F.ceil(n / max(1, block // 2)).cast("int")
    split = size.where(F.col("parts") > 1).select(
        "hub",
        F.when(large, F.col("main")).alias("main"),
        F.when(large, blocks(F.col("m") - F.col("most"))).otherwise(F.lit(1)).alias("rests"),
        F.when(large, blocks(F.col("most"))).otherwise(F.lit(0)).alias("mains"),
    )
    split = common.few(common.materialise(split, "shingle-splits"), MOST_BROADCAST)
    cells = placed.join(split, "hub").withColumn("is_main", F.coalesce(F.col("component") == F.col("main"), F.lit(False)))
    among = F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))
    cells = cells.withColumn("own", (F.pmod(F.xxhash64("doc"), among) + F.when(F.col("is_main"), F.col("rests")).otherwise(F.lit(0))).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rests") + F.when(F.col("is_main"), F.lit(0)).otherwise(F.col("mains")) - 1)))
    cells = cells.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "component")
    cells = cells.join(sets.select(F.col("id").alias("doc"), "n", "point"), "doc").select("hub", "i", "j", "own", "doc", "component", "n", "point")

    def search(cell: pa.RecordBatch) -> pa.RecordBatch | None:
        if cell.num_rows < 2:
            return None
        i, j = cell.column(1)[0].as_py(), cell.column(2)[0].as_py()
        own, doc, component, n = (cell.column(k).to_numpy() for k in (3, 4, 5, 6))
        if (component == component[0]).all():
            return None
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = tree_pairs(cell.column(7).to_pylist(), n, left, right, i == j, component, num, den)
        if not len(a):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[a], doc[b])), pa.array(np.maximum(doc[a], doc[b]))], names=["a", "b"])

    found = common.map_runs(cells, ["hub", "i", "j"], search, "a long, b long").distinct()
    more = common.materialise(_verified(found, sets, num, den), "shingle-links")

    # Components of representatives; the second round works on those of the first.
    def lifted(side: str) -> DataFrame:
        return parts.select(F.col("node").alias(side), F.col("component").alias(f"{side}_part"))

    joint = more.join(lifted("a"), "a", "left").join(lifted("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    upper = components.connected(joint).select(F.col("node").alias("component"), F.col("component").alias("top"))
    labels = parts.join(upper, "component", "left").select(F.col("node").alias("id"), F.coalesce("top", "component").alias("label"))
    labels = labels.unionByName(upper.join(parts.select("component"), "component", "left_anti").select(F.col("component").alias("id"), F.col("top").alias("label")))

    # Equal sets share the component of the one that was routed; its id is the smallest of all their documents.
    whole = slim.where((F.col("n") > 0) & F.col("id").isNotNull())
    folds = whole.join(labels, "id", "left").groupBy("n", "h1", "h2").agg(F.min("label").alias("label"), F.min("id").alias("least"))
    folds = common.materialise(folds.withColumn("label", F.coalesce("label", "least")), "shingle-folds")
    least = folds.groupBy("label").agg(F.min("least").alias("component"))
    of_set = folds.select("n", "h1", "h2", "label").join(least, "label").drop("label")
    linked = whole.join(of_set, ["n", "h1", "h2"]).select("id", "n", "component")
    alone = slim.where((F.col("n") == 0) | F.col("id").isNull()).select("id", "n", F.col("id").alias("component"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END AS s FROM words
), keyed AS (
  SELECT doc_id, len(s) AS n, s, array_to_string(list_sort(s), chr(10)) AS k FROM sets
), classes AS (
  SELECT k, any_value(n) AS n, any_value(s) AS s, min(doc_id) AS rep FROM keyed WHERE n > 0 GROUP BY k
), items AS (
  SELECT rep, n, unnest(s) AS x FROM classes
), counted AS (
  SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep
), links AS (
  SELECT a, b FROM counted WHERE 100 * i >= 85 * (na + nb - i) UNION ALL SELECT b, a FROM counted WHERE 100 * i >= 85 * (na + nb - i)
), reach AS (
  SELECT rep AS node, rep AS seen FROM classes
  UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a
), part AS (
  SELECT node, min(seen) AS component FROM reach GROUP BY node
)
SELECT keyed.doc_id, keyed.n AS n_shingles, coalesce(part.component, keyed.doc_id) AS component_id
FROM keyed LEFT JOIN classes ON keyed.k = classes.k AND keyed.n > 0 LEFT JOIN part ON part.node = classes.rep
"""
