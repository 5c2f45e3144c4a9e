"""Spelling variants of the words of a corpus, by Aho-Corasick automata over halves of words.

One edit leaves one half of a word whole.  So a word that is one edit from ``w`` begins with the left half of ``w`` or ends with its right half,
and is at most one code point longer or shorter.  The words of each length are dealt by hash into shards of about ``SHARD_WORDS``; a shard's automaton
holds both halves of each of its words.  All words of the lengths that come into question are scanned through every shard: a match counts where the
segment stands at the beginning (left half) or the end (right half) of the scanned word, and the owners of the segment are then compared with it.

Where more than ``PLAIN_OWNERS`` words own a segment, the rest of the scanned word is looked up among the rests of the owners with one code point
left out, so a half that a third of all words share costs no quadratic work; what is found so is compared as well.  Each word finds all its near words in
the shards, so a task sends one row for each scanned word with a near one, and no pairs travel.

Defined results
---------------
* words are counted over all texts; null texts have none; a null id counts as the empty text in the hash; repeated rows count again;
* words below ``least_length`` code points or ``least_count`` occurrences are neither words nor near to one;
* a word's form is its near word of largest count, ties by code points, if that is ``ratio`` times as frequent; counts grow along
  forms, so these end; ``root`` is the last of them;
* empty tables give an empty result; extra columns are ignored; texts and words of any length are taken whole.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: Words of an automaton, and words that a task scans through it, about.
SHARD_WORDS = 1 << 16
SCAN_WORDS = 1 << 15
#: Owners of a segment that are compared one by one; of more, only those that a look-up finds.
PLAIN_OWNERS = 12
#: Most rows of a counts table that joins broadcast.
MOST_LENGTHS = 100_000

# Letters of a run, and the modulus of the hash that says which runs lose a code point.
_RUN = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP_MODULUS = 199


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_modulus: int = DROP_MODULUS) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, after the seeded loss of a code point, with their occurrences.

    Runs below the least length can't become words, so they are not made; counts are summed where texts are read.
    """
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{_RUN}{{{least_length},}}"), F.lit(0))).alias("raw"))
    run = F.translate("raw", _UPPER, _LOWER)
    named = runs.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    hashed = named.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % drop_modulus == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def one_edit(v: str, w: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(v) < len(w):
        v, w = w, v
    if len(v) - len(w) > 1 or v == w:
        return False
    i = 0
    while i < len(w) and v[i] == w[i]:
        i += 1
    return v[i + 1 :] == w[i + (len(v) == len(w)) :]


def _without_one(rest: str) -> set[str]:
    return {rest[:i] + rest[i + 1 :] for i in range(len(rest))}


class Halves:
    """The automaton of a shard: halves of its words, with the words that own each as a left and as a right one."""

    def __init__(self, held: list[str]):
        self.words = held
        self.owners: list[tuple[int, list[int], list[int]]] = []
        self.rests: dict[tuple[int, bool], dict[str, list[int]]] = {}
        place: dict[str, int] = {}
        for k, w in enumerate(held):
            for side, half in enumerate((w[: len(w) // 2], w[len(w) // 2 :])):
                if half not in place:
                    place[half] = len(self.owners)
                    self.owners.append((len(half), [], []))
                self.owners[place[half]][1 + side].append(k)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for half, i in place.items():
            self.automaton.add_word(half, i)
        if held:
            self.automaton.make_automaton()

    def near(self, v: str) -> set[int]:
        """Places of the words that are one edit from ``v``."""
        found: set[int] = set()
        tried: set[int] = set()
        for end, i in self.automaton.iter(v) if self.words else ():
            size, left, right = self.owners[i]
            for owners, fits, rest, side in ((left, end + 1 == size, v[size:], False), (right, end + 1 == len(v), v[: len(v) - size], True)):
                if not fits or not owners:
                    continue
                for k in owners if len(owners) <= PLAIN_OWNERS else self._close(i, owners, rest, side):
                    if k not in tried:
                        tried.add(k)
                        if one_edit(v, self.words[k]):
                            found.add(k)
        return found

    def _close(self, i: int, owners: list[int], rest: str, right: bool) -> set[int]:
        """Owners of a segment whose own rest may be one edit from ``rest``: they agree on something with at most one code point left out."""
        table = self.rests.get((i, right))
        if table is None:
            table = self.rests[i, right] = defaultdict(list)
            size = self.owners[i][0]
            for k in owners:
                w = self.words[k]
                own = w[: len(w) - size] if right else w[size:]
                for key in {own} | _without_one(own):
                    table[key].append(k)
        out: set[int] = set()
        for key in {rest} | _without_one(rest):
            out.update(table.get(key, ()))
        return out


_FOUND = "word string, n_near long, best_n long, best string"


def _cells(vocabulary: DataFrame, shard_words: int, scan_words: int) -> DataFrame:
    """(length, shard, slice, role, word, n): words of a shard (role 0) in each of its cells, and words to scan (role 1) in each cell of the lengths beside theirs."""
    sized = vocabulary.withColumn("own", F.length("word"))
    counts = common.materialise(sized.groupBy("own").count(), "word-lengths")
    shards = counts.select(F.col("own").alias("length"), F.ceil(F.col("count") / shard_words).cast("int").alias("shards"))
    near = counts.select(F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("length"), "count").groupBy("length").agg(F.sum("count").alias("scanned"))
    plan = shards.join(near, "length").select("length", "shards", F.ceil(F.col("scanned") / scan_words).cast("int").alias("slices"))
    plan = common.few(common.materialise(plan, "word-cells"), MOST_LENGTHS)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = sized.withColumnRenamed("own", "length").join(plan, "length").select("length", F.pmod(F.xxhash64("word"), F.col("shards")).cast("int").alias("shard"), F.explode(upto("slices")).alias("slice"), F.lit(0).alias("role"), "word", "n")
    asked = sized.select(F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("length"), "word", "n").join(plan, "length")
    asked = asked.select("length", F.explode(upto("shards")).alias("shard"), F.pmod(F.xxhash64("word", F.lit("slice")), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("role"), "word", "n")
    return held.unionByName(asked)


def near_words(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, scan_words: int = SCAN_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) for words with a near one: how many, and the most frequent of them (ties: the least)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        role = np.asarray(batch.column(3))
        texts, counts = batch.column(4), np.asarray(batch.column(5))
        own = np.flatnonzero(role == 0)
        held, n = texts.take(pa.array(own)).to_pylist(), counts[own]
        halves = Halves(held)
        out: tuple[list, list, list, list] = ([], [], [], [])
        for v in texts.take(pa.array(np.flatnonzero(role == 1))).to_pylist():
            if found := halves.near(v):
                best = min(found, key=lambda k: (-n[k], held[k]))
                for column, value in zip(out, (v, len(found), int(n[best]), held[best]), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["word", "n_near", "best_n", "best"])

    found = common.map_runs(_cells(vocabulary, shard_words, scan_words), ["length", "shard", "slice"], kernel, _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last form of each word of (word, form); ways are doubled each round, and end as counts grow along them."""
    ways = common.materialise(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = common.materialise(ways.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "forms")
        ways = moved.select("word", "root")
        if not moved.where("_moved").limit(1).count():
            return ways


def group(docs: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS, scan_words: int = SCAN_WORDS, **of_words: object) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the texts; see ``words`` for further parameters."""
    vocabulary = common.materialise(words(docs, **of_words), "vocabulary")
    near = near_words(vocabulary, shard_words, scan_words)
    formed = F.col("best_n") >= F.col("n") * ratio
    judged = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    judged = common.materialise(judged, "word-forms")
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
