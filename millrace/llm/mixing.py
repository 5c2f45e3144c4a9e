"""Mixing sources to target weights by capped water-filling, in DataFrame operations alone.

Every source asks for a share of the budget in proportion to its weight, but is clamped at a maximum number of
epochs over its own words.  What the clamped ones leave is redistributed by weight among the rest until none is above its
clamp.  The fixed point is a water level: with sources sorted by ``clamp / weight``, running sums of clamps and of weights
give the level directly, with no loop.

A target is then met by seeded repetitions: every document of a source is taken a whole number of times, and the
rest of the target is filled by walking the source's documents in a seeded order, each taken once more until the target is
full; the one at the edge is taken in part.  So each source comes to its target within a word.

Only the place of the edge has to be known, one row for each source.  It is found by narrowing: sums of the source's slices by
the first digits of the seeded hash give the slice that holds the edge, sums by the next digits the slice within it, and only there (one
row in 16**6) documents are put in order.  Then every document is judged where it is read, by comparing its hash with the edge of its
source: no text is ever shuffled or sorted, and no source, however hot, is ever in one task.

Defined results
---------------
* null or empty text, or one of white space only: size 0, takes no words; an all-empty source has target 0;
* null source: a source of its own, ranked last; null ids are ordered like the empty text;
* ties in the seeded order (one id) go by size; rows equal in both are alike, and if the edge lies among them the first as read are
  taken (they are numbered by the partition they were read from, so a repeated id does not meet in one task);
* an empty table gives an empty result; very long texts are counted whole;
* extra columns pass through ``plan``; an input column named like a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.llm import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2
#: Hex digits of the seeded hash that name a slice: 16 ** 3 slices of each source, and as many within the slice at the edge.
SLICE_DIGITS = 3
#: Most sources whose edges (a few numbers each) are broadcast; with more of them documents are joined with the edges by source.
MOST_BROADCAST = 200_000
SEED = "mix-1"


def size_of(text_col: str = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Water-filled targets of sources: (source, source_size) to (source, source_size, target).

    One row per source comes in, so the windows over all rows hold sources, never documents.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # Whole and part of the level: clamps so far, weights still open.
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("clamp", F.col("source_size") * F.lit(max_epochs))
        .withColumn("ratio", F.col("clamp") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(budget_share))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("clamp").over(before), F.lit(0))) / F.sum("weight").over(onward))
        # The first source whose clamp is not under its level sets the level of all that follow.
        .withColumn("water", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("clamp").cast("double")).otherwise(F.col("weight") * F.col("water")))
        .select("source", "source_size", "target")
    )


def measured(docs: DataFrame, key_col: str, text_col: str, source_col: str, seed: str, kept: list[str]) -> DataFrame:
    """(_row, _key, _size, _draw): the ``kept`` columns, the source as a key without nulls, the words and the seeded hash of every document."""
    draw = F.md5(F.concat(F.coalesce(F.col(key_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    # What came in travels as one struct, so that no name of it can clash.
    row = F.struct(*kept) if kept else F.struct(F.lit(None).cast("int").alias("_none"))
    return docs.select(row.alias("_row"), key.alias("_key"), size_of(text_col).alias("_size"), draw.alias("_draw"))


def _few(df: DataFrame, label: str) -> DataFrame:
    """A table of a row for each source, written; broadcast if its checked size allows."""
    return common.few(common.materialise(df, label), MOST_BROADCAST)


def edges(slim: DataFrame, weights: tuple[int, ...], budget_share: float, max_epochs: int) -> DataFrame:
    """A row for each ``_key``: size, target, whole repetitions, words beyond them (``_extra``) and where in the seeded order these end.

    The edge is the group of rows of one hash and size (``_edge``, ``_edge_size``, ``_edge_rows``) before which ``_before`` words
    lie.  It is below every hash if nothing is taken beyond whole repetitions, and above if all is.
    """
    source = F.when(F.col("_key") != "n", F.substr("_key", F.lit(2)))
    sums = slim.groupBy("_key", F.substring("_draw", 1, SLICE_DIGITS).alias("_slice")).agg(F.sum("_size").alias("n"))
    by_source = targets(sums.groupBy(source.alias("source")).agg(F.sum("n").alias("source_size")), weights, budget_share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    shares = by_source.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_key"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), whole.alias("_whole"))
    shares = _few(shares.withColumn("_extra", F.round(F.col("_target") - F.col("_whole") * F.col("_source_size")).cast("long")), "mix-shares")

    def holding(groups: DataFrame, rank: list[str]) -> DataFrame:
        """Of the groups (``_key``, ``rank``, n) of each source, with ``_extra`` and ``_from`` (words before all of them), the one with the edge."""
        run = W.partitionBy("_key").orderBy(*rank).rowsBetween(W.unboundedPreceding, -1)
        placed = groups.withColumn("_before", F.col("_from") + F.coalesce(F.sum("n").over(run), F.lit(0)))
        return placed.where((F.col("_before") <= F.col("_extra")) & (F.col("_extra") < F.col("_before") + F.col("n")))

    first = holding(sums.join(shares.select("_key", "_extra"), "_key").withColumn("_from", F.lit(0)), ["_slice"])
    first = _few(first.select("_key", "_slice", "_extra", F.col("_before").alias("_from")), "mix-slices")
    inside = slim.withColumn("_slice", F.substring("_draw", 1, SLICE_DIGITS)).join(first, ["_key", "_slice"])
    inside = inside.select("_key", "_draw", "_size", "_extra", "_from", F.substring("_draw", 1 + SLICE_DIGITS, SLICE_DIGITS).alias("_part"))
    second = holding(inside.groupBy("_key", "_part", "_extra", "_from").agg(F.sum("_size").alias("n")), ["_part"])
    second = _few(second.select("_key", "_part", F.col("_before").alias("_from")), "mix-parts")
    last = inside.drop("_from").join(second, ["_key", "_part"]).groupBy("_key", "_draw", "_size", "_extra", "_from").agg(F.sum("_size").alias("n"), F.count("*").alias("_edge_rows"))
    last = holding(last, ["_draw", "_size"]).select("_key", F.col("_draw").alias("_edge"), F.col("_size").alias("_edge_size"), "_edge_rows", "_before")
    open_end = F.when(F.col("_extra") > 0, "~").otherwise("")
    return _few(shares.join(last, "_key", "left").withColumn("_edge", F.coalesce("_edge", open_end)), "mix-edges")


def _mix(rows: DataFrame, slim: DataFrame, weights: tuple[int, ...], budget_share: float, max_epochs: int) -> DataFrame:
    cut = edges(slim, weights, budget_share, max_epochs)
    joined = rows.join(cut, "_key")
    at_edge = (F.col("_draw") == F.col("_edge")) & (F.col("_size") == F.col("_edge_size"))
    at_edge = F.coalesce(at_edge, F.lit(False))
    under = (F.col("_draw") < F.col("_edge")) | ((F.col("_draw") == F.col("_edge")) & (F.col("_size") < F.col("_edge_size")))
    more = F.when(at_edge, F.col("_extra") - F.col("_before")).when(under, F.col("_size")).otherwise(F.lit(0))
    own = ["size", "source_size", "target", "copies", "taken"]

    def result(placed: DataFrame) -> DataFrame:
        return placed.select(
            *([] if "_none" in rows.schema["_row"].dataType.names else [F.col("_row").getField(n).alias(n) for n in rows.schema["_row"].dataType.names if n not in own]),
            F.col("_size").alias("size"),
            F.col("_source_size").alias("source_size"),
            F.col("_target").alias("target"),
            (F.col("_whole") + F.when((F.col("_size") > 0) & (F.col("_more") == F.col("_size")), 1).otherwise(0)).alias("copies"),
            (F.col("_whole") * F.col("_size") + F.col("_more")).alias("taken"),
        )

    several = F.col("_edge_rows") > 1
    if cut.where(several).limit(1).count() == 0:
        return result(joined.withColumn("_more", more))
    # Alike rows at an edge are numbered by partition, then within it; they are all that moves.
    tied = common.materialise(joined.where(at_edge & several).withColumn("_nth", F.monotonically_increasing_id()), "mix-ties").withColumn("_read", F.shiftright("_nth", 33))
    before = W.partitionBy("_key").orderBy("_read").rowsBetween(W.unboundedPreceding, -1)
    counts = tied.groupBy("_key", "_read").agg(F.count("*").alias("c")).withColumn("_first", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    number = F.col("_first") + F.row_number().over(W.partitionBy("_key", "_read").orderBy("_nth")) - 1
    left = F.col("_extra") - F.col("_before") - number * F.col("_size")
    tied = tied.join(counts, ["_key", "_read"]).withColumn("_more", F.greatest(F.lit(0), F.least(F.col("_size"), left)))
    others = joined.where(~(at_edge & F.coalesce(several, F.lit(False)))).withColumn("_more", more)
    return result(others).unionByName(result(tied))


def plan(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` (whole repetitions) and ``taken`` (words in all).

    ``carry`` names the columns of ``docs`` that are wanted with it (all, if None); without the text among them, texts are read once.
    """
    kept = [c for c in docs.columns if carry is None or c in carry]
    if text_col not in kept:
        slim = common.materialise(measured(docs, key_col, text_col, source_col, seed, kept), "mix-sizes")
        return _mix(slim, slim, weights, budget_share, max_epochs)
    slim = common.materialise(measured(docs, key_col, text_col, source_col, seed, []), "mix-sizes")
    return _mix(measured(docs, key_col, text_col, source_col, seed, kept), slim, weights, budget_share, max_epochs)


def repeat(planned: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The mixed documents: each as often as ``copies`` says, and the first words of one taken in part.

    The part keeps the white space between its words.
    """
    rest = F.col("taken") - F.col("copies") * F.col("size")
    words = F.split(F.col(text_col), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col(text_col).rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    part = F.array_join(F.slice(words, F.lit(1), (rest + lead).cast("int")), "")
    copies = F.array_repeat(F.lit(True), F.col("copies").cast("int"))
    wholes = F.when(rest > 0, F.concat(copies, F.array(F.lit(False)))).otherwise(copies)
    return planned.select("*", F.explode(wholes).alias("_whole")).withColumn(text_col, F.when(F.col("_whole"), F.col(text_col)).otherwise(part)).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs.select("doc_id", "text", "source"), carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':mix-1') AS draw FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight, source_size * 2 AS clamp, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM sizes
), levels AS (
  SELECT *, clamp::DOUBLE / weight AS ratio,
    (budget - coalesce(sum(clamp) OVER (ORDER BY clamp::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (ORDER BY clamp::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), water AS (
  SELECT level AS water FROM levels WHERE ratio >= level ORDER BY ratio, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN (SELECT water FROM water) IS NULL OR ratio <= (SELECT water FROM water) THEN clamp::DOUBLE ELSE weight * (SELECT water FROM water) END AS target FROM levels
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
), walked AS (
  SELECT d.*, t.source_size, t.target, t.whole, round(t.target - t.whole * t.source_size)::BIGINT AS extra,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
  FROM docs d JOIN shares t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, extra - earlier)))::BIGINT AS taken FROM walked
"""
