"""Corpus pipeline over ``documents``: five stages, each on all rows that its predecessor kept.

1. ``language_id``: texts whose language cannot be told (no letter, or a probability not ``ABOVE_CHANCE`` times that of a guess) go;
   the label column takes the prediction where it was null.
2. ``near_duplicates``: of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document with the
   smallest id stays.  Rows with one id are one document: the least row (by text, then the other columns) stands for it.
   Rows without an id are in no group and stay.
3. ``secret_scan``: secrets are replaced in the text by ``SECRET_MARK``; no document goes.
4. ``source_mix``: sources are mixed to their target weights; documents repeat, or drop out, as the mix says.
5. ``bpe``: the final rows with their token ids and the check that these decode to the text.

All stages but the last return the columns of ``documents``.  Every stage takes null and empty texts, repeated rows, empty
tables and extra columns; see the operators for what they return then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, common, jaccard_join, language_id, mixing, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The language predicted must be this much likelier than one of all labels drawn by chance: only texts that tell nothing go.
ABOVE_CHANCE = 1.12
NEAR_WIDTH = 5
NEAR_THRESHOLD = (80, 100)
SECRET_MARK = "[secret]"
#: Most ids of documents that go (a long and a flag each) that are broadcast; above it texts are dealt by id.
MOST_BROADCAST = 1_000_000


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told.

    A null or empty text, or one without a letter, goes; each row is judged alone, so repeated rows and ids, null ones too, share their fate.
    A null label takes the prediction; with no labelled text all go; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    net = language_id.train(docs.where(~language_id.held_out()))
    judged = language_id.identify(docs, net)
    least = ABOVE_CHANCE / len(net.labels) if net is not None and len(net.labels) > 1 else 0.0
    kept = judged.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= least))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id.

    Texts stay where they are read; only rows whose id occurs again are aggregated.  A null text, or one without words, is near nothing and stays, as does
    a row without an id.
    """
    docs = docs.select(*COLUMNS)
    groups = common.materialise(jaccard_join.join(docs, width=NEAR_WIDTH, threshold=NEAR_THRESHOLD), "near-groups").where(F.col("doc_id").isNotNull())
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id", F.lit(True).alias("_gone")).distinct()
    again = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id", F.lit(False).alias("_gone"))
    marks = common.materialise(gone.unionByName(again), "near-marks")
    few = marks.count() <= MOST_BROADCAST
    marked = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(marks) if few else marks, "doc_id", "left")
    kept = marked.where(F.col("_gone").isNull()).select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()))
    if marks.where(~F.col("_gone")).limit(1).count() == 0:
        return kept
    row = F.struct("text", "lang", "source", "n_chars")
    once = marked.where(~F.col("_gone")).groupBy("doc_id").agg(F.min(row).alias("_row")).select("doc_id", "_row.*")
    return kept.unionByName(once.select(*COLUMNS))


def stage_secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret span in the texts.

    A null text stays null and an empty one empty; ``n_chars`` follows the text only where something was replaced.  Rows are read one by one.
    """
    found = secrets.scan(docs.select(*COLUMNS), redact_to=SECRET_MARK)
    length = F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(*COLUMNS)


def stage_source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that their sources come to their target weights.

    A null source is a source of its own, the last; null and empty texts have size 0 and are taken or not as others are.  Rows of one id
    are dealt in one order by their other columns, a null id like any; an empty table stays empty.
    """
    planned = mixing.plan(docs.select(*COLUMNS))
    partial = F.col("taken") != F.col("copies") * F.col("size")
    mixed = mixing.repeat(planned, [*COLUMNS, "copies", "size", "taken", "_whole"])
    return mixed.withColumn("n_chars", F.when(partial & ~F.col("_whole"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their token ids; ``round_trip`` tells whether the ids decode to the text.  A null text is encoded as the empty one."""
    return bpe.encode(docs.select(*COLUMNS), verify=True).select(*COLUMNS, "token_ids", "n_tokens", "round_trip")


STAGES = [
    ("language_id", stage_language_id),
    ("near_duplicates", stage_near_duplicates),
    ("secret_scan", stage_secret_scan),
    ("source_mix", stage_source_mix),
    ("bpe", stage_bpe),
]

#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read again, and goes once the next is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with common.run() as written:
        for name, stage in STAGES[:-1]:
            docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            common.clean(spark, written, keep=docs)  # what the stage wrote on its way, and what it read
    return STAGES[-1][1](spark, docs, sf_dir)
