"""Which identifiers texts mention, and where: an inverted index made from the texts, and the usages of keys found through it.

Lines are cut and searched where texts are read, so the index itself needs no shuffle; only distinct tokens or counts do.  Asked for some keys, texts that
hold none of them are dropped before they are cut.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import InvalidQuery
from millrace.functions import text as tx
from millrace.operators import search

#: Keys up to which texts are looked through for each of them before they are cut.
MOST_NEEDLES = 32
#: Most distinct keys that are broadcast.
MOST_BROADCAST = 200_000

# Endings of files whose texts use resource keys, generated files among them, and ways to compose a key at run time.
SCANNED_ENDINGS = (".cs", ".xaml", ".axaml", ".paml", ".cshtml", ".razor")
GENERATED_ENDING = ".designer.cs"
COMPOSED = r"""(GetString\s*\(\s*[^"\s)]|GetString\s*\([^)]*\+|ocalizer\s*\[\s*[^"\]]|ocalizer\s*\[[^\]]*\+)"""


def scanned(path: Column) -> Column:
    """Whether the text of a file may use resource keys."""
    return tx.extension(path).isin(*SCANNED_ENDINGS) & ~F.endswith(F.lower(path), F.lit(GENERATED_ENDING))


def index(files: DataFrame, id_col: str = "rel_path", text_col: str = "text") -> DataFrame:
    """(id, line, token): identifiers, dotted ones and their parts, each once a line."""
    return search.lines(files, id_col, text_col).select(id_col, "line", F.explode(tx.identifiers(F.col("text"))).alias("token"))


def tokens(files: DataFrame, id_col: str = "rel_path", text_col: str = "text") -> DataFrame:
    """(token): all that is mentioned anywhere; distinct within a text before anything is shuffled."""
    return files.where(F.col(text_col).isNotNull()).select(F.explode(tx.identifiers(F.col(text_col))).alias("token")).distinct()


def counts(files: DataFrame, id_col: str = "rel_path", text_col: str = "text") -> DataFrame:
    """(token, lines, texts) of all tokens: on how many lines and in how many texts each is.

    Lines and texts are counted apart, each where texts are read, so that only sums by token are shuffled.
    """
    held = files.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    on_lines = F.flatten(F.transform(F.split("text", "\n"), tx.identifiers))
    found = held.select(F.explode(on_lines).alias("token")).groupBy("token").agg(F.count("*").alias("lines"), F.lit(0).cast("long").alias("texts"))
    more = held.select(F.explode(tx.identifiers(F.col("text"))).alias("token")).groupBy("token").agg(F.lit(0).cast("long").alias("lines"), F.count("*").alias("texts"))
    return found.unionByName(more).groupBy("token").agg(F.sum("lines").alias("lines"), F.sum("texts").alias("texts"))


def of_keys(files: DataFrame, keys: DataFrame, key: str = "key", id_col: str = "rel_path", text_col: str = "text") -> DataFrame:
    """(id, line, key): where each of the keys (any number of them) is mentioned."""
    asked = keys.select(F.col(key).alias("token")).where(F.col("token").isNotNull()).distinct()
    some = [r["token"] for r in asked.limit(MOST_NEEDLES + 1).collect()]
    if len(some) <= MOST_NEEDLES:
        any_of = F.lit(False)
        for k in some:
            any_of = any_of | F.contains(F.col(text_col), F.lit(k))
        files = files.where(any_of)
    found = index(files, id_col, text_col)
    few = len(some) <= MOST_NEEDLES or asked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return found.join(F.broadcast(asked) if few else asked, "token", "left_semi").withColumnRenamed("token", key)


def key_usages(files: DataFrame, key: str, id_col: str = "rel_path", text_col: str = "text") -> DataFrame:
    """(id, line, form): lines that hold the key in quotes or as a member of something.

    ``form`` is ``x:Uid``, ``GetString``, ``localizer[]``, ``literal`` or ``member``, the first that fits the line.
    """
    if not key:
        raise InvalidQuery("the key is blank", "name a resource key")
    quoted = f'"{key}"'
    member = r"\b[A-Za-z_]\w*\s*\.\s*" + re.sub(r"([^\w\s])", r"\\\1", key) + r"\b"
    has = lambda needle: F.contains("text", F.lit(needle))
    lines = search.lines(files.where(F.contains(F.col(text_col), F.lit(key))), id_col, text_col)
    hits = lines.where(has(key)).where(has(quoted) | F.col("text").rlike(member))
    form = F.when(has("x:Uid="), "x:Uid").when(has("GetString"), "GetString").when(has("ocalizer["), "localizer[]").when(has(quoted), "literal").otherwise("member")
    return hits.select(id_col, "line", form.alias("form"))


def composed_lookups(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(composed): lines that put a key together at run time, which makes ``no usages`` no proof; one row."""
    held = files.where(F.contains(F.col(text_col), F.lit("GetString")) | F.contains(F.col(text_col), F.lit("ocalizer")))
    return search.lines(held.select(F.lit(1).alias("_id"), text_col), "_id", text_col).agg(F.count_if(F.col("text").rlike(COMPOSED)).alias("composed"))


def markup_references(elements: DataFrame) -> DataFrame:
    """(file, line, key): resources that attribute values of elements refer to."""
    values = F.flatten(F.transform(F.map_values("attributes"), lambda v: F.regexp_extract_all(v, F.lit(r"\{(?:StaticResource|DynamicResource|ThemeResource)\s+(?:ResourceKey=)?([^\s{},]+)"), F.lit(1))))
    return elements.select("file", "line", F.explode(values).alias("key"))
