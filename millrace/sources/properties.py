"""Evaluation of project properties: files in the order in which they import each other, definitions in turn, each with the file that made it.

Every file is cut into its definitions and imports once, as columns.  The imports of all projects are followed together, a round of joins for
each level, and an event's place is the list of places on its way, so that the order of evaluation is that of these lists.  The definitions of one project
are then taken in order: a later one wins, and ``$(Name)`` is what the name holds at that point, so one may extend itself.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions import text as tx
from millrace.plans.session import ensure_checkpoint_dir

#: Most events of all files that are broadcast.
MOST_BROADCAST = 200_000
PROJECT_ENDINGS = (".csproj", ".fsproj", ".vbproj")
# Files that a project takes in by itself, from the nearest folder above it that has one: before and after its own text.
IMPLICIT = ("Directory.Build.props", "Directory.Build.targets")

_EVENT = r"""<Import\s[^>]*>|<PropertyGroup(?:\s[^>]*)?>|</PropertyGroup>|<[A-Za-z_][\w.-]*(?:\s[^<>]*)?>[^<]*</[A-Za-z_][\w.-]*>|<[A-Za-z_][\w.-]*\s*/>"""


def normalised(path: Column) -> Column:
    """A path without ``.``, ``..`` and backslashes; what leads above the root stays there."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(F.when(F.size(parts) > 0, up).otherwise(parts), "/")


def events(files: DataFrame) -> DataFrame:
    """(file, ord, name, value, condition, target): the definitions and imports of files (rel_path, text) in order.

    ``target`` is the path an import names from the root, null for a definition.  Imports by a property other than the folder of their file,
    and those of sdks, name no file.
    """
    plain = F.regexp_replace("text", r"(?s)<!--.*?-->", "")
    cut = files.where(F.col("text").isNotNull()).select(F.col("rel_path").alias("file"), F.posexplode(F.regexp_extract_all(plain, F.lit(_EVENT), F.lit(0))).alias("ord", "_x"))
    is_group, ends = F.startswith("_x", F.lit("<PropertyGroup")), F.col("_x") == "</PropertyGroup>"
    before = W.partitionBy("file").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    step = F.when(is_group & ~F.endswith("_x", F.lit("/>")), 1).when(ends, -1).otherwise(0)
    condition = F.nullif(F.regexp_extract("_x", r"""^<[^>]*?\sCondition\s*=\s*["]([^"]*)["]""", 1), F.lit(""))
    found = cut.withColumn("_open", F.coalesce(F.sum(step).over(before), F.lit(0))).withColumn("_own", tx.entity_decoded(condition))
    found = found.withColumn("_group", F.last(F.when(is_group, F.coalesce("_own", F.lit(""))), ignorenulls=True).over(before))
    path = F.replace(F.regexp_extract("_x", r"""\sProject\s*=\s*["']([^"']*)["']""", 1), F.lit("$(MSBuildThisFileDirectory)"), F.lit(""))
    folder = tx.directory(F.col("file"))
    target = F.when(F.startswith("_x", F.lit("<Import")) & (path != "") & ~F.contains(path, F.lit("$(")) & ~F.col("_x").rlike(r"\sSdk\s*="), normalised(F.concat(folder, F.lit("/"), path)))
    name = F.when((F.col("_open") > 0) & ~is_group & ~ends & ~F.startswith("_x", F.lit("<Import")), F.regexp_extract("_x", r"^<([\w.-]+)", 1))
    both = F.array_compact(F.array(F.when((F.col("_open") > 0) & (F.col("_group") != ""), F.col("_group")), F.col("_own")))
    kept = found.select("file", "ord", name.alias("name"), tx.entity_decoded(F.regexp_extract("_x", r"(?s)>([^<]*)<", 1)).alias("value"), both.alias("conditions"), target.alias("target"))
    return kept.where(F.col("name").isNotNull() | F.col("target").isNotNull())


def _implicit(files: DataFrame) -> DataFrame:
    """(file, ord, target) of what projects take in by themselves: ord is before or after all of theirs."""
    folder = tx.directory(F.col("file"))
    projects = files.where(tx.extension(F.col("rel_path")).isin(*PROJECT_ENDINGS)).select(F.col("rel_path").alias("file")).withColumn("_parts", F.filter(F.split(folder, "/"), lambda x: x != ""))
    above = projects.select("file", F.explode(F.sequence(F.lit(0), F.size("_parts"))).alias("_depth"), "_parts").withColumn("_folder", F.array_join(F.slice("_parts", 1, F.col("_depth")), "/"))
    held = files.select(F.col("rel_path").alias("target"), tx.file_name(F.col("rel_path")).alias("_name")).where(F.col("_name").isin(*IMPLICIT)).withColumn("_folder", tx.directory(F.col("target")))
    nearest = above.join(held, "_folder").groupBy("file", "_name").agg(F.max_by("target", "_depth").alias("target"))
    return nearest.select("file", F.when(F.col("_name") == IMPLICIT[0], -1).otherwise(2**31 - 1).alias("ord"), "target")


def ordered(files: DataFrame) -> DataFrame:
    """(project, place, file, name, value, conditions, target, chain): the events of each project and of all that it imports, directly or not.

    ``place`` sorts them into the order of evaluation.  A file that is on the way to itself is not taken in again.
    """
    ensure_checkpoint_dir(files.sparkSession)
    own = events(files)
    empty = F.array().cast("array<string>")
    own = own.unionByName(_implicit(files).select("file", "ord", F.lit(None).cast("string").alias("name"), F.lit("").alias("value"), empty.alias("conditions"), "target")).checkpoint()
    # A file that very many projects import meets them where they are, as long as all events are few.
    own = F.broadcast(own) if own.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else own
    front = files.where(tx.extension(F.col("rel_path")).isin(*PROJECT_ENDINGS)).select(F.col("rel_path").alias("project"), F.col("rel_path").alias("file"), F.array().cast("array<int>").alias("_at"), F.array("rel_path").alias("chain")).distinct()
    every = None
    while True:
        found = front.join(own, "file").select("project", F.concat("_at", F.array("ord")).alias("place"), "file", "name", "value", "conditions", "target", "chain").checkpoint()
        every = found if every is None else every.unionByName(found)
        into = found.where(F.col("target").isNotNull() & ~F.array_contains("chain", F.col("target")))
        front = into.select("project", F.col("target").alias("file"), F.col("place").alias("_at"), F.concat("chain", F.array("target")).alias("chain"))
        if front.join(own.select("file").distinct(), "file", "left_semi").isEmpty():
            return every


_REFERENCE = re.compile(r"\$\(([A-Za-z_][\w.-]*)\)")
_COMPARED = re.compile(r"^\s*'([^']*)'\s*(==|!=)\s*'([^']*)'\s*$")


def _holds(condition: str, values: dict[str, tuple[str, str, str]]) -> bool:
    """Whether a condition holds: comparisons of two quoted texts are told, any other counts as true."""
    m = _COMPARED.match(_REFERENCE.sub(lambda r: values.get(r[1].lower(), ("", "", ""))[1], condition))
    return m is None or (m[1].lower() == m[3].lower()) == (m[2] == "==")


def _taken(frame: pd.DataFrame) -> pd.DataFrame:
    """Last definitions of the events of one project, in order; a file counts where it is first taken in, and an import whose condition fails not at all."""
    values: dict[str, tuple[str, str, str]] = {}
    first: dict[str, tuple] = {frame["project"].iloc[0]: ()}
    entered = {()}
    rows = sorted(zip(frame["place"].map(tuple), frame["file"], frame["name"], frame["value"], frame["conditions"], frame["target"], strict=True), key=lambda r: r[0])
    for place, file, name, value, conditions, target in rows:
        if place[:-1] not in entered or first.get(file) != place[:-1] or not all(_holds(c, values) for c in conditions):
            continue
        if target is not None:
            if target not in first:
                first[target] = place
                entered.add(place)
            continue
        text = _REFERENCE.sub(lambda r: values.get(r[1].lower(), ("", "", ""))[1], value.strip())
        values[name.lower()] = (name, text, file)
    return pd.DataFrame({"path": frame["project"].iloc[0], "name": [v[0] for v in values.values()], "value": [v[1] for v in values.values()], "file": [v[2] for v in values.values()]})


def evaluated(files: DataFrame, name: str | None = None) -> DataFrame:
    """(path, name, value, file): the properties of every project after evaluation, with the file whose definition holds.

    Names compare ignoring case.  A project's events are those of the files it imports, so they fit one task.
    """
    found = ordered(files).select("project", "place", "file", "name", "value", "conditions", "target").groupBy("project").applyInPandas(_taken, "path string, name string, value string, file string")
    return found.where(F.lower("name") == name.lower()) if name else found
