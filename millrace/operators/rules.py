"""Validation rules as queries: each gives (rule, path, key, detail), and a run is their union filtered by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions import text as tx
from millrace.operators import graph

DEFAULT_RESOURCE_RULES = ("RESX001", "RESX002", "RESX004", "RESX005", "RESX006", "RESX007", "RESX009")


def _finding(df: DataFrame, rule: str, path: str, key: str, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(path).alias("path"), F.col(key).cast("string").alias("key"), detail.alias("detail"))


# ---------------------------------------------------------------- resource files
# entries: family, path, culture (null: neutral), name, value, kind, preserved, line


def resx_missing(entries: DataFrame) -> DataFrame:
    """RESX001: a translatable neutral key that a culture's file lacks."""
    text = entries.where(F.col("kind") == "Text")
    neutral = text.where(F.col("culture").isNull()).select("family", "name", "value").dropDuplicates(["family", "name"])
    files = entries.where(F.col("culture").isNotNull()).select("family", "path", "culture").distinct()
    wanted = neutral.join(files, "family")
    gone = wanted.join(text.where(F.col("culture").isNotNull()).select("path", "name"), ["path", "name"], "left_anti")
    return _finding(gone, "RESX001", "path", "name", F.concat("culture", F.lit(": untranslated")))


def _paired(entries: DataFrame) -> DataFrame:
    text = entries.where(F.col("kind") == "Text")
    neutral = text.where(F.col("culture").isNull()).groupBy("family", "name").agg(F.min_by("value", "line").alias("neutral"))
    return text.where(F.col("culture").isNotNull()).join(neutral, ["family", "name"])


def _differs() -> tuple:
    expected, actual = tx.placeholders(F.col("neutral")), tx.placeholders(F.col("value"))
    return F.sort_array(F.array_except(actual, expected)), F.sort_array(F.array_except(expected, actual))


def resx_placeholders(entries: DataFrame) -> DataFrame:
    """RESX002: the sets of placeholders differ."""
    extra, absent = _differs()
    return _finding(_paired(entries).where((F.size(extra) > 0) | (F.size(absent) > 0)), "RESX002", "path", "name", F.concat(F.lit("extra="), F.array_join(extra.cast("array<string>"), ","), F.lit(" absent="), F.array_join(absent.cast("array<string>"), ",")))


def resx_unused(entries: DataFrame, tokens: DataFrame) -> DataFrame:
    """RESX003 (opt-in): a translatable neutral key that no code token names."""
    keys = entries.where((F.col("kind") == "Text") & F.col("culture").isNull()).select("path", "name").distinct()
    return _finding(keys.join(tokens.select(F.col(tokens.columns[0]).alias("name")), "name", "left_anti"), "RESX003", "path", "name", F.lit("nothing names it"))


def resx_duplicates(entries: DataFrame) -> DataFrame:
    """RESX004: a key declared more than once in a file."""
    twice = entries.groupBy("path", "name").agg(F.sort_array(F.collect_list("line")).alias("lines")).where(F.size("lines") > 1)
    return _finding(twice, "RESX004", "path", "name", F.concat(F.lit("repeated: "), F.array_join(F.col("lines").cast("array<string>"), ", ")))


def resx_orphans(entries: DataFrame) -> DataFrame:
    """RESX005: a culture's key that the neutral file lacks."""
    neutral = entries.where(F.col("culture").isNull()).select("family", "name")
    return _finding(entries.where((F.col("kind") == "Text") & F.col("culture").isNotNull()).join(neutral, ["family", "name"], "left_anti"), "RESX005", "path", "name", F.lit("has no neutral counterpart"))


def resx_empty(entries: DataFrame) -> DataFrame:
    """RESX006: an empty localized value, unless RESX002 already tells of it."""
    extra, absent = _differs()
    return _finding(_paired(entries).where((F.col("value") == "") & (F.size(extra) == 0) & (F.size(absent) == 0)), "RESX006", "path", "name", F.lit("blank translation"))


def resx_whitespace(entries: DataFrame) -> DataFrame:
    """RESX007: an untrimmed value that is not marked as preserved."""
    return _finding(entries.where((F.col("kind") == "Text") & ~F.col("preserved") & (F.col("value") != tx.trim_any(F.col("value")))), "RESX007", "path", "name", F.lit("padded value"))


def resx_unsorted(entries: DataFrame) -> DataFrame:
    """RESX008 (opt-in): the keys of a file are not in ordinal order."""
    was = F.lag("name").over(W.partitionBy("path").orderBy("line"))
    return _finding(entries.withColumn("_was", was).where(F.col("_was") > F.col("name")).select("path").distinct().withColumn("name", F.lit("-")), "RESX008", "path", "name", F.lit("keys unsorted"))


def resx_designer(entries: DataFrame, designers: DataFrame) -> DataFrame:
    """RESX009: an identifier-shaped neutral key that the designer text does not hold; designers: (family, designer, text)."""
    keys = entries.where((F.col("kind") == "Text") & F.col("culture").isNull() & tx.is_identifier(F.col("name"))).select("family", "name").distinct()
    return _finding(keys.join(designers, "family").where(F.col("text").isNotNull() & ~F.contains("text", F.col("name"))), "RESX009", "designer", "name", F.lit("missing from generated code"))


def validate_resources(entries: DataFrame, tokens: DataFrame | None = None, designers: DataFrame | None = None, rules: tuple[str, ...] = DEFAULT_RESOURCE_RULES) -> DataFrame:
    """All selected resource rules; rules that lack their input table give nothing."""
    made = {"RESX001": resx_missing, "RESX002": resx_placeholders, "RESX004": resx_duplicates, "RESX005": resx_orphans, "RESX006": resx_empty, "RESX007": resx_whitespace, "RESX008": resx_unsorted}
    parts = [f(entries) for code, f in made.items() if code in rules]
    if tokens is not None and "RESX003" in rules:
        parts.append(resx_unused(entries, tokens))
    if designers is not None and "RESX009" in rules:
        parts.append(resx_designer(entries, designers))
    return _union(parts, entries)


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    if not parts:
        return like.sparkSession.createDataFrame([], "rule string, path string, key string, detail string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def family_missing(entries: DataFrame) -> DataFrame:
    """(family, missing): neutral keys that cultures lack, summed over the cultures."""
    gone = resx_missing(entries).groupBy("path").agg(F.count("*").alias("missing"))
    files = entries.select("family", "path").distinct()
    return files.join(gone, "path", "left").groupBy("family").agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))


# ---------------------------------------------------------------- markup files
# elements: file, line, type_name, key, name, parsed; references: file, line, key


def markup_unparsed(files: DataFrame) -> DataFrame:
    """XAML000: files that did not parse; files: (file, parsed)."""
    return _finding(files.where(~F.col("parsed")).withColumn("_k", F.lit("-")), "XAML000", "file", "_k", F.lit("the file does not parse"))


def _repeated(rows: DataFrame, group: list[Column], order: list[str]) -> DataFrame:
    """All rows of a group but the first in order, from counts: a group of very many rows is not gathered in one task."""
    columns = rows.columns
    keyed = rows.select(*columns, *[g.alias(f"_g{i}") for i, g in enumerate(group)])
    keys = [f"_g{i}" for i in range(len(group))]
    counted = keyed.groupBy(*keys, *columns).agg(F.count("*").alias("_n"))
    first = counted.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("_first"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_first.{c}"))
    on = [counted[k].eqNullSafe(first[k]) for k in keys]
    left = counted.join(first, on).select(*[counted[c] for c in columns], (F.col("_n") - same.cast("int")).alias("_again"))
    return left.where("_again > 0").select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("_again").cast("int"))).alias("_")).drop("_")


def markup_duplicates(elements: DataFrame, column: str, rule: str) -> DataFrame:
    """XAML001 (keys) and XAML002 (names): the second and later ones of a file."""
    again = _repeated(elements.where(F.col(column).isNotNull()).select("file", "line", column), [F.col("file"), F.col(column)], ["line"])
    return _finding(again, rule, "file", column, F.concat(F.lit("again at line "), F.col("line").cast("string")))


def markup_unresolved(references: DataFrame, elements: DataFrame, files: DataFrame) -> DataFrame:
    """XAML003: a reference to a key that nothing declares; silent if any file failed to parse."""
    failed = files.agg(F.count_if(~F.col("parsed")).alias("n")).scalar()
    gone = references.join(elements.where(F.col("key").isNotNull()).select("key").distinct(), "key", "left_anti")
    return _finding(gone.withColumn("_failed", failed).where("_failed = 0"), "XAML003", "file", "key", F.concat(F.lit("line "), F.col("line").cast("string")))


def markup_unused(elements: DataFrame, mentions: DataFrame, column: str, rule: str) -> DataFrame:
    """XAML004 (keys) and XAML005 (names): declared and never mentioned; mentions: one column of tokens."""
    used = mentions.select(F.col(mentions.columns[0]).alias(column)).distinct()
    return _finding(elements.where(F.col(column).isNotNull()).join(used, column, "left_anti"), rule, "file", column, F.concat(F.lit("line "), F.col("line").cast("string")))


# ---------------------------------------------------------------- component files
# uses: path, line, component, attributes array<string>; parameters: component, parameter, required, settable


def unknown_components(uses: DataFrame, components: DataFrame) -> DataFrame:
    """RZR001."""
    return _finding(uses.join(components.select("component").distinct(), "component", "left_anti"), "RZR001", "path", "component", F.lit("unknown component"))


def unknown_parameters(uses: DataFrame, parameters: DataFrame, catch_all: DataFrame) -> DataFrame:
    """RZR002: an attribute that is no parameter, unless the component takes any attribute; catch_all: (component)."""
    known = parameters.select("component").distinct()
    asked = uses.join(known, "component", "left_semi").join(catch_all.select("component"), "component", "left_anti").select("path", "component", F.explode("attributes").alias("parameter"))
    return _finding(asked.join(parameters.select("component", "parameter"), ["component", "parameter"], "left_anti"), "RZR002", "path", "parameter", F.col("component"))


def required_parameters(uses: DataFrame, parameters: DataFrame) -> DataFrame:
    """RZR003: a required parameter that a use does not set."""
    wanted = uses.join(parameters.where("required").select("component", "parameter"), "component")
    return _finding(wanted.where(~F.array_contains("attributes", F.col("parameter"))), "RZR003", "path", "parameter", F.col("component"))


def unsettable_binds(binds: DataFrame, properties: DataFrame) -> DataFrame:
    """RZR004: bound to a property without a setter; binds: (path, component, property); properties: (component, property, settable)."""
    return _finding(binds.join(properties, ["component", "property"]).where(~F.col("settable")), "RZR004", "path", "property", F.col("component"))


def route_parameters(routes: DataFrame, parameters: DataFrame) -> DataFrame:
    """RZR005: a parameter in a route without a property of its name; routes: (path, component, route)."""
    asked = routes.withColumn("parameter", F.explode(F.regexp_extract_all("route", F.lit(r"\{\*{0,2}(\w+)[^}]*\}"), F.lit(1))))
    known = parameters.select("component", F.lower("parameter").alias("_p"))
    return _finding(asked.withColumn("_p", F.lower("parameter")).join(known, ["component", "_p"], "left_anti"), "RZR005", "path", "parameter", F.col("route"))


def duplicate_routes(routes: DataFrame) -> DataFrame:
    """RZR006: the second and later declarations of a route, ignoring case."""
    return _finding(_repeated(routes.where(F.col("route").isNotNull()).select("path", "route"), [F.lower("route")], ["path"]), "RZR006", "path", "route", F.lit("duplicate route"))


def reference_types(refs: DataFrame, lineage: DataFrame) -> DataFrame:
    """RZR007: a reference whose field type is neither the component nor anything that it derives from, at whatever distance;
    refs: (path, component, field_type); lineage: (type, base)."""
    own = refs.where(F.col("component") != F.col("field_type"))
    # Only the lines of components that are referred to by another type are followed.
    known = graph.closure(lineage, "type", "base", own.select("component").distinct()).select(F.col("node").alias("component"), F.col("reached").alias("field_type"))
    return _finding(own.join(known, ["component", "field_type"], "left_anti"), "RZR007", "path", "component", F.col("field_type"))


def orphan_stylesheets(sheets: DataFrame, components: DataFrame) -> DataFrame:
    """RZR008: a ``x.razor.css`` without ``x.razor``; both: (path)."""
    owner = F.regexp_replace("path", r"\.css$", "")
    return _finding(sheets.withColumn("_owner", owner).join(components.select(F.col("path").alias("_owner")), "_owner", "left_anti"), "RZR008", "path", "_owner", F.lit("no component"))


def unregistered_injections(injects: DataFrame, registered: DataFrame, provided: DataFrame) -> DataFrame:
    """RZR009: an injected type that is neither registered nor provided by the host; injects: (path, type)."""
    return _finding(injects.join(registered.select("type"), "type", "left_anti").join(provided.select("type"), "type", "left_anti"), "RZR009", "path", "type", F.lit("never registered"))


def flagged_files(files: DataFrame, rule: str, flag: str, detail: str) -> DataFrame:
    """RZR000 and RZR010: files with a flag."""
    return _finding(files.where(F.col(flag)).withColumn("_k", F.lit("-")), rule, "path", "_k", F.lit(detail))


def dead_members(members: DataFrame, refs: DataFrame) -> DataFrame:
    """DEAD001: a private member without a reference in the files that declare it; members: (id, path, name, private)."""
    own = members.where("private")
    return _finding(own.join(refs.select(F.col("symbol_id").alias("id"), "path"), ["id", "path"], "left_anti"), "DEAD001", "path", "name", F.lit("never referenced"))
