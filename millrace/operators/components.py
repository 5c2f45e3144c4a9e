"""Component files as tables: outline, binding sites and their members, members beside the markup, search by kind.

directives: path, line, name, value; nodes: path, line, tag, node_path, is_component, attributes array<struct<name, expression>>;
expressions: path, line, text; members: component, member, member_type, settable, path, line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import InvalidQuery
from millrace.functions import text as tx
from millrace.operators import graph, joins


def binding_kind(attribute: Column) -> Column:
    """``ref``, ``bind``, ``event`` or ``model`` by the name of an attribute, null for another."""
    return F.when(attribute == "@ref", "ref").when(F.startswith(attribute, F.lit("@bind")), "bind").when(F.startswith(attribute, F.lit("@on")), "event").when(attribute == "asp-for", "model")


def outline(directives: DataFrame, nodes: DataFrame, members: DataFrame, elements: bool = False) -> DataFrame:
    """(path, section, line, text): directives, then elements, then members; plain elements only if asked for.

    An element is plain if it is no component and none of its attributes binds.
    """
    shown = nodes if elements else nodes.where(F.col("is_component") | F.exists("attributes", lambda a: binding_kind(a["name"]).isNotNull()))
    depth = F.size(F.split("node_path", "/")) - 1
    parts = [
        directives.select("path", F.lit(1).alias("section"), "line", F.concat(F.lit("@"), "name", F.lit(" "), "value").alias("text")),
        shown.select("path", F.lit(2).alias("section"), "line", F.concat(F.repeat(F.lit("  "), depth), "tag").alias("text")),
        members.where(F.col("line") > 0).select("path", F.lit(3).alias("section"), "line", F.col("member").alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def binding_sites(nodes: DataFrame) -> DataFrame:
    """(path, line, tag, attribute, expression, kind) of every attribute that binds."""
    rows = nodes.select("path", "line", "tag", F.explode("attributes").alias("a"))
    kind = binding_kind(F.col("a.name"))
    return rows.select("path", "line", "tag", F.col("a.name").alias("attribute"), F.trim(F.col("a.expression")).alias("expression"), kind.alias("kind")).where(F.col("kind").isNotNull())


def lineage_order(lineage: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(type, component, via, depth): each type with all it derives from, itself first, then its chain of bases, then its interfaces.

    lineage: derived, base, and maybe is_interface.  ``via`` is 0 for the type and its bases and 1 for interfaces, wherever along the
    line they come in; within each, ``depth`` is the least number of steps.
    """
    every = graph.closure(lineage, "derived", "base", types).select(F.col("node").alias("type"), F.col("reached").alias("component"), "depth")
    if "is_interface" not in lineage.columns:
        return every.select("type", "component", F.lit(0).alias("via"), "depth")
    chain = graph.closure(lineage.where(~F.col("is_interface")), "derived", "base", types).select(F.col("node").alias("type"), F.col("reached").alias("component"), F.lit(0).alias("via"), "depth")
    through = every.join(chain.select("type", "component"), ["type", "component"], "left_anti").where("depth > 0")
    return chain.unionByName(through.select("type", "component", F.lit(1).alias("via"), "depth"))


def inherited(members: DataFrame, lineage: DataFrame) -> DataFrame:
    """(type, member, member_type, settable): own members and those of base types and interfaces, the first one of a name in the order of lineage."""
    nearest = lineage_order(lineage)
    known = nearest.select("type").distinct()
    alone = members.select(F.col("component").alias("type")).distinct().join(known, "type", "left_anti")
    # Types that only interfaces lead to have no row of their own in the chains.
    own = known.join(nearest.where("depth = 0").select("type"), "type", "left_anti")
    every = nearest.unionByName(alone.unionByName(own).select("type", F.col("type").alias("component"), F.lit(0).alias("via"), F.lit(0).alias("depth")))
    best = F.min(F.struct("via", "depth", "component", "member_type", "settable")).alias("m")
    return every.join(members, "component").groupBy("type", "member").agg(best).select("type", "member", "m.member_type", "m.settable")


def checked_sites(nodes: DataFrame, members: DataFrame, context: DataFrame, lineage: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Binding sites with a ``verdict``: OK, INLINE, UNRESOLVED, NO_SETTER or NO_CONTEXT; context: (path, component).

    An expression is walked segment by segment, calls without their arguments, through members and those of base types.
    """
    table = inherited(members, lineage) if lineage is not None else members.select(F.col("component").alias("type"), "member", "member_type", "settable")
    sites = binding_sites(nodes).join(context.select("path", F.col("component").alias("_start")), "path", "left")
    inline = (F.col("expression") == "") | F.contains("expression", F.lit("=>"))
    parts = F.filter(F.transform(F.split("expression", r"\."), lambda s: F.trim(F.regexp_replace(s, r"\(.*", ""))), lambda s: s != "")
    sites = sites.withColumn("_path", F.array_join(parts, "."))
    asked = sites.where(F.col("_start").isNotNull() & ~inline & (F.col("_path") != ""))
    paths = asked.select("_path", "_start").distinct()
    walked = joins.member_walk(paths, table, "_path", "_start", most)
    owner = joins.member_walk(paths.withColumn("_own", F.regexp_replace("_path", r"\.?[^.]*$", "")), table, "_own", "_start", most, ends="_owner").select("_path", "_start", "_owner")
    walked = walked.join(owner, ["_path", "_start"]).withColumn("_last", tx.last_segment(F.col("_path")))
    setters = table.select(F.col("type").alias("_owner"), F.col("member").alias("_last"), "settable")
    walked = walked.join(setters, ["_owner", "_last"], "left").select("_path", "_start", "resolved", "settable")
    joined = sites.join(walked, ["_path", "_start"], "left")
    verdict = (
        F.when(F.col("_start").isNull(), "NO_CONTEXT")
        .when(inline, "INLINE")
        .when(~F.coalesce("resolved", F.lit(False)), "UNRESOLVED")
        .when((F.col("kind") == "bind") & ~F.coalesce("settable", F.lit(True)), "NO_SETTER")
        .otherwise("OK")
    )
    return joined.select("path", "line", "tag", "attribute", "expression", "kind", verdict.alias("verdict"))


def code_behind(members: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, member, code_behind, style, script): members declared beside each component file, with the files that go with it."""
    owned = F.regexp_extract("file", r"^(.*\.(?:razor|cshtml))\.(cs|css|js)$", 1)
    suffix = F.regexp_extract("file", r"\.(cs|css|js)$", 1)
    beside = files.select(F.col("path").alias("file")).select(owned.alias("path"), suffix.alias("suffix"), "file").where(F.col("path") != "")
    own = lambda s, name: F.min(F.when(F.col("suffix") == s, F.col("file"))).alias(name)
    assets = beside.groupBy("path").agg(own("cs", "code_behind"), own("css", "style"), own("js", "script"))
    return members.select("path", "line", "member").join(assets, "path", "left")


KINDS = ("directive", "attribute", "expression", "route", "component", "element")


def find(kind: str, query: str, directives: DataFrame, nodes: DataFrame, expressions: DataFrame) -> DataFrame:
    """(path, line, kind, text) of what contains the query, ignoring case."""
    if not query.strip():
        raise InvalidQuery("the query is blank", "name what to find")
    if kind not in KINDS:
        raise InvalidQuery(f"the kind {kind!r} is unknown", f"use {', '.join(KINDS)}")
    has = lambda c: tx.contains_ci(c, query)
    if kind == "directive":
        found = directives.where(has(F.col("name")) | has(F.col("value"))).select("path", "line", F.concat(F.lit("@"), "name", F.lit(" "), "value").alias("text"))
    elif kind == "route":
        found = directives.where((F.col("name") == "page") & has(F.col("value"))).select("path", F.lit(1).alias("line"), F.col("value").alias("text"))
    elif kind == "attribute":
        found = nodes.select("path", "line", "tag", F.explode("attributes").alias("a")).where(has(F.col("a.name"))).select("path", "line", F.concat("tag", F.lit(" "), F.col("a.name")).alias("text"))
    elif kind == "expression":
        found = expressions.where(has(F.col("text"))).select("path", "line", F.trim("text").alias("text"))
    else:
        found = nodes.where(has(F.col("tag")) & (F.col("is_component") == (kind == "component"))).select("path", "line", F.col("node_path").alias("text"))
    return found.select("path", "line", F.lit(kind).alias("kind"), "text")
