"""Joins of the workspace queries: containment, prefix, missing and orphan keys, name resolution, member walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions import text as tx
from millrace.plans.session import ensure_checkpoint_dir


def containment(points: DataFrame, spans: DataFrame, key: str, start: str, end: str, span_start: str, span_end: str, span_id: str, point_id: str, bucket: int = 64) -> DataFrame:
    """Each interval with the innermost span of the same key around it; without one it stays, as HEURISTIC.

    A range join by key alone multiplies every interval with every span of its key.  Spans are dealt into strips of
    ``bucket`` lines instead, so an interval meets only the spans over the strip it starts in, by equality.  Of spans of one key with the
    same lines only the first can be an answer, so the others go before the join.
    """
    strips = spans.select(F.col(key).alias("_k"), F.col(span_start).alias("_ss"), F.col(span_end).alias("_se"), F.col(span_id).alias(span_id)).where(F.col("_ss") <= F.col("_se"))
    strips = strips.groupBy("_k", "_ss", "_se").agg(F.min(span_id).alias(span_id))
    strips = strips.withColumn("_strip", F.explode(F.sequence(F.floor(F.col("_ss") / bucket), F.floor(F.col("_se") / bucket))))
    placed = points.withColumn("_pstrip", F.floor(F.col(start) / bucket))
    inside = (F.col(key) == F.col("_k")) & (F.col("_pstrip") == F.col("_strip")) & (F.col("_ss") <= F.col(start)) & (F.col("_se") >= F.col(end))
    best = W.partitionBy(point_id).orderBy((F.col("_se") - F.col("_ss")).asc_nulls_last(), F.col(span_id).asc_nulls_last())
    joined = placed.join(strips.hint("merge"), inside, "left").withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
    return joined.select(*points.columns, span_id, F.when(F.col(span_id).isNull(), "HEURISTIC").otherwise("EXACT").alias("confidence"))


def prefix(sites: DataFrame, entries: DataFrame, uid: str, name: str, most: int = 4) -> DataFrame:
    """(uid, n, names): entries whose name is the uid or begins with ``uid.``; unresolved sites stay with n = 0.

    ``name = uid or name starts with uid.`` is an equality between the uid and one of the dotted prefixes of the
    name, so it is an equi-join.
    """
    parts = F.split(F.col(name), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    keyed = entries.where(F.col(name).isNotNull()).select(F.col(name).alias("_name"), F.explode(F.array_distinct(prefixes)).alias("_uid"))
    asked = sites.select(F.col(uid).alias("_site")).distinct()
    held = keyed.join(asked, F.col("_uid") == F.col("_site"), "left_semi")
    counts = held.groupBy("_uid").agg(F.count("*").alias("n"))
    listed = first_of(held, ["_uid"], ["_name"], most).groupBy("_uid").agg(F.array_join(F.sort_array(F.collect_list("_name")), ",").alias("names"))
    found = asked.join(counts, F.col("_site") == F.col("_uid"), "left").drop("_uid").join(listed, F.col("_site") == F.col("_uid"), "left")
    return found.select(F.col("_site").alias(uid), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("names", F.lit("")).alias("names"))


def first_of(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group: a group limit, of which each task passes on no more than that."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", nth).where(F.col("_rn") <= most).drop("_rn")


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``expected`` that ``present`` lacks; null keys compare equal."""
    right = present.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return expected.join(right, on, "left_anti")


def matrix(entries: DataFrame, key: str, column: str, value: str, columns: list[str], absent: str = "MISSING") -> DataFrame:
    """Keys by columns; a cell without a value reads ``MISSING``."""
    wide = entries.groupBy(key).pivot(column, columns).agg(F.min(value))
    return wide.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit(absent)).alias(c) for c in columns])


def resolve(names: DataFrame, symbols: DataFrame, query: str, container: str | None = None, nearest: int = 3, listed: int = 10, saturated: int = 100) -> DataFrame:
    """One row per asked name: ``status`` (ok, missing, ambiguous, saturated), ``n`` candidates, the first of them, and what is near.

    ``symbols`` has (name, container, id).  A container must equal the asked one or end with it at a dot.  Near a missing
    name are those that share its first three letters, ignoring case, by edit distance and then by name.
    """
    asked = names.select(F.col(query).alias("asked"), (F.col(container) if container else F.lit(None).cast("string")).alias("_within")).distinct()
    hit = asked.join(symbols, F.col("asked") == F.col("name"), "left")
    good = F.col("id").isNotNull() & (F.col("_within").isNull() | tx.is_suffix_of(F.col("_within"), F.coalesce("container", F.lit(""))))
    counted = hit.groupBy("asked", "_within").agg(F.count_if(good).alias("n"))
    first = first_of(hit.where(good).select("asked", "_within", F.col("id").cast("string").alias("id")), ["asked", "_within"], ["id"], listed)
    first = first.groupBy(F.col("asked").alias("_a"), F.col("_within").alias("_w")).agg(F.sort_array(F.collect_list("id")).alias("_ids"))
    grouped = counted.join(first, (F.col("asked") == F.col("_a")) & F.col("_within").eqNullSafe(F.col("_w")), "left").withColumn("_ids", F.coalesce("_ids", F.array().cast("array<string>")))
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "ok").when(F.col("n") > saturated, "saturated").otherwise("ambiguous")
    found = grouped.select("asked", "_within", status.alias("status"), "n", F.array_join("_ids", ",").alias("ids"))
    lead = lambda c: F.lower(F.left(c, F.lit(3)))
    names_near = symbols.select(F.col("name").alias("_near"), lead(F.col("name")).alias("_lead")).distinct()
    gone = found.where(F.col("status") == "missing").select("asked").distinct().withColumn("_lead", lead(F.col("asked"))).join(names_near, "_lead")
    best = W.partitionBy("asked").orderBy(F.levenshtein(F.lower("asked"), F.lower("_near")), "_near")
    gone = gone.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= nearest).groupBy("asked").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_near"))), lambda x: x["_near"]), ",").alias("near"))
    return found.join(gone, "asked", "left").select("asked", "status", "n", "ids", F.coalesce("near", F.lit("")).alias("near"))


def type_tokens(c: Column) -> Column:
    """A type as its names and brackets in order, without spaces and the names of tuple elements."""
    bare = F.regexp_replace(c, r"([\w>\])?])\s+[A-Za-z_]\w*", "$1")
    return F.regexp_extract_all(bare, F.lit(r"[<>,()\[\]?*]|[^<>,()\[\]?*\s]+"), F.lit(0))


def same_tokens(actual: Column, asked: Column) -> Column:
    """Whether the tokens of a type are the asked ones, of which each name may lack the qualifiers before it; null, of a blank type, fits any."""
    pairs = F.arrays_zip(actual.alias("a"), asked.alias("b"))
    return asked.isNull() | F.forall(pairs, lambda p: F.coalesce((p["a"] == p["b"]) | F.endswith(p["a"], F.concat(F.lit("."), p["b"])), F.lit(False)))


def resolve_overloads(names: DataFrame, symbols: DataFrame, query: str, listed: int = 10, saturated: int = 100) -> DataFrame:
    """One row per asked reference ``Container.Name(type, type)``: (asked, status, n, ids); the container and the parameters may be left out.

    ``symbols`` has (name, container, id, parameters array<string>, null for what takes none).  Parameters are split where no bracket is open and
    compared one by one.  A name that more than ``saturated`` symbols have is told by its container alone: with one it is looked up among
    those that the container holds, without one it is ``saturated``.
    """
    names = names.select(F.col(query).alias("asked")).distinct()
    text = F.trim(F.col("asked"))
    open_at = F.locate("(", text)
    name = F.trim(F.when(open_at > 0, F.substr(text, F.lit(1), open_at - 1)).otherwise(text))
    inside = F.trim(F.regexp_extract(text, r"(?s)^[^(]*\((.*)\)\s*$", 1))
    parts = F.when(open_at > 0, F.when(inside == "", F.array().cast("array<string>")).otherwise(tx.arguments(inside)))
    parts = F.transform(parts, lambda x: F.when(F.trim(x) != "", type_tokens(x)))
    asked = names.select("asked", tx.last_segment(name).alias("_name"), F.nullif(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), F.lit("")).alias("_within"), parts.alias("_asked"))
    # Stored, as conditions on what is parsed would else be asked of every reference before equal ones are folded.
    ensure_checkpoint_dir(asked.sparkSession)
    asked = asked.checkpoint()
    shapes = _shapes(symbols, listed).withColumn("_types", F.transform("parameters", type_tokens)).checkpoint()
    fits = F.when(F.col("_asked").isNull(), True).when(F.col("_types").isNull() | (F.size("_types") != F.size("_asked")), False).otherwise(F.forall(F.arrays_zip(F.col("_types").alias("p"), F.col("_asked").alias("q")), lambda x: same_tokens(x["p"], x["q"])))
    # A container that is the asked one or ends with it has the same last segment.
    held = asked.withColumn("_tail", tx.last_segment(F.col("_within"))).where(F.col("_within").isNotNull()).join(shapes.withColumn("_tail", tx.last_segment(F.col("_container"))).hint("merge"), ["_name", "_tail"])
    held = held.where(tx.is_suffix_of(F.col("_within"), F.col("_container")) & fits).select("asked", "_n", "_ids")
    free = asked.where(F.col("_within").isNull()).join(shapes.hint("merge"), "_name").where(fits).select("asked", "_n", "_ids")
    good = held.unionByName(free).checkpoint()
    counts = good.groupBy("asked").agg(F.sum("_n").alias("n"))
    first = first_of(good.select("asked", F.explode("_ids").alias("id")), ["asked"], ["id"], listed).groupBy("asked").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    every = shapes.groupBy("_name").agg(F.sum("_n").alias("_all"))
    found = asked.select("asked", "_name").join(every.hint("merge"), "_name", "left").join(counts, "asked", "left").join(first, "asked", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bare = F.regexp_extract("asked", r"^([^(]*)", 1)
    status = F.when((F.col("_all") > saturated) & ~F.contains(bare, F.lit(".")), "saturated").when(F.col("n") == 0, "missing").when(F.col("n") == 1, "ok").otherwise("ambiguous")
    return found.select("asked", status.alias("status"), "n", F.coalesce("ids", F.lit("")).alias("ids"))


def _shapes(symbols: DataFrame, listed: int) -> DataFrame:
    """(_name, _container, parameters, _n, _ids): symbols alike in all but their ids, how many these are and the first of them.

    A reference fits all of them or none, so it is compared with one row for all.
    """
    alike = ["_name", "_container", "parameters"]
    named = symbols.select(F.col("name").alias("_name"), F.coalesce("container", F.lit("")).alias("_container"), "parameters", F.col("id").cast("string").alias("id")).where(F.col("id").isNotNull())
    counts = named.groupBy(*alike).agg(F.count("*").alias("_n"))
    first = first_of(named, alike, ["id"], listed).groupBy(*alike).agg(F.collect_list("id").alias("_ids"))
    # Parameters may be null, which grouping compares as equal.
    both = counts.withColumn("_ids", F.lit(None).cast("array<string>")).unionByName(first.withColumn("_n", F.lit(None).cast("long")))
    return both.groupBy(*alike).agg(F.max("_n").alias("_n"), F.max("_ids").alias("_ids"))


def member_walk(paths: DataFrame, members: DataFrame, path: str, start_type: str, most: int | None = 8, ends: str | None = None) -> DataFrame:
    """Walk dotted member paths through (type, member, member_type); ``resolved`` and the first ``broken`` segment.

    The walk takes as many steps as the longest path has segments, which one job finds out, unless ``most`` bounds them: then a path that is
    longer and not broken within them is not told: ``resolved`` is null.  With ``ends``, the type that the walk ends at is a column of that name.
    Each step is a join, and every few of them lineage is cut.
    """
    walk = paths.withColumn("_parts", F.filter(F.split(F.col(path), r"\."), lambda x: x != "")).withColumn("_type", F.col(start_type)).withColumn("broken", F.lit(None).cast("string"))
    if most is None:
        most = walk.agg(F.max(F.size("_parts"))).first()[0] or 0
    table = members.select(F.col("type").alias("_mt"), F.col("member").alias("_mm"), F.col("member_type").alias("_mr")).groupBy("_mt", "_mm").agg(F.min("_mr").alias("_mr"))
    for depth in range(1, most + 1):
        part = F.try_element_at("_parts", F.lit(depth))
        walk = walk.withColumn("_part", part).join(table, (F.col("_type") == F.col("_mt")) & (F.col("_part") == F.col("_mm")), "left")
        stuck = F.col("broken").isNull() & F.col("_part").isNotNull() & F.col("_mm").isNull()
        walk = walk.withColumn("broken", F.when(stuck, F.col("_part")).otherwise(F.col("broken")))
        walk = walk.withColumn("_type", F.when(F.col("_part").isNotNull(), F.col("_mr")).otherwise(F.col("_type"))).drop("_mt", "_mm", "_mr", "_part")
        if depth % 8 == 0 and depth < most:
            ensure_checkpoint_dir(walk.sparkSession)
            walk = walk.checkpoint()
    resolved = F.when(F.col("broken").isNotNull(), False).when(F.size("_parts") <= most, True)
    return walk.select(*paths.columns, resolved.alias("resolved"), "broken", *([F.col("_type").alias(ends)] if ends else []))


def pickaxe(versions: DataFrame, key: str, order: str, count: Column) -> DataFrame:
    """Versions at which the count of a literal differs from the version before."""
    was = F.lag("occurrences", 1, 0).over(W.partitionBy(key).orderBy(order))
    return versions.withColumn("occurrences", count).withColumn("was", was).where(F.col("occurrences") != F.col("was"))


def expand_through(direct: DataFrame, calls: DataFrame, bodies: DataFrame, method: str) -> DataFrame:
    """Direct rows, and rows of helper bodies once for each call of the helper."""
    return direct.unionByName(calls.join(bodies, method).select(*direct.columns))
