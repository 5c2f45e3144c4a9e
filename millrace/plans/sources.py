"""Queries over sources and scalar functions: texts and bytes of the formats that a workspace holds, written from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.plans import session
from millrace.plans.catalog import register
from millrace.plans.tools import _text
from millrace.sources import documents as sources
from millrace.sources import files
from millrace.sources.tables import table
from millrace.streaming import changes

# ---------------------------------------------------------------- scalar functions


@register("""WITH d AS (SELECT doc_id AS d, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
 v AS (SELECT *, CASE WHEN d % 3 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS t, l[1] AS a, l[1][1:(d % 20)::INTEGER] || 'ZZ' AS b, [repeat(' ', (2 + (i % 3) * 2)::INTEGER) || ltrim(l[1:5][i + 1]) FOR i IN range(len(l[1:5]))] AS n FROM d),
 w AS (SELECT *, list_min([length(y) - length(ltrim(y)) FOR y IN n IF regexp_matches(y, '\\S')]) AS indent FROM v)
 SELECT d AS doc_id, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')[1:160] AS collapsed, d % 3 = 0 AND contains(text, chr(10)) AS crlf, md5(regexp_replace(t, '\\r\\n?', chr(10), 'g')) AS unified,
 replace(replace(replace(replace(replace('&lt;' || a || '&amp;gt; &quot;&apos;', '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS decoded,
 a[1:(list_max([k FOR k IN range(least(length(a), length(b)) + 1) IF a[1:k] = b[1:k]]))] AS shared, 'A<d' || d || ',B>|s|(x, y)' AS args, ((d % 3) * 3600 + (d % 60) * 60 + d % 60) * 1000 + d % 1000 AS ms, 'b' || d AS last, d % 2 = 0 AS suffix,
 array_to_string([y[coalesce(indent, 0) + 1:] FOR y IN n], chr(10)) AS dedented FROM w""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over every document."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).withColumn("t", F.when(d % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text")))
    lines = F.split("text", "\n")
    first = lines[0]
    padded = lambda n, width: F.lpad((d % n).cast("string"), width, "0")
    indented = F.transform(F.slice(lines, 1, 5), lambda x, i: F.concat(F.repeat(F.lit(" "), (2 + i % 3 * 2).cast("int")), F.ltrim(x)))
    return docs.select(
        "doc_id",
        tx.collapse(F.col("text")).alias("collapsed"),
        (tx.dominant_ending(F.col("t")) == "\r\n").alias("crlf"),
        F.md5(tx.unified_endings(F.col("t"))).alias("unified"),
        tx.entity_decoded(F.concat(F.lit("&lt;"), first, F.lit("&amp;gt; &quot;&apos;"))).alias("decoded"),
        tx.common_prefix(first, F.concat(F.left(first, (d % 20).cast("int")), F.lit("ZZ"))).alias("shared"),
        F.array_join(tx.arguments(_text("A<d", d, ",B>, s ,(x, y)")), "|").alias("args"),
        tx.duration_ms(_text(d % 3, ":", padded(60, 2), ":", padded(60, 2), ".", padded(1000, 3))).alias("ms"),
        tx.last_segment(_text("a.b", d)).alias("last"),
        tx.is_suffix_of(F.when(d % 2 == 0, "C.D").otherwise("x.D"), _text("A", d, ".C.D")).alias("suffix"),
        F.array_join(tx.dedented(indented), "\n").alias("dedented"),
    )


# ---------------------------------------------------------------- bytes


@register("SELECT doc_id, md5(text) AS digest, false AS skipped FROM documents WHERE text IS NOT NULL AND doc_id % 19 <> 0 AND doc_id % 17 <> 0")
def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file in one of four encodings, without binary files, decoded."""
    d = F.col("doc_id")
    mark = lambda digits: F.unhex(F.lit(digits))
    content = F.when(d % 4 == 0, F.encode("text", "UTF-8")).when(d % 4 == 1, F.concat(mark("EFBBBF"), F.encode("text", "UTF-8"))).when(d % 4 == 2, F.concat(mark("FFFE"), F.encode("text", "UTF-16LE"))).otherwise(F.concat(mark("FEFF"), F.encode("text", "UTF-16BE")))
    content = F.when(d % 17 == 0, F.concat(F.encode(F.lit("MZ"), "UTF-8"), mark("0000"), F.encode("text", "UTF-8"))).otherwise(content)
    held = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", _text("f", d, F.when(d % 19 == 0, ".DLL").otherwise(".txt")).alias("rel_path"), content.alias("content"))
    kept = files.prune(held.withColumn("length", F.octet_length("content")), (".dll",))
    return kept.select("doc_id", F.md5(files.decode(F.col("content"))).alias("digest"), "skipped")


# ---------------------------------------------------------------- solutions, projects, resources


@register("""SELECT 'w/s' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.sln' WHEN 1 THEN '.slnx' ELSE '.slnf' END AS path, 'src/P' || s_suppkey || '/' || x || '.csproj' AS project FROM supplier, (VALUES ('A'), ('B')) v(x)""")
def tool_solution_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of solutions in three formats."""
    s = F.col("s_suppkey")
    of = lambda before, between, after: F.concat(*[_text(before, "src", between, "P", s, between, x, ".csproj", after) for x in ("A", "B")])
    classic = _text("Microsoft Visual Studio Solution File\n", of('Project("{F}") = "N", "', "\\", '", "{G}"\nEndProject\n'))
    in_xml = _text('<Solution>\n<Folder Name="/x/" />\n', of('<Project Type="C" Path="', "/", '" />\n'), "</Solution>")
    in_json = _text('{"solution": {"path": "w.sln", "projects": ["src\\\\P', s, '\\\\A.csproj", "src\\\\P', s, '\\\\B.csproj"]}}')
    held = table(spark, sf_dir, "supplier").select(_text("w/s", s, F.when(s % 3 == 0, ".sln").when(s % 3 == 1, ".slnx").otherwise(".slnf")).alias("path"), F.when(s % 3 == 0, classic).when(s % 3 == 1, in_xml).otherwise(in_json).alias("text"))
    return sources.solution_projects(held)


@register("""SELECT 'p' || p_partkey || '.csproj' AS path, 'package' AS kind, 'Pkg.' || p_size AS name, CASE WHEN p_partkey % 3 <> 0 THEN p_size || '.0' END AS version FROM part
 UNION ALL SELECT 'p' || p_partkey || '.csproj', 'project', '../q/' || p_size || '.csproj', NULL FROM part WHERE p_partkey % 4 = 0""")
def tool_package_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package and project references of project files."""
    p, z = F.col("p_partkey"), F.col("p_size")
    package = _text('<PackageReference Include="Pkg.', z, '"', F.when(p % 3 != 0, _text(' Version="', z, '.0"')).otherwise(""), " />\n")
    project = F.when(p % 4 == 0, _text('<ProjectReference Include="..\\q\\', z, '.csproj" />')).otherwise("")
    held = table(spark, sf_dir, "part").select(_text("p", p, ".csproj").alias("path"), _text("<Project><ItemGroup>\n", package, project, "</ItemGroup></Project>").alias("text"))
    return sources.project_references(held)


@register("""WITH d AS (SELECT doc_id AS d, 'r/f' || (doc_id % 9) || '_' || doc_id AS family, CASE WHEN doc_id % 2 = 0 THEN 'de' END AS culture, coalesce(source, '') AS s FROM documents)
 SELECT family, family || coalesce('.' || culture, '') || '.resx' AS path, culture, 'a' || d AS name, '<' || s || '>' AS value, 'c & d' AS comment, 'Text' AS kind, true AS preserved, 2::INTEGER AS line FROM d
 UNION ALL SELECT family, family || coalesce('.' || culture, '') || '.resx', culture, 'b', s, NULL, CASE WHEN d % 3 = 0 THEN 'Typed' WHEN d % 3 = 1 THEN 'Binary' ELSE 'Text' END, false, 6 FROM d""")
def resource_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of resource files, one file for each document."""
    d = F.col("doc_id")
    family = _text("r/f", d % 9, "_", d)
    source = F.coalesce("source", F.lit(""))
    more = F.when(d % 3 == 0, ' type="T"').when(d % 3 == 1, ' mimetype="m"').otherwise("")
    text = _text('<root>\n<data name="a', d, '" xml:space="preserve">\n<value>&lt;', source, "&gt;</value>\n<comment>c &amp; d</comment></data>\n<!-- x -->\n<data name=\"b\"", more, "><value>", source, "</value></data></root>")
    held = table(spark, sf_dir, "documents").select(_text(family, F.when(d % 2 == 0, ".de").otherwise(""), ".resx").alias("path"), text.alias("text"))
    return sources.resource_entries(held)


# ---------------------------------------------------------------- change stream


@register("""WITH c AS (SELECT user_id % 4 AS u, 'd/f' || (user_id % 300) AS path, CASE WHEN ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) THEN 1 ELSE 0 END AS drain FROM events WHERE user_id % 4 <> 3 AND NOT (user_id % 4 = 2 AND event_type <> 'view'))
 SELECT CASE u WHEN 0 THEN 'Code' WHEN 1 THEN 'Xaml' ELSE 'Resx' END AS kind, count(DISTINCT drain) AS generation FROM c GROUP BY ALL""")
def change_stream_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many of two drains each kind changed."""
    u = F.col("user_id") % 4
    path = _text("d/f", F.col("user_id") % 300, F.when(u == 0, ".cs").when(u == 1, ".xaml").when((u == 2) & (F.col("event_type") == "view"), ".resx").otherwise(".txt"))
    events = table(spark, sf_dir, "events")
    middle = events.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("t")).scalar()
    log = events.withColumn("_t", middle).select(F.col("event_id").alias("seq"), path.alias("path"), F.lit("changed").alias("op"), F.lit(None).cast("timestamp").alias("modified"), F.lit(1).cast("long").alias("length"), (F.col("ts") >= F.col("_t")).alias("late"))
    folder = session.shared_folder(spark, "changes")
    for late in (False, True):
        log.where(F.col("late") == late).drop("late").write.mode("append").parquet(f"{folder}/log")
        changes.drain(spark, f"{folder}/log", f"{folder}/held")
    return changes.generations(changes.drains(spark, f"{folder}/held"))
