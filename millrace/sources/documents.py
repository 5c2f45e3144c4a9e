"""Structured workspace files as rows: resource files, solutions, projects and test results.

They are parsed by the built-in XML and JSON functions from (path, text) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx

_RESX = "data ARRAY<STRUCT<_name: STRING, _type: STRING, _mimetype: STRING, _space: STRING, `_xml:space`: STRING, value: STRING, comment: STRING>>"


def resource_entries(files: DataFrame) -> DataFrame:
    """(family, path, culture, name, value, comment, kind, preserved, line) of resource files (path, text).

    The XML reader gives no lines, so a line is that of the n-th declaration in the text.
    """
    name = tx.file_name(F.col("path"))
    culture = F.regexp_extract(name, r"^[^.]+\.([A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*)\.res[xw]$", 1)
    family = F.concat(tx.directory(F.col("path")), F.lit("/"), F.regexp_extract(name, r"^([^.]+)\.", 1))
    before = F.split("text", r"<data\s")
    line_of = lambda i: F.size(F.split(F.array_join(F.slice(before, 1, i + 1), "<data "), "\n"))
    parsed = files.select("path", "text", family.alias("family"), F.when(culture != "", culture).alias("culture"), F.from_xml("text", F.lit(_RESX), {"ignoreSurroundingSpaces": "false"}).alias("_x"))
    rows = parsed.select("family", "path", "culture", "text", F.posexplode("_x.data").alias("_i", "_d"))
    kind = F.when(F.col("_d._mimetype").isNotNull(), "Binary").when(F.col("_d._type").isNotNull(), "Typed").otherwise("Text")
    preserved = F.coalesce(F.coalesce(F.col("_d.`_xml:space`"), F.col("_d._space")) == "preserve", F.lit(False))
    return rows.select("family", "path", "culture", F.col("_d._name").alias("name"), F.coalesce(F.col("_d.value"), F.lit("")).alias("value"), F.col("_d.comment").alias("comment"), kind.alias("kind"), preserved.alias("preserved"), line_of(F.col("_i")).alias("line"))


def solution_projects(files: DataFrame) -> DataFrame:
    """(path, project) of solution files by their format: classic text, XML, or a JSON filter."""
    suffix = tx.extension(F.col("path"))
    classic = F.regexp_extract_all("text", F.lit(r'Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+\.[A-Za-z]+proj)"'), F.lit(1))
    in_xml = F.regexp_extract_all("text", F.lit(r'<Project\s[^>]*?Path="([^"]+)"'), F.lit(1))
    in_json = F.coalesce(F.from_json(F.get_json_object("text", "$.solution.projects"), F.lit("array<string>")), F.array().cast("array<string>"))
    found = F.when(suffix == ".sln", classic).when(suffix == ".slnx", in_xml).when(suffix == ".slnf", in_json).otherwise(F.array().cast("array<string>"))
    return files.select("path", F.explode(found).alias("project")).withColumn("project", F.replace("project", F.lit("\\"), F.lit("/")))


def project_references(files: DataFrame) -> DataFrame:
    """(path, kind, name, version): package rows and project-reference rows of project files."""
    package = F.regexp_extract_all("text", F.lit(r'(<PackageReference\s[^>]*>)'), F.lit(1))
    project = F.regexp_extract_all("text", F.lit(r'<ProjectReference\s[^>]*Include="([^"]+)"'), F.lit(1))
    packages = files.select("path", F.explode(package).alias("_t")).select("path", F.lit("package").alias("kind"), F.regexp_extract("_t", r'Include="([^"]+)"', 1).alias("name"), F.nullif(F.regexp_extract("_t", r'Version="([^"]+)"', 1), F.lit("")).alias("version"))
    return packages.unionByName(files.select("path", F.explode(project).alias("name")).select("path", F.lit("project").alias("kind"), F.replace("name", F.lit("\\"), F.lit("/")).alias("name"), F.lit(None).cast("string").alias("version")))


def audited_packages(output: DataFrame, line_col: str = "value") -> DataFrame:
    """(package,): the listed packages of a vulnerability or version report, from its output lines: those that begin with ``> ``."""
    line = tx.trim_any(F.col(line_col))
    return output.where(F.startswith(line, F.lit("> "))).select(F.substr(line, F.lit(3)).alias("package"))


def project_properties(files: DataFrame, name: str | None = None) -> DataFrame:
    """(path, name, value) of simple property elements, by name."""
    body = F.array_join(F.regexp_extract_all("text", F.lit(r"(?s)<PropertyGroup[^>]*>(.*?)</PropertyGroup>"), F.lit(1)), "\n")
    found = files.select("path", F.explode(F.regexp_extract_all(body, F.lit(r"(<\w+>[^<]*</\w+>)"), F.lit(1))).alias("_p"))
    rows = found.select("path", F.regexp_extract("_p", r"^<(\w+)>", 1).alias("name"), F.regexp_extract("_p", r">([^<]*)<", 1).alias("value"))
    if name:
        rows = rows.where(F.lower("name") == name.lower())
    return rows.orderBy("path", "name")


def test_results(spark: SparkSession, path: str) -> DataFrame:
    """(test_name, outcome, duration_ms, message, stack) of test result files, read as one row per result."""
    schema = "_testName STRING, _outcome STRING, _duration STRING, Output STRUCT<ErrorInfo: STRUCT<Message: STRING, StackTrace: STRING>>"
    rows = spark.read.format("xml").option("rowTag", "UnitTestResult").schema(schema).load(path)
    return rows.select(F.col("_testName").alias("test_name"), F.col("_outcome").alias("outcome"), tx.duration_ms(F.col("_duration")).alias("duration_ms"), F.col("Output.ErrorInfo.Message").alias("message"), F.col("Output.ErrorInfo.StackTrace").alias("stack"))


def test_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """passed, failed, skipped, total, duration_ms and ``verdict``; no tests at all is ``EMPTY``, never green."""
    def is_(*names: str) -> Column:
        return F.coalesce(F.col("outcome").isin(*names), F.lit(False))

    counted = results.groupBy(*(by or [])).agg(F.count_if(is_("Passed")).alias("passed"), F.count_if(is_("Failed")).alias("failed"), F.count_if(is_("NotExecuted", "Skipped")).alias("skipped"), F.count("*").alias("total"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"))
    return counted.withColumn("verdict", F.when(F.col("total") == 0, "EMPTY").when(F.col("failed") > 0, "FAILED").otherwise("PASSED"))
