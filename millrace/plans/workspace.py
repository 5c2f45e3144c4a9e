"""The question set of a workspace as named queries over fact tables.

A workspace is a set of frames registered together; every question is a composition of the library's operators.
What only a compiler can tell (symbols, references, diagnostics, lineage) comes in as tables.

Tables and their columns:

* files: rel_path, project, text
* symbols: id, name, kind, accessibility, container, path, start_line, end_line, project, is_test, signature, type_id
* refs: symbol_id, path, line, col, offset, confidence, kind, scope, container, is_implicit, is_generated
* project_edges: from_project, to_project; type_edges: derived, base
* diagnostics: run_id, scope, id, severity (int), path, line, message, suppressed
* registrations: file, line, method, text, container; helper_calls: file, line, method
* hunks: path, start, count; changed: path, added, deleted; statuses: path, status
* commits: seq, id, message, path, text
* entries: see ``operators.rules``; elements: file, line, type_name, key, name, path, uid, attributes (map)
* tags: name, id, date; package_report: value
* styles: file, line, key, target, based_on, scope; tracked: path
* results: project, test_name, outcome, duration_ms; parameters, routes: see ``operators.rules``
* directives, nodes, expressions, component_members: see ``operators.components``; component_files: path, component
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.errors import InvalidQuery
from millrace.functions import globs
from millrace.functions import text as tx
from millrace.operators import caps, components, diff, folds, graph, grep, joins, markdown, mentions, reading, rules, search
from millrace.sources import documents as sources
from millrace.sources import files as file_sources
from millrace.sources import markup, properties

DEFAULT_CAP = 100
#: Files of one answer of ``read_texts``.
MOST_PATHS = 10
SCOPE_RANK = ("local", "app", "theme")


class Workspace:
    """One snapshot of fact tables; ``register`` makes them SQL views, ``drop`` takes them back."""

    def __init__(self, spark: SparkSession, name: str, tables: dict[str, DataFrame]):
        self.spark, self.name, self.tables = spark, name, dict(tables)

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self.tables:
            raise InvalidQuery(f"the workspace has no table {table!r}", f"it has {', '.join(sorted(self.tables))}", "NOT_FOUND")
        return self.tables[table]

    # ------------------------------------------------------------ catalogue

    def register(self) -> Workspace:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(f"{self.name}_{name}")
        return self

    def drop(self) -> None:
        for name, df in self.tables.items():
            self.spark.catalog.dropTempView(f"{self.name}_{name}")
            df.unpersist()

    def list_tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.name.startswith(f"{self.name}_"))

    def status(self) -> DataFrame:
        """(table, rows) of all tables."""
        out = None
        for name, df in sorted(self.tables.items()):
            part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
            out = part if out is None else out.unionByName(part)
        return out

    def scanned(self) -> Workspace:
        """The workspace with the tables that its markup and component files give: elements, parsed, nodes, directives, expressions, routes, issues, component_files."""
        return Workspace(self.spark, self.name, self.tables | markup.markup_tables(self["files"]) | markup.component_tables(self["files"]))

    # ------------------------------------------------------------ projects and files

    def list_projects(self, contains: str | None = None) -> DataFrame:
        found = self["files"].groupBy("project").agg(F.count("*").alias("documents"))
        return found.where(tx.contains_ci(F.col("project"), contains)) if contains else found

    def owner_of(self, path: str) -> DataFrame:
        return self["files"].where(F.col("rel_path") == path).select("project")

    def find_files(self, glob: str | None = None, name: str | None = None, tracked: bool = False, depth: int = 0, stamps: bool = False, cap: int | None = None) -> DataFrame:
        """Paths that pass all filters; with ``depth`` rolled up by directory, with ``stamps`` each with its time in UTC and its length
        (files: also modified, length; a file without them reads MISSING), with ``cap`` the first ones and the total."""
        found = self["files"].select("rel_path", *(["modified", "length"] if stamps else []))
        if glob:
            found = found.where(globs.matches(F.col("rel_path"), glob))
        if name:
            found = found.where(tx.contains_ci(tx.file_name(F.col("rel_path")), name))
        if tracked:
            found = found.join(self["tracked"].select(F.col("path").alias("rel_path")), "rel_path", "left_semi")
        if stamps:
            stamp = F.concat(tx.utc_stamp(F.col("modified")), F.lit("  "), F.col("length").cast("string"))
            found = found.select("rel_path", F.coalesce(stamp, F.lit("MISSING")).alias("stamp"))
        elif depth:
            found = folds.rollup(found, "rel_path", depth)
        return caps.slack_cap(found, [F.col(found.columns[0])], cap) if cap else found

    def _texts(self, glob: str | None, exclude: str | None) -> DataFrame:
        found = self["files"].select("rel_path", "text")
        found = found.where(globs.matches(F.col("rel_path"), glob)) if glob else found
        return found.where(~globs.matches(F.col("rel_path"), exclude)) if exclude else found

    def search_text(self, queries: list[str], glob: str | None = None, exclude: str | None = None, context: int = 0, cap: int = DEFAULT_CAP, unique: bool = False) -> DataFrame:
        """Hits in order, capped; with ``unique``, equal ones among them folded."""
        texts = self._texts(glob, exclude)
        if context:
            hits = search.context(texts, queries if len(queries) > 1 else queries[0], context, "rel_path", "text")
        elif len(queries) > 1:
            hits = search.multi(texts, queries, "rel_path", "text")
        else:
            hits = search.literal(texts, queries[0], "rel_path", "text")
        if unique:
            return search.unique(hits, cap, "rel_path")
        return caps.slack_cap(hits, [F.col("rel_path"), F.col("line")], cap)

    def search_regex(self, query: str | list[str], glob: str | None = None, exclude: str | None = None, matches_only: bool = False, cap: int = DEFAULT_CAP, unique: bool = False, context: int = 0) -> DataFrame:
        """Matches in whole texts, across lines where the pattern allows it; of several patterns with the tags of all that a line has."""
        queries = [query] if isinstance(query, str) else query
        texts = self._texts(glob, exclude)
        if len(queries) == 1 and not context and grep.within_lines(queries[0]):
            hits = search.regex(texts, queries[0], "rel_path", "text", matches_only)
        else:
            hits = grep.grep(texts, queries, "rel_path", "text", matches_only, context)
        if unique:
            return search.unique(hits, cap, "rel_path")
        return caps.slack_cap(hits, [F.col("rel_path"), F.col("line")], cap)

    def read_text(self, path: str, start: int = 1, end: int | None = None, tail: int | None = None) -> DataFrame:
        one = self["files"].where(F.col("rel_path") == path)
        if tail:
            return search.tail(one, tail, "rel_path", "text")
        lines = search.lines(one, "rel_path", "text").where(F.col("line") >= start)
        return lines.where(F.col("line") <= end) if end else lines

    def headings(self, path: str) -> DataFrame:
        return markdown.sections(self["files"].where(F.col("rel_path") == path), "rel_path", "text")

    def read_texts(self, paths: list[str], start: int = 1, end: int | None = None, tail: int | None = None, most_lines: int = 0, most_chars: int = 0, keep_blank: bool = False) -> DataFrame:
        """(place, rel_path, status, line, text, is_cut, total_lines, next_line, bytes): up to ten files in the order asked, with one budget of characters.

        A file that is not there is ``NOT_FOUND``; one that the budget does not reach is ``CLIPPED``; both, and an empty file, have one row without a line.
        """
        if not paths or any(not p.strip() for p in paths):
            raise InvalidQuery("a path is blank", "name the files to read")
        if len(paths) > MOST_PATHS:
            raise InvalidQuery(f"{len(paths)} paths", f"name at most {MOST_PATHS}")
        asked = self.spark.createDataFrame([(i, p) for i, p in enumerate(dict.fromkeys(paths), 1)], "place int, rel_path string")
        held = self["files"].select("rel_path", "text").join(F.broadcast(asked), "rel_path")
        found = reading.windows(held, start, end, tail, most_lines, most_chars, keep_blank, "rel_path", "text", ["place"])
        sizes = held.select("place", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("_bytes"))
        rows = asked.join(sizes, "place", "left").join(found.drop("rel_path", "bytes"), "place", "left")
        # At most ten files meet here.
        ended = F.max(F.when(F.col("is_last"), F.col("place"))).over(W.partitionBy(F.lit(0)))
        status = F.when(F.col("_bytes").isNull(), "NOT_FOUND").when(F.col("line").isNull() & (F.col("place") > ended), "CLIPPED").otherwise("OK")
        return rows.select("place", "rel_path", status.alias("status"), "line", "text", "is_cut", "total_lines", "next_line", F.col("_bytes").alias("bytes"))

    def _located(self, path: str, heading: str, occurrence: int) -> DataFrame:
        """The one section that is meant; an ambiguous or unknown heading is refused with what there is."""
        title = heading.lstrip("#").strip()
        sections = self.headings(path)
        found = sections.where(F.lower("heading") == title.lower())
        if heading.startswith("#"):
            found = found.where(F.col("level") == len(heading) - len(heading.lstrip("#")))
        starts = [r["start_line"] for r in found.orderBy("start_line").select("start_line").limit(max(occurrence, 2)).collect()]
        if not starts:
            some = ", ".join(r["heading"] for r in sections.orderBy("start_line").limit(12).collect())
            raise InvalidQuery(f"no section is titled '{heading}'", f"the first ones are {some}", "NOT_FOUND")
        if not occurrence and len(starts) > 1:
            raise InvalidQuery(f"'{heading}' names several sections", "name the occurrence, from 1")
        if occurrence > len(starts):
            raise InvalidQuery(f"occurrence {occurrence} does not exist", f"there are {len(starts)}")
        return found.where(F.col("start_line") == starts[max(occurrence, 1) - 1]).select("rel_path", "start_line", "end_line")

    def read_section(self, path: str, heading: str, occurrence: int = 0) -> DataFrame:
        """The lines of a section; with leading ``#`` marks the level counts too.  Of several of one title the occurrence must be named."""
        found = self._located(path, heading, occurrence)
        return self.read_text(path).join(F.broadcast(found), "rel_path").where(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("rel_path", "line", "text")

    def read_columns(self, path: str, columns: list[str], section: str | None = None, occurrence: int = 0) -> DataFrame:
        """Columns of the markdown tables of a file, or of a section; a column that no table of the file has is refused with the headers there are."""
        one = self["files"].where(F.col("rel_path") == path)
        found = markdown.table(one, columns, "rel_path", "text")
        held = markdown.headers(one, "rel_path", "text")
        asked = [c.lower() for c in columns]
        known = {r["header"] for r in held.where(F.col("header").isin(*asked)).select("header").distinct().collect()}
        unknown = [c for c in columns if c.lower() not in known]
        if unknown:
            some = ", ".join(r["header"] for r in held.select("header").distinct().orderBy("header").limit(20).collect())
            raise InvalidQuery(f"no table has the column {', '.join(unknown)}", f"the headers are {some}", "NOT_FOUND")
        if section is None:
            return found
        within = F.broadcast(self._located(path, section, occurrence))
        return found.join(within, "rel_path").where(F.col("line").between(F.col("start_line"), F.col("end_line"))).select(*found.columns)

    # ------------------------------------------------------------ symbols

    def search_symbols(self, query: str, kind: str | None = None, scope: str | None = None, cap: int = DEFAULT_CAP) -> DataFrame:
        """Declarations whose name contains the query: distinct by id, test half withheld, ranked and capped.

        Components (``component_files``), if the workspace has them, are among them, as public ones of kind ``component``.
        """
        if not query.strip():
            raise InvalidQuery("the query is blank", "name a part of a symbol")
        symbols = self["symbols"]
        if "component_files" in self.tables:
            more = self["component_files"].where(F.col("component").isNotNull())
            more = more.select(F.concat(F.lit("component:"), "path").alias("id"), F.col("component").alias("name"), F.lit("component").alias("kind"), F.lit("public").alias("accessibility"), "path", F.lit(1).alias("start_line"), F.lit(False).alias("is_test"))
            symbols = symbols.unionByName(more, allowMissingColumns=True)
        found = symbols.where(tx.contains_ci(F.col("name"), query))
        found = found.where(F.lower("kind") == kind.lower()) if kind else found
        order = [F.col("is_test"), (F.col("accessibility") == "public").desc(), F.length("name"), F.col("id")]
        unique = caps.first_wins(found, ["id"], [F.col("path"), F.col("start_line")])
        if scope in ("test", "production"):
            unique = unique.where(F.col("is_test") if scope == "test" else ~F.col("is_test")).withColumn("withheld", F.lit(0))
        else:
            unique = caps.withhold(unique, F.col("is_test"))
        return caps.slack_cap(unique, order, cap)

    def get_file_outline(self, paths: list[str], contains: str | None = None) -> DataFrame:
        if len(paths) > 10:
            raise InvalidQuery(f"{len(paths)} paths", "name at most 10")
        found = self["symbols"].where(F.col("path").isin(*paths))
        if contains:
            found = found.withColumn("matches", tx.contains_ci(F.col("name"), contains))
            counts = found.groupBy("path", "container").agg(F.count_if("matches").alias("shown"), F.count("*").alias("members"))
            found = found.where("matches").drop("matches").join(counts, ["path", "container"])
        return found.orderBy("path", "start_line")

    def get_type_outline(self, type_name: str, contains: str | None = None) -> DataFrame:
        found = self["symbols"].where(F.col("container") == type_name)
        return (found.where(tx.contains_ci(F.col("name"), contains)) if contains else found).orderBy("start_line")

    def get_symbol(self, symbol_id: str) -> DataFrame:
        return self["symbols"].where(F.col("id") == symbol_id).select("id", "kind", "accessibility", "signature", "path", "start_line")

    def resolve(self, names: list[tuple[str, str | None]]) -> DataFrame:
        asked = self.spark.createDataFrame(names, "q string, c string")
        return joins.resolve(asked, self["symbols"].select("name", "container", "id"), "q", "c")

    def get_symbol_source(self, ids: list[str]) -> DataFrame:
        """(id, source): the lines of each declaration; an unknown id reads NOT_RESOLVED."""
        if not 1 <= len(ids) <= 20:
            raise InvalidQuery(f"{len(ids)} symbols", "name 1 to 20")
        asked = self.spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, ord int")
        held = self["symbols"].select("id", "path", "start_line", "end_line").join(self["files"].select(F.col("rel_path").alias("path"), "text"), "path")
        lines = F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
        return asked.join(held.select("id", F.array_join(tx.dedented(lines), "\n").alias("source")), "id", "left").orderBy("ord").select("id", F.coalesce("source", F.lit("NOT_RESOLVED")).alias("source"))

    def _usages(self, symbol_id: str) -> DataFrame:
        refs = self["refs"]
        if "markup_refs" in self.tables:
            refs = refs.unionByName(self["markup_refs"])
        return refs.where((F.col("symbol_id") == symbol_id) & ~F.col("is_implicit") & ~F.col("is_generated"))

    def find_usages(self, symbol_id: str, cap: int = DEFAULT_CAP, containers: bool = False) -> DataFrame:
        """Ordered by path and offset, capped, then folded by (path, confidence, kind, scope, container), with the ``total`` before the cap.

        Usages in markup (``markup_refs``: as ``refs``), if the workspace has them, are among them.
        """
        usages = self._usages(symbol_id).withColumn("path_key", F.lower("path"))
        capped = caps.slack_cap(usages, [F.col("path_key"), F.col("offset")], cap)
        keys = ["path", "confidence", "kind", "scope"] + ["container"] * containers
        position = F.concat_ws(":", F.col("line").cast("string"), F.col("col").cast("string"))
        return folds.usages(capped.withColumn("position", position), [*keys, "total"], ["offset"], "position")

    def find_registrations(self, query: str, cap: int = DEFAULT_CAP) -> DataFrame:
        """Registrations that contain the query, and those in helpers once for each call, marked with the helper (``via``)."""
        direct = self["registrations"].select("file", "line", "text", F.lit(None).cast("string").alias("via"))
        bodies = self["registrations"].select("text", F.col("container").alias("method"), F.col("container").alias("via"))
        every = joins.expand_through(direct, self["helper_calls"].select("file", "line", "method"), bodies, "method")
        return caps.slack_cap(every.where(tx.contains_ci(F.col("text"), query)), [F.col("file"), F.col("line"), F.col("text"), F.col("via")], cap)

    def list_endpoints(self, cap: int = DEFAULT_CAP) -> DataFrame:
        """Endpoint registrations and page routes, each arm capped by itself."""
        calls = self["registrations"].where(F.startswith("method", F.lit("Map"))).select(F.col("file").alias("path"), F.col("text").alias("endpoint")).orderBy("path", "endpoint").limit(cap)
        return calls.unionByName(self["routes"].select("path", F.col("route").alias("endpoint")).orderBy("path", "endpoint").limit(cap))

    def explore_symbol(self, symbol_id: str) -> DataFrame:
        tests = self["symbols"].where("is_test").select("path").distinct().withColumn("t", F.lit(True))
        usages = self._usages(symbol_id).join(tests, "path", "left")
        found = usages.agg(F.count("*").alias("usages"), F.count_if("t").alias("test_usages"), F.count_distinct("path").alias("files"))
        if "type_edges" in self.tables:
            found = found.withColumn("implementations", self.find_implementations(symbol_id).agg(F.count("*")).scalar())
        if "markup_refs" in self.tables:
            found = found.withColumn("markup", self["markup_refs"].where(F.col("symbol_id") == symbol_id).agg(F.count("*")).scalar())
        return found

    def top_files(self, symbol_id: str, n: int = 10) -> DataFrame:
        return self._usages(symbol_id).groupBy("path").agg(F.count("*").alias("usages")).orderBy(F.col("usages").desc(), "path").limit(n)

    def impact_projects(self, symbol_id: str) -> DataFrame:
        """Projects that use the symbol and all that depend on them, in order."""
        owners = self._usages(symbol_id).join(self["files"].select(F.col("rel_path").alias("path"), "project"), "path").select("project").distinct()
        reached = graph.closure(self["project_edges"], "to_project", "from_project", owners)
        return reached.select(F.col("reached").alias("project")).distinct().orderBy("project")

    def impact_tests(self, symbol_id: str, n: int = 10) -> DataFrame:
        tests = self["symbols"].where("is_test").select("path", F.col("container").alias("test_class")).distinct()
        return self._usages(symbol_id).join(tests, "path").groupBy("test_class").agg(F.count("*").alias("usages")).orderBy(F.col("usages").desc(), "test_class").limit(n)

    def find_implementations(self, type_id: str) -> DataFrame:
        seeds = self.spark.createDataFrame([(type_id,)], "t string")
        return graph.closure(self["type_edges"], "base", "derived", seeds).where("depth > 0").select(F.col("reached").alias("id"), "depth").orderBy("depth", "id")

    # ------------------------------------------------------------ findings

    def _diagnostics(self, min_severity: int, path: str | None, run: int | None) -> DataFrame:
        found = self["diagnostics"].where((F.col("severity") >= min_severity) & ~F.col("suppressed"))
        found = found.where(F.startswith("path", F.lit(path))) if path else found
        return found.where(F.col("run_id") == run) if run is not None else found

    def get_diagnostics(self, min_severity: int = 2, path: str | None = None, run: int | None = None) -> DataFrame:
        position = F.concat_ws(":", "path", F.col("line").cast("string"))
        return folds.findings(self._diagnostics(min_severity, path, run).withColumn("position", position), "id", "position", "message")

    def analyze_since_last(self, now: int, before: int | None, min_severity: int = 0) -> DataFrame:
        """Findings of a run against the run before: appeared, fixed, unchanged, or baseline."""
        def keys(run: int) -> DataFrame:
            key = F.concat("id", F.lit(" "), "path", F.lit(":"), F.col("line").cast("string"), F.lit(": "), "message")
            return folds.occurrence_names(self._diagnostics(min_severity, None, run).select(key.alias("key")), "key")

        return folds.delta(keys(now), keys(before) if before is not None else None, "occurrence")

    def analyze(self, run: int, ids: list[str] | None = None, min_severity: int = 0, changed_only: bool = False, dead_code: bool = True) -> DataFrame:
        """Findings of a run and unreferenced members in one answer: (id, path, line, message), all filtered alike.

        With ``changed_only``, those of the files in ``changed``.
        """
        found = self._diagnostics(min_severity, None, run).select("id", "path", "line", "message")
        if dead_code:
            found = found.unionByName(self.dead_code().select(F.col("rule").alias("id"), "path", F.lit(None).cast("int").alias("line"), F.concat("key", F.lit(" "), "detail").alias("message")))
        if ids:
            found = found.where(F.col("id").isin(*ids))
        return found.join(self["changed"].select("path").distinct(), "path", "left_semi").select("id", "path", "line", "message") if changed_only else found

    def project_properties(self, name: str | None = None) -> DataFrame:
        """Properties of all projects among the files, evaluated, each with the file that defines it."""
        return properties.evaluated(self["files"], name)

    def resolve_overloads(self, references: list[str]) -> DataFrame:
        """Symbols (with ``parameters``) by references such as ``Type.Run(List<int>, string)``."""
        return joins.resolve_overloads(self.spark.createDataFrame([(r,) for r in references], "q string"), self["symbols"], "q")

    def dead_code(self) -> DataFrame:
        members = self["symbols"].select("id", "path", "name", (F.col("accessibility") == "private").alias("private"))
        return rules.dead_members(members, self["refs"].select("symbol_id", "path"))

    # ------------------------------------------------------------ builds, tests, history

    def test_summary(self, by_project: bool = False) -> DataFrame:
        return sources.test_summary(self["results"], ["project"] if by_project else None)

    def slowest_tests(self, n: int) -> DataFrame:
        return self["results"].orderBy(F.col("duration_ms").desc(), "test_name").limit(n)

    def rerun_failed(self, suite: DataFrame) -> DataFrame:
        return suite.join(self["results"].where(F.col("outcome") == "Failed").select("test_name"), "test_name", "left_semi")

    def changed_tests(self, test_projects: DataFrame) -> DataFrame:
        """Test projects that depend on a project with a changed file."""
        owners = self["changed"].join(self["files"].select(F.col("rel_path").alias("path"), "project"), "path").select("project").distinct()
        reached = graph.closure(self["project_edges"], "to_project", "from_project", owners).select(F.col("reached").alias("project")).distinct()
        return reached.join(test_projects.select("project"), "project", "left_semi").orderBy("project")

    def changed_files(self, exclude: str | None = None) -> DataFrame:
        """Changed files with their status; untracked ones (``untracked``: path), if the workspace has them, folded by top directory."""
        found = file_sources.changed(self["changed"], self["statuses"])
        found = found.where(~globs.matches(F.col("path"), exclude)) if exclude else found
        if "untracked" not in self.tables:
            return found
        more = self["untracked"]
        more = more.where(~globs.matches(F.col("path"), exclude)) if exclude else more
        more = folds.untracked(more, "path").select(F.col("row").alias("path"), F.lit("??").alias("status"))
        return found.unionByName(more, allowMissingColumns=True)

    def diff_symbols(self) -> DataFrame:
        """Each hunk with the innermost declaration around it; equal hunks share their answer and all stay."""
        hunks, key = self["hunks"].select("path", "start", "count"), ["path", "start", "count"]
        asked = hunks.distinct().withColumn("end", F.col("start") + F.greatest(F.col("count"), F.lit(1)) - 1)
        asked = asked.withColumns({"hunk": F.concat_ws(":", "path", F.col("start").cast("string")), "_id": F.struct(*key)})
        spans = self["symbols"].select(F.col("path"), "start_line", "end_line", F.col("id").alias("symbol"))
        found = joins.containment(asked, spans, "path", "start", "end", "start_line", "end_line", "symbol", "_id").withColumnsRenamed({k: f"_{k}" for k in key})
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        return hunks.join(found.hint("merge"), same).select(*key, "end", "hunk", "symbol", "confidence")

    def diff_text(self, pairs: DataFrame, old: str, new: str) -> DataFrame:
        return diff.diff_texts(pairs, old, new)

    def diff_unified(self, pairs: DataFrame, old: str, new: str, lines: int = diff.MOST_LINES) -> DataFrame:
        """Bounded unified text of what changed in each pair; its other columns name it."""
        keys = [c for c in pairs.columns if c not in (old, new)]
        return diff.unified(diff.hunks_between(pairs, old, new), keys, lines)

    def commit(self, commit_id: str | Column) -> DataFrame:
        """(id, message, path, added, deleted) of one commit (commits: also added, deleted), a row for each file; the id may be a scalar query."""
        return self["commits"].where(F.col("id") == commit_id).select("id", "message", "path", "added", "deleted").orderBy("path")

    def tag_list(self, cap: int = 50) -> DataFrame:
        """Tags (name, id, date), the newest version first: names are compared number by number, then as text; one row above the cap."""
        numbers = F.transform(F.regexp_extract_all("name", F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
        return self["tags"].select("name", "id", "date").orderBy(numbers.desc(), F.col("name").desc()).limit(cap + 1)

    def package_audit(self) -> DataFrame:
        """Packages that a report on vulnerable or outdated ones lists (package_report: value)."""
        return sources.audited_packages(self["package_report"])

    def history(self, message: str | None = None, path: str | None = None, contains: str | None = None, cap: int = DEFAULT_CAP) -> DataFrame:
        """Newest first; one row above the cap tells that there are more."""
        found = self["commits"]
        found = found.where(tx.contains_ci(F.col("message"), message)) if message else found
        found = found.where(F.col("path") == path) if path else found
        if contains:
            found = joins.pickaxe(found, "path", "seq", tx.occurrences(F.coalesce("text", F.lit("")), contains))
        return found.orderBy(F.col("seq").desc()).limit(cap + 1)

    # ------------------------------------------------------------ resources

    def resx_files(self) -> DataFrame:
        """Per family and culture the number of distinct keys, and what is missing in all."""
        counts = self["entries"].groupBy("family", F.coalesce("culture", F.lit("neutral")).alias("culture")).agg(F.count_distinct("name").alias("keys"))
        per = counts.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("culture", "keys"))).alias("cultures"))
        return per.join(rules.family_missing(self["entries"]), "family")

    def resx_get(self, family: str, cultures: list[str], prefix: str | None = None) -> DataFrame:
        found = self["entries"].where(F.col("family") == family).withColumn("culture", F.coalesce("culture", F.lit("neutral")))
        found = found.where(F.startswith("name", F.lit(prefix))) if prefix else found
        return joins.matrix(found, "name", "culture", "value", cultures)

    def resx_find(self, query: str, scope: str = "all", culture: str | None = None) -> DataFrame:
        places = {"key": ["name"], "value": ["value"], "comment": ["comment"], "all": ["name", "value", "comment"]}
        if scope not in places:
            raise InvalidQuery(f"the scope {scope!r} is unknown", "use key, value, comment or all")
        hit: Column = F.lit(False)
        for c in places[scope]:
            hit = hit | F.coalesce(tx.contains_ci(F.col(c), query), F.lit(False))
        found = self["entries"].where(hit)
        return found.where(F.col("culture").eqNullSafe(F.lit(culture))) if culture else found

    def resx_usages(self, exact: DataFrame, textual: DataFrame) -> DataFrame:
        """Exact usages, and textual ones where no exact one is on the same line."""
        more = textual.join(exact.select("path", "line"), ["path", "line"], "left_anti")
        return exact.withColumn("confidence", F.lit("EXACT")).unionByName(more.withColumn("confidence", F.lit("HEURISTIC"))).orderBy("path", "line")

    def resx_key_usages(self, key: str, exact: DataFrame | None = None, cap: int = DEFAULT_CAP) -> DataFrame:
        """Usages of a resource key in order, capped: those that the files' texts hold, and exact ones (path, line, form) in their place.

        ``composed`` counts lookups put together at run time: with any of them, no usage is no proof.
        """
        texts = self["files"].where(mentions.scanned(F.col("rel_path"))).select(F.col("rel_path").alias("path"), "text")
        found = mentions.key_usages(texts, key, "path", "text").withColumn("confidence", F.lit("HEURISTIC"))
        if exact is not None:
            sure = exact.select("path", "line", "form")
            known = sure.select(F.lower("path").alias("_p"), F.col("line").alias("_l")).distinct()
            found = sure.withColumn("confidence", F.lit("EXACT")).unionByName(found.join(known, (F.lower("path") == F.col("_p")) & (F.col("line") == F.col("_l")), "left_anti"))
        return caps.slack_cap(found, [F.col("path"), F.col("line"), F.col("form")], cap).withColumn("composed", mentions.composed_lookups(texts).scalar())

    def _tokens(self) -> DataFrame:
        """What the scanned files mention, unless the workspace has a table of tokens."""
        if "tokens" in self.tables:
            return self["tokens"]
        return mentions.tokens(self["files"].where(mentions.scanned(F.col("rel_path"))))

    def resx_validate(self, selected: tuple[str, ...] = rules.DEFAULT_RESOURCE_RULES) -> DataFrame:
        """Findings of the selected rules; what is unused (RESX003) is told from the texts of the files, or a table of tokens."""
        tokens = self._tokens() if "RESX003" in selected and {"tokens", "files"} & set(self.tables) else None
        return rules.validate_resources(self["entries"], tokens, self.tables.get("designers"), selected)

    # ------------------------------------------------------------ markup

    def xaml_outline(self, file: str, depth: int, named_only: bool = False) -> DataFrame:
        found = self["elements"].where((F.col("file") == file) & (F.size(F.split("path", "/")) - 1 <= depth))
        return (found.where(F.col("name").isNotNull() | F.col("key").isNotNull()) if named_only else found).orderBy("line")

    def xaml_names(self, file: str) -> DataFrame:
        return self["elements"].where((F.col("file") == file) & (F.col("name").isNotNull() | F.col("uid").isNotNull())).orderBy("line")

    def xaml_resources(self, file: str) -> DataFrame:
        return self["elements"].where((F.col("file") == file) & F.col("key").isNotNull()).orderBy("line")

    def xaml_resolve(self, key: str) -> DataFrame:
        """Declarations of a key, the nearest scope first (``rank`` from 1)."""
        rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SCOPE_RANK]), F.col("scope")), F.lit(0))
        return self["styles"].where(F.col("key") == key).withColumn("rank", F.when(rank == 0, len(SCOPE_RANK) + 1).otherwise(rank)).orderBy("rank", "file", "line")

    def xaml_styles(self, target: str) -> DataFrame:
        """Styles of a type, the implicit one first, each with its chain of bases."""
        chains = graph.chain(self["styles"].where(F.col("key").isNotNull()), "key", "based_on").withColumnRenamed("node", "key")
        return self["styles"].where(F.col("target") == target).join(chains, "key", "left").orderBy(F.col("key").isNotNull(), "file", "line")

    def xaml_localization(self) -> DataFrame:
        return joins.prefix(self["elements"].where(F.col("uid").isNotNull()), self["entries"].select("name").distinct(), "uid", "name")

    def xaml_find(self, query: str, kind: str = "type") -> DataFrame:
        by = {"type": "type_name", "name": "name", "key": "key", "uid": "uid"}
        if kind == "binding":
            hit = F.exists(F.map_values("attributes"), lambda v: F.contains(v, F.lit("{Binding")) & F.contains(F.lower(v), F.lit(query.lower())))
        elif kind in by:
            hit = tx.contains_ci(F.col(by[kind]), query)
        else:
            raise InvalidQuery(f"the kind {kind!r} is unknown", "use type, name, key, uid or binding")
        return self["elements"].where(hit).orderBy("file", "line")

    def xaml_codebehind(self, file: str, events: list[str]) -> DataFrame:
        """Event-handler attributes of a file."""
        rows = self["elements"].where(F.col("file") == file).select("line", "type_name", F.explode("attributes").alias("event", "handler"))
        return rows.where(F.col("event").isin(*events) & tx.is_identifier(F.col("handler"))).orderBy("line", "event")

    def xaml_bindings(self, file: str, members: DataFrame | None = None, start_type: str | None = None) -> DataFrame:
        """Binding expressions; with member tables, whether each dotted path resolves, through base types and interfaces (``type_edges``) too."""
        rows = self["elements"].where(F.col("file") == file).select("file", "line", F.explode("attributes").alias("attribute", "expression")).where(F.startswith("expression", F.lit("{Binding")))
        path = F.regexp_extract("expression", r"^\{Binding\s+(?:Path=)?([A-Za-z_][\w.]*)", 1)
        rows = rows.withColumn("binding", path)
        if members is None:
            return rows.orderBy("line", "attribute")
        if "type_edges" in self.tables:
            own = members.withColumnRenamed("type", "component")
            own = own if "settable" in own.columns else own.withColumn("settable", F.lit(True))
            members = components.inherited(own, self["type_edges"]).select("type", "member", "member_type")
        return joins.member_walk(rows.where(path != "").withColumn("start", F.lit(start_type)), members, "binding", "start", None).orderBy("line", "attribute")

    def xaml_validate(self, parsed: DataFrame | None = None, references: DataFrame | None = None, mentioned: DataFrame | None = None) -> DataFrame:
        """All markup rules; what is not handed in comes from the scan of the files (``scanned``): whether they parse, the resources that
        attributes refer to, and the identifiers that texts mention outside of the declarations themselves."""
        elements = self["elements"]
        parsed = self["parsed"] if parsed is None else parsed
        references = mentions.markup_references(elements) if references is None else references
        parts = [rules.markup_unparsed(parsed), rules.markup_duplicates(elements, "key", "XAML001"), rules.markup_duplicates(elements, "name", "XAML002"), rules.markup_unresolved(references, elements, parsed)]
        for column, rule in (("key", "XAML004"), ("name", "XAML005")):
            parts.append(rules.markup_unused(elements, self._mentioned(column, references) if mentioned is None else mentioned, column, rule))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _mentioned(self, column: str, references: DataFrame) -> DataFrame:
        """Tokens that may use a declared key or name: of files that are no markup, of other attributes' values, and keys referred to."""
        code = mentions.tokens(self["files"].where(mentions.scanned(F.col("rel_path")) & ~tx.extension(F.col("rel_path")).isin(*markup.MARKUP_ENDINGS)))
        values = self["elements"].select(F.explode(F.map_values(F.map_filter("attributes", lambda k, v: ~k.isin("Key", "Name")))).alias("text"))
        tokens = code.unionByName(mentions.tokens(values)).unionByName(references.select(F.col("key").alias("token")))
        return tokens.select(F.col("token").alias(column)).distinct()

    # ------------------------------------------------------------ components

    def component(self, name: str) -> DataFrame:
        """Parameters of a component with its routes."""
        routes = self["routes"].where(F.col("component") == name).groupBy("component").agg(F.sort_array(F.collect_set("route")).alias("routes"))
        return self["parameters"].where(F.col("component") == name).join(routes, "component", "left").orderBy("parameter")

    def component_outline(self, path: str, elements: bool = False) -> DataFrame:
        of = lambda table: self[table].where(F.col("path") == path)
        return components.outline(of("directives"), of("nodes"), of("component_members"), elements).orderBy("section", "line", "text")

    def component_bindings(self, path: str, validate: bool = False) -> DataFrame:
        """Binding sites of a file; with ``validate``, whether their members are there and can be set."""
        nodes = self["nodes"].where(F.col("path") == path)
        if not validate:
            return components.binding_sites(nodes).orderBy("line", "attribute")
        lineage = self["type_edges"] if "type_edges" in self.tables else None
        return components.checked_sites(nodes, self["component_members"], self["component_files"], lineage).orderBy("line", "attribute")

    def component_codebehind(self, path: str) -> DataFrame:
        members = self["component_members"].where(F.col("path") == path)
        return components.code_behind(members, self["files"].select(F.col("rel_path").alias("path"))).orderBy("line", "member")

    def component_find(self, query: str, kind: str) -> DataFrame:
        """Hits in component files; without their facts, routes, components and attributes are found in the tables of these."""
        if "nodes" in self.tables:
            return components.find(kind, query, self["directives"], self["nodes"], self["expressions"]).orderBy("path", "line", "text")
        by = {"route": ("routes", "route"), "component": ("parameters", "component"), "attribute": ("parameters", "parameter")}
        if kind not in by:
            raise InvalidQuery(f"the kind {kind!r} needs the table of nodes", f"use {', '.join(by)}")
        table, column = by[kind]
        return self[table].where(tx.contains_ci(F.col(column), query))

    def component_validate(self, uses: DataFrame, catch_all: DataFrame, selected: tuple[str, ...] | None = None) -> DataFrame:
        """All component rules whose tables the workspace has, or the selected ones.

        Tables: parameters, routes; binds and properties (RZR004), component_refs and lineage (RZR007), stylesheets and component_files
        (RZR008), injects, registered and provided (RZR009), component_files with flags ``unavailable`` (RZR000) and ``malformed`` (RZR010).
        """
        parameters, routes = self["parameters"], self["routes"]
        has = lambda *names: all(n in self.tables for n in names)
        parts = {"RZR001": rules.unknown_components(uses, parameters), "RZR002": rules.unknown_parameters(uses, parameters, catch_all), "RZR003": rules.required_parameters(uses, parameters), "RZR005": rules.route_parameters(routes, parameters), "RZR006": rules.duplicate_routes(routes)}
        if has("binds", "properties"):
            parts["RZR004"] = rules.unsettable_binds(self["binds"], self["properties"])
        if has("component_refs", "lineage"):
            parts["RZR007"] = rules.reference_types(self["component_refs"], self["lineage"])
        if has("stylesheets", "component_files"):
            parts["RZR008"] = rules.orphan_stylesheets(self["stylesheets"], self["component_files"])
        if has("injects", "registered", "provided"):
            parts["RZR009"] = rules.unregistered_injections(self["injects"], self["registered"], self["provided"])
        if has("component_files"):
            for code, flag, detail in (("RZR000", "unavailable", "no semantics"), ("RZR010", "malformed", "markup does not parse")):
                if flag in self["component_files"].columns:
                    parts[code] = rules.flagged_files(self["component_files"], code, flag, detail)
        out = None
        for code in sorted(parts):
            if selected is None or code in selected:
                out = parts[code] if out is None else out.unionByName(parts[code])
        if out is None:
            raise InvalidQuery("no rule is selected", f"use {', '.join(sorted(parts))}")
        return out.orderBy("path", "rule", "key")
