"""The questions of ``Workspace`` over fact tables made from the driver tables, each with SQL that gives the same rows.

Facts: documents are files, parts are declarations, order lines are references, events are diagnostics, markup and components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.catalog import _NEUTRAL, _PAYLOAD, _RULE_SQL, _TRIM, _entries, register
from millrace.plans.workspace import Workspace
from millrace.sources.tables import table


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(_text("src/d", d % 10, "/f", d, ".cs").alias("rel_path"), _text("proj", d % 7).alias("project"), F.coalesce("text", F.lit("")).alias("text"))


_FILES = "files AS (SELECT 'src/d' || (doc_id % 10) || '/f' || doc_id || '.cs' AS rel_path, 'proj' || (doc_id % 7) AS project, coalesce(text, '') AS text FROM documents)"


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        _text("S", p).alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("kind"),
        F.when(p % 3 == 0, "private").otherwise("public").alias("accessibility"),
        F.col("p_brand").alias("container"),
        _text("src/d", p % 10, "/f", p % 100, ".cs").alias("path"),
        (p % 5 + 1).cast("int").alias("start_line"),
        (p % 5 + 2).cast("int").alias("end_line"),
        _text("proj", p % 7).alias("project"),
        (p % 4 == 0).alias("is_test"),
        _text("void ", F.col("p_name")).alias("signature"),
    )


_SYMBOLS = """symbols AS (SELECT 'S' || p_partkey AS id, p_name AS name, p_type AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'private' ELSE 'public' END AS accessibility, p_brand AS container, 'src/d' || (p_partkey % 10) || '/f' || (p_partkey % 100) || '.cs' AS path,
 (p_partkey % 5 + 1)::INTEGER AS start_line, (p_partkey % 5 + 2)::INTEGER AS end_line, 'proj' || (p_partkey % 7) AS project, p_partkey % 4 = 0 AS is_test, 'void ' || p_name AS signature FROM part)"""


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        _text("S", F.col("l_partkey") % 50).alias("symbol_id"),
        _text("src/d", k % 10, "/f", k % 100, ".cs").alias("path"),
        F.col("l_linenumber").cast("int").alias("line"),
        (k % 80).cast("int").alias("col"),
        (k * 10 + F.col("l_linenumber")).alias("offset"),
        F.col("l_returnflag").alias("confidence"),
        F.col("l_linestatus").alias("kind"),
        F.when(k % 5 == 0, "test").otherwise("production").alias("scope"),
        F.lit("c").alias("container"),
        (k % 11 == 0).alias("is_implicit"),
        (k % 13 == 0).alias("is_generated"),
    )


_REFS = """refs AS (SELECT 'S' || (l_partkey % 50) AS symbol_id, 'src/d' || (l_orderkey % 10) || '/f' || (l_orderkey % 100) || '.cs' AS path, l_linenumber::INTEGER AS line, (l_orderkey % 80)::INTEGER AS col, (l_orderkey * 10 + l_linenumber)::BIGINT AS "offset", l_returnflag AS confidence, l_linestatus AS kind,
 CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'production' END AS scope, l_orderkey % 11 = 0 AS is_implicit, l_orderkey % 13 = 0 AS is_generated FROM lineitem), used AS (SELECT * FROM refs WHERE symbol_id = 'S7' AND NOT is_implicit AND NOT is_generated)"""


def _workspace(spark: SparkSession, sf_dir: str, **more: DataFrame) -> Workspace:
    return Workspace(spark, "w", {"files": _files(spark, sf_dir), "symbols": _symbols(spark, sf_dir), "refs": _refs(spark, sf_dir), **more})


# ---------------------------------------------------------------- projects and files


@register(f"WITH {_FILES} SELECT project, count(*) AS documents FROM files GROUP BY project HAVING contains(lower(project), 'oj')")
def tool_list_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).list_projects("OJ")


@register(f"WITH {_FILES}, g AS (SELECT rel_path, CASE WHEN len(string_split(rel_path, '/')) > 2 THEN array_to_string(string_split(rel_path, '/')[1:2], '/') END AS p FROM files WHERE regexp_matches(rel_path, '(?i)^src/[^/]*/f[^/]*3\\.cs$') AND contains(lower(split_part(rel_path, '/', -1)), 'f1')), c AS (SELECT *, count(*) OVER (PARTITION BY p) AS n FROM g) SELECT CASE WHEN n <= 1 THEN rel_path ELSE p || '/**  x' || n || ' files' END AS \"row\", count(*) AS files FROM c GROUP BY 1")
def tool_find_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).find_files("src/*/F*3.cs", "f1", depth=2)


@register(f"""WITH {_FILES}, l AS (SELECT rel_path, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line, unnest(string_split(text, chr(10))) AS t FROM files WHERE rel_path NOT LIKE 'src/d3/%'), h AS (SELECT rel_path, line, {_TRIM.format('t')} AS x FROM l WHERE contains(t, 'ation')),
 n AS (SELECT rel_path, line, {_PAYLOAD} AS text, (count(*) OVER ())::BIGINT AS total, (row_number() OVER (ORDER BY rel_path, line))::INTEGER AS rank FROM h) SELECT * FROM n WHERE rank <= CASE WHEN total <= 66 THEN total ELSE least(total, 60) END""")
def tool_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).search_text(["ation"], exclude="src/d3/*", cap=60)


@register(f"""WITH {_FILES}, l AS (SELECT rel_path, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line, unnest(string_split(text, chr(10))) AS t FROM files WHERE rel_path LIKE 'src/d4/%'), h AS (SELECT rel_path, line, {_TRIM.format("regexp_extract(t, '[A-Z][a-z]+', 0)")} AS x FROM l WHERE regexp_matches(t, '[A-Z][a-z]+')),
 c AS (SELECT * FROM h ORDER BY rel_path, line LIMIT 80) SELECT arg_min(rel_path, (rel_path, line)) AS rel_path, arg_min(line, (rel_path, line)) AS line, {_PAYLOAD} AS text, count(*) AS n FROM c GROUP BY x""")
def tool_search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).search_regex("[A-Z][a-z]+", glob="src/d4/*", matches_only=True, cap=80, unique=True)


@register(f"WITH {_FILES}, l AS (SELECT rel_path, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line, unnest(string_split(text, chr(10))) AS text FROM files WHERE rel_path = 'src/d2/f12.cs') SELECT * FROM l WHERE line BETWEEN 1 AND 3")
def tool_read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).read_text("src/d2/f12.cs", 1, 3)


@register("""SELECT 'e' || event_id AS rel_path, CASE WHEN event_id % 9 = 0 THEN 'MISSING' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '  ' || (event_id * 3) END AS stamp, n.total, n.rank FROM events JOIN (SELECT event_id AS i, (count(*) OVER ())::BIGINT AS total, (row_number() OVER (ORDER BY 'e' || event_id))::INTEGER AS rank FROM events WHERE event_id % 3 = 0) n ON n.i = event_id WHERE rank <= 200""")
def tool_find_files_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    zone = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz"))
    files = table(spark, sf_dir, "events").where(e % 3 == 0).select(_text("e", e).alias("rel_path"), F.when(e % 9 != 0, zone.cast("timestamp")).alias("modified"), (e * 3).alias("length"))
    return Workspace(spark, "w", {"files": files}).find_files(stamps=True, cap=200)


@register("SELECT 'o' || o_orderkey AS id, o_orderstatus AS message, 'f' || l_linenumber AS path, l_quantity::BIGINT AS added, l_suppkey::BIGINT AS deleted FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def tool_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), _text("f", F.col("l_linenumber")).alias("path"), F.col("l_quantity").cast("long").alias("added"), F.col("l_suppkey").cast("long").alias("deleted"))
    commits = orders.join(lines, "o_orderkey").select(_text("o", F.col("o_orderkey")).alias("id"), F.col("o_orderstatus").alias("message"), "path", "added", "deleted")
    first = orders.agg(_text("o", F.min("o_orderkey")).alias("id")).scalar()
    return _workspace(spark, sf_dir, commits=commits).commit(first)


@register("SELECT 'v' || (p_partkey % 7) || '.' || (p_partkey % 30) || '.' || p_partkey AS name, 'S' || p_partkey AS id, p_brand AS date FROM part ORDER BY p_partkey % 7 DESC, p_partkey % 30 DESC, p_partkey DESC LIMIT 51")
def tool_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    tags = table(spark, sf_dir, "part").select(_text("v", p % 7, ".", p % 30, ".", p).alias("name"), _text("S", p).alias("id"), F.col("p_brand").alias("date"))
    return _workspace(spark, sf_dir, tags=tags).tag_list()


@register("SELECT p_name || '  ' || p_size AS package FROM part WHERE p_partkey % 3 = 0")
def tool_package_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.when(F.col("p_partkey") % 3 == 0, "   > ").when(F.col("p_partkey") % 3 == 1, "   [net] ").otherwise(">")
    report = table(spark, sf_dir, "part").select(_text(lead, F.col("p_name"), "  ", F.col("p_size"), " \t").alias("value"))
    return _workspace(spark, sf_dir, package_report=report).package_audit()


# ---------------------------------------------------------------- declarations and their uses


@register(f"""WITH {_SYMBOLS}, m AS (SELECT * FROM symbols WHERE contains(lower(name), 'ar')), c AS (SELECT count(*) FILTER (is_test) AS s, count(*) FILTER (NOT is_test) AS p FROM m), k AS (SELECT m.*, CASE WHEN s > 0 AND p > 0 THEN s ELSE 0 END AS withheld FROM m, c WHERE NOT (s > 0 AND p > 0 AND is_test)),
 n AS (SELECT *, (count(*) OVER ())::BIGINT AS total, (row_number() OVER (ORDER BY is_test, accessibility = 'public' DESC, length(name), id))::INTEGER AS rank FROM k) SELECT * FROM n WHERE rank <= CASE WHEN total <= 33 THEN total ELSE least(total, 30) END""")
def tool_search_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).search_symbols("AR", cap=30)


@register(f"WITH {_SYMBOLS}, o AS (SELECT *, contains(lower(name), 'a') AS hit FROM symbols WHERE path IN ('src/d1/f1.cs', 'src/d2/f2.cs')), c AS (SELECT path, container, count(*) FILTER (hit) AS shown, count(*) AS members FROM o GROUP BY ALL) SELECT o.* EXCLUDE (hit), c.shown, c.members FROM o JOIN c USING (path, container) WHERE hit")
def tool_get_file_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).get_file_outline(["src/d1/f1.cs", "src/d2/f2.cs"], "A")


@register(f"WITH {_SYMBOLS} SELECT * FROM symbols WHERE container = 'Brand#13'")
def tool_get_type_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).get_type_outline("Brand#13")


@register(f"WITH {_SYMBOLS} SELECT id, kind, accessibility, signature, path, start_line FROM symbols WHERE id = 'S11'")
def tool_get_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).get_symbol("S11")


@register(f"""WITH {_FILES}, {_SYMBOLS}, asked AS (SELECT unnest(['S11', 'S20', 'S9999999']) AS id), f2 AS (SELECT rel_path, [repeat(' ', (4 + (i % 2) * 2)::INTEGER) || string_split(text, chr(10))[i + 1] FOR i IN range(len(string_split(text, chr(10))))] AS l FROM files),
 h AS (SELECT s.id, list_slice(f2.l, s.start_line, s.end_line) AS l FROM symbols s JOIN f2 ON f2.rel_path = s.path), k AS (SELECT *, coalesce(list_min([length(x) - length(ltrim(x)) FOR x IN l IF regexp_matches(x, '\\S')]), 0) AS indent FROM h)
 SELECT asked.id, coalesce(array_to_string([x[indent + 1:] FOR x IN l], chr(10)), 'NOT_RESOLVED') AS source FROM asked LEFT JOIN k USING (id)""")
def tool_get_symbol_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).withColumn("text", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.repeat(F.lit(" "), (4 + i % 2 * 2).cast("int")), x)), "\n"))
    return _workspace(spark, sf_dir, files=files).get_symbol_source(["S11", "S20", "S9999999"])


@register(f"""WITH {_REFS}, n AS (SELECT *, (count(*) OVER ())::BIGINT AS total, row_number() OVER (ORDER BY lower(path), "offset") AS rn FROM used), c AS (SELECT * FROM n WHERE rn <= CASE WHEN total <= 44 THEN total ELSE least(total, 40) END)
 SELECT path, confidence, kind, scope, total, string_agg(line || ':' || col, ',' ORDER BY "offset") AS positions, count(*) AS n FROM c GROUP BY ALL""")
def tool_find_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).find_usages("S7", cap=40)


@register(f"""WITH RECURSIVE {_SYMBOLS}, {_REFS}, t AS (SELECT DISTINCT path FROM symbols WHERE is_test), m AS (SELECT 'm' || l_orderkey || '.xaml' AS path FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 50 = 7), u AS (SELECT path FROM used UNION ALL SELECT path FROM m),
 e AS (SELECT 'S' || c_custkey AS d, 'S' || (c_custkey // 3) AS b FROM customer), r AS (SELECT 'S7' AS id, 0 AS depth UNION SELECT e.d, r.depth + 1 FROM r JOIN e ON r.id = e.b WHERE e.d <> e.b)
 SELECT count(*) AS usages, count(*) FILTER (path IN (SELECT path FROM t)) AS test_usages, count(DISTINCT path) AS files, (SELECT count(DISTINCT id) FROM r WHERE depth > 0) AS implementations, (SELECT count(*) FROM m) AS markup FROM u""")
def tool_explore_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    edges = table(spark, sf_dir, "customer").select(_text("S", c).alias("derived"), _text("S", F.floor(c / 3)).alias("base")).where("derived <> base")
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    no = F.lit(False)
    markup = lines.select(_text("S", F.col("l_partkey") % 50).alias("symbol_id"), _text("m", F.col("l_orderkey"), ".xaml").alias("path"), F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit(0).cast("long").alias("offset"), F.lit("EXACT").alias("confidence"), F.lit("x").alias("kind"), F.lit("production").alias("scope"), F.lit("c").alias("container"), no.alias("is_implicit"), no.alias("is_generated"))
    return _workspace(spark, sf_dir, type_edges=edges, markup_refs=markup).explore_symbol("S7")


@register(f"WITH {_REFS} SELECT path, count(*) AS usages FROM used GROUP BY path ORDER BY usages DESC, path LIMIT 10")
def tool_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).top_files("S7")


@register(f"""WITH RECURSIVE {_FILES}, {_REFS}, e AS (SELECT DISTINCT 'proj' || (n_nationkey % 12) AS f, 'proj' || (n_nationkey % 7) AS t FROM nation), o AS (SELECT DISTINCT project AS p FROM used JOIN files ON files.rel_path = used.path), r AS (SELECT p FROM o UNION SELECT e.f FROM r JOIN e ON r.p = e.t) SELECT DISTINCT p AS project FROM r""")
def tool_impact_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    edges = table(spark, sf_dir, "nation").select(_text("proj", k % 12).alias("from_project"), _text("proj", k % 7).alias("to_project"))
    return _workspace(spark, sf_dir, project_edges=edges).impact_projects("S7")


@register(f"WITH {_SYMBOLS}, {_REFS}, t AS (SELECT DISTINCT path, container AS test_class FROM symbols WHERE is_test) SELECT test_class, count(*) AS usages FROM used JOIN t USING (path) GROUP BY test_class ORDER BY usages DESC, test_class LIMIT 10")
def tool_impact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).impact_tests("S7")


@register("""WITH RECURSIVE e AS (SELECT 't' || c_custkey AS d, 't' || (c_custkey // 3) AS b FROM customer WHERE c_custkey > 0), r AS (SELECT 't1' AS id, 0 AS depth UNION SELECT e.d, r.depth + 1 FROM r JOIN e ON r.id = e.b) SELECT id, min(depth)::INTEGER AS depth FROM r WHERE depth > 0 GROUP BY id""")
def tool_find_implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    edges = table(spark, sf_dir, "customer").where(k > 0).select(_text("t", k).alias("derived"), _text("t", F.floor(k / 3)).alias("base"))
    return _workspace(spark, sf_dir, type_edges=edges).find_implementations("t1")


_REGISTRATIONS = """reg AS (SELECT 'f' || (s_suppkey % 20) AS file, s_suppkey::INTEGER AS line, CASE WHEN s_suppkey % 2 = 0 THEN 'MapGet' ELSE 'Add' END AS method, 'Use' || s_name AS text, 'h' || (s_suppkey % 6) AS container FROM supplier)"""


def _registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(_text("f", k % 20).alias("file"), k.cast("int").alias("line"), F.when(k % 2 == 0, "MapGet").otherwise("Add").alias("method"), _text("Use", F.col("s_name")).alias("text"), _text("h", k % 6).alias("container"))


@register(f"""WITH {_REGISTRATIONS}, calls AS (SELECT 'n' || n_nationkey AS file, n_nationkey::INTEGER AS line, 'h' || n_regionkey AS method FROM nation), every AS (SELECT file, line, text, NULL AS via FROM reg UNION ALL SELECT calls.file, calls.line, reg.text, calls.method FROM calls JOIN reg ON reg.container = calls.method),
 h AS (SELECT *, (count(*) OVER ())::BIGINT AS total, (row_number() OVER (ORDER BY file, line, text, via))::INTEGER AS rank FROM every WHERE contains(lower(text), '0001')) SELECT * FROM h WHERE rank <= CASE WHEN total <= 110 THEN total ELSE least(total, 100) END""")
def tool_find_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "nation").select(_text("n", F.col("n_nationkey")).alias("file"), F.col("n_nationkey").cast("int").alias("line"), _text("h", F.col("n_regionkey")).alias("method"))
    return _workspace(spark, sf_dir, registrations=_registrations(spark, sf_dir), helper_calls=calls).find_registrations("0001")


@register(f"WITH {_REGISTRATIONS} SELECT * FROM (SELECT file AS path, text AS endpoint FROM reg WHERE method = 'MapGet' ORDER BY path, endpoint LIMIT 20) UNION ALL SELECT * FROM (SELECT n_name AS path, '/r/' || n_regionkey AS endpoint FROM nation ORDER BY path, endpoint LIMIT 20)")
def tool_list_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), _text("/r/", F.col("n_regionkey")).alias("route"))
    return _workspace(spark, sf_dir, registrations=_registrations(spark, sf_dir), routes=routes).list_endpoints(20)


# ---------------------------------------------------------------- findings, changes

_DIAGNOSTICS = """diag AS (SELECT (event_id % 2)::INTEGER AS run_id, 'E' || (user_id % 5) AS id, (user_id % 4)::INTEGER AS severity, 'src/d' || (user_id % 3) AS path, (event_id % 30)::INTEGER AS line, event_type AS message, user_id % 7 = 0 AS suppressed FROM events)"""


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select((e % 2).cast("int").alias("run_id"), _text("E", u % 5).alias("id"), (u % 4).cast("int").alias("severity"), _text("src/d", u % 3).alias("path"), (e % 30).cast("int").alias("line"), F.col("event_type").alias("message"), (u % 7 == 0).alias("suppressed"))


@register(f"""WITH {_DIAGNOSTICS}, c AS (SELECT id, message, path || ':' || line AS pos, count(*) AS n FROM diag WHERE severity >= 2 AND NOT suppressed AND starts_with(path, 'src/d1') AND run_id = 1 GROUP BY ALL), g AS (SELECT id, message, list_sort(list(CASE WHEN n = 1 THEN pos ELSE pos || ' x' || n END)) AS labels, sum(n)::BIGINT AS n FROM c GROUP BY ALL)
 SELECT id AS head, message, array_to_string(labels[1:20], ', ') || CASE WHEN len(labels) > 20 THEN ', +' || (len(labels) - 20) || ' more' ELSE '' END AS positions, n FROM g""")
def tool_get_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir, diagnostics=_diagnostics(spark, sf_dir)).get_diagnostics(2, "src/d1", 1)


@register(f"""WITH {_DIAGNOSTICS}, k AS (SELECT run_id, id || ' ' || path || ':' || line || ': ' || message AS key FROM diag WHERE NOT suppressed), n AS (SELECT run_id, key, row_number() OVER (PARTITION BY run_id, key) AS nth FROM k), o AS (SELECT run_id, CASE WHEN nth = 1 THEN key ELSE key || '  [' || nth || ']' END AS occurrence FROM n),
 a AS (SELECT occurrence FROM o WHERE run_id = 1), b AS (SELECT occurrence FROM o WHERE run_id = 0) SELECT coalesce(a.occurrence, b.occurrence) AS occurrence, CASE WHEN b.occurrence IS NULL THEN 'appeared' WHEN a.occurrence IS NULL THEN 'fixed' ELSE 'unchanged' END AS state FROM a FULL JOIN b ON a.occurrence = b.occurrence""")
def tool_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir, diagnostics=_diagnostics(spark, sf_dir)).analyze_since_last(1, 0)


@register(f"WITH {_SYMBOLS}, {_REFS} SELECT 'DEAD001' AS rule, path, name AS key, 'never referenced' AS detail FROM symbols s WHERE accessibility = 'private' AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.symbol_id = s.id AND r.path = s.path)")
def tool_dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).dead_code()


@register("""WITH c AS (SELECT 'c/' || (o_orderkey % 20) || '/' || o_orderkey AS path, (o_custkey % 9)::BIGINT AS added, (o_orderkey % 5)::BIGINT AS deleted, coalesce(CASE WHEN o_orderpriority < '3' THEN o_orderstatus END, 'M') AS status FROM orders), u AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'u' || s_suppkey ELSE 't' || (s_suppkey % 3) || '/' || s_suppkey END AS path FROM supplier),
 g AS (SELECT path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) END AS top FROM u), n AS (SELECT *, count(*) OVER (PARTITION BY top) AS n FROM g) SELECT path, added::VARCHAR AS added, deleted::VARCHAR AS deleted, status FROM c WHERE path NOT LIKE 'c/3/%' UNION ALL SELECT DISTINCT CASE WHEN top IS NULL OR n <= 5 THEN path ELSE top || '/**  x' || n || ' untracked' END, NULL, NULL, '??' FROM n""")
def tool_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = F.col("o_orderkey"), F.col("s_suppkey")
    orders = table(spark, sf_dir, "orders").withColumn("path", _text("c/", o % 20, "/", o))
    changed = orders.select("path", (F.col("o_custkey") % 9).alias("added"), (o % 5).alias("deleted"))
    statuses = orders.where(F.col("o_orderpriority") < "3").select("path", F.col("o_orderstatus").alias("status"))
    untracked = table(spark, sf_dir, "supplier").select(F.when(k % 4 == 0, _text("u", k)).otherwise(_text("t", k % 3, "/", k)).alias("path"))
    return _workspace(spark, sf_dir, changed=changed, statuses=statuses, untracked=untracked).changed_files("c/3/*").withColumns({c: F.col(c).cast("string") for c in ("added", "deleted")})


@register(f"""WITH {_SYMBOLS}, h AS (SELECT 'src/d' || (c_custkey % 10) || '/f' || (c_custkey % 100) || '.cs' AS path, (c_custkey % 7 + 1)::INTEGER AS start, (c_custkey % 3)::INTEGER AS count FROM customer), d AS (SELECT *, start + greatest(count, 1) - 1 AS "end", path || ':' || start AS hunk, row_number() OVER () AS id FROM h),
 m AS (SELECT d.*, s.id AS symbol, row_number() OVER (PARTITION BY d.id ORDER BY s.end_line - s.start_line NULLS LAST, s.id) AS rn FROM d LEFT JOIN symbols s ON s.path = d.path AND s.start_line <= d.start AND s.end_line >= d."end") SELECT path, start, count, "end", hunk, symbol, CASE WHEN symbol IS NULL THEN 'HEURISTIC' ELSE 'EXACT' END AS confidence FROM m WHERE rn = 1""")
def tool_diff_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    hunks = table(spark, sf_dir, "customer").select(_text("src/d", c % 10, "/f", c % 100, ".cs").alias("path"), (c % 7 + 1).cast("int").alias("start"), (c % 3).cast("int").alias("count"))
    return _workspace(spark, sf_dir, hunks=hunks).diff_symbols()


@register("""WITH c AS (SELECT conv_id * 100 + turn AS seq, 'c' || conv_id AS path, role AS message, text FROM conversations), o AS (SELECT *, ((length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'tion', ''))) // 4)::INTEGER AS occurrences FROM c WHERE contains(message, 'user')), l AS (SELECT *, lag(occurrences, 1, 0) OVER (PARTITION BY path ORDER BY seq) AS was FROM o)
 SELECT seq, path, message, text, occurrences, was FROM l WHERE occurrences <> was ORDER BY seq DESC LIMIT 31""")
def tool_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), _text("c", F.col("conv_id")).alias("path"), F.col("role").alias("message"), "text")
    return _workspace(spark, sf_dir, commits=commits).history(message="USER", contains="tion", cap=30)


@register("""WITH RECURSIVE e AS (SELECT DISTINCT 'proj' || (n_nationkey % 12) AS f, 'proj' || (n_nationkey % 7) AS t FROM nation), c AS (SELECT DISTINCT 'proj' || (doc_id % 7) AS p FROM documents WHERE doc_id = 12), r AS (SELECT p FROM c UNION SELECT e.f FROM r JOIN e ON r.p = e.t) SELECT DISTINCT p AS project FROM r WHERE p IN ('proj3', 'proj5', 'proj8', 'proj10')""")
def tool_changed_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    edges = table(spark, sf_dir, "nation").select(_text("proj", k % 12).alias("from_project"), _text("proj", k % 7).alias("to_project"))
    changed = spark.createDataFrame([("src/d2/f12.cs",)], "path string")
    tests = spark.createDataFrame([("proj3",), ("proj5",), ("proj8",), ("proj10",)], "project string")
    return _workspace(spark, sf_dir, project_edges=edges, changed=changed).changed_tests(tests)


# ---------------------------------------------------------------- resources


def _resources(spark: SparkSession, sf_dir: str) -> Workspace:
    entries = _entries(spark, sf_dir).withColumn("comment", F.when(F.col("line") % 3 == 0, _text("note ", F.col("line") % 100)))
    return _workspace(spark, sf_dir, entries=entries)


@register(_RULE_SQL + f"{_NEUTRAL}, c AS (SELECT family, coalesce(culture, 'neutral') AS culture, count(DISTINCT name) AS keys FROM e GROUP BY ALL), f AS (SELECT DISTINCT family, path, culture FROM e WHERE culture IS NOT NULL), m AS (SELECT n.family FROM n JOIN f USING (family) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.kind = 'Text' AND e.culture IS NOT NULL AND e.path = f.path AND e.name = n.name)) SELECT family, string_agg(culture || '=' || keys, ',' ORDER BY culture) AS cultures, (SELECT count(*) FROM m WHERE m.family = c.family) AS missing FROM c GROUP BY family")
def tool_resx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _resources(spark, sf_dir).resx_files()
    return found.withColumn("cultures", F.array_join(F.transform("cultures", lambda c: F.concat(c["culture"], F.lit("="), c["keys"].cast("string"))), ","))


@register(_RULE_SQL + "g AS (SELECT name, coalesce(culture, 'neutral') AS c, min(value) AS v FROM e WHERE family = 'f4' AND starts_with(name, 'k1') GROUP BY ALL) SELECT name, coalesce(max(v) FILTER (c = 'neutral'), 'MISSING') AS neutral, coalesce(max(v) FILTER (c = 'de'), 'MISSING') AS de FROM g GROUP BY name")
def tool_resx_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resources(spark, sf_dir).resx_get("f4", ["neutral", "de"], "k1")


@register(_RULE_SQL + "c AS (SELECT *, CASE WHEN line % 3 = 0 THEN 'note ' || (line % 100) END AS comment FROM e) SELECT * FROM c WHERE contains(lower(name), 'e 4') OR contains(lower(value), 'e 4') OR contains(lower(coalesce(comment, '')), 'e 4')")
def tool_resx_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resources(spark, sf_dir).resx_find("E 4")


@register("WITH x AS (SELECT 'p' || (user_id % 50) AS path, (event_id % 40)::INTEGER AS line FROM events WHERE event_type = 'click'), t AS (SELECT 'p' || (user_id % 50) AS path, (event_id % 60)::INTEGER AS line FROM events WHERE event_type = 'view') SELECT *, 'EXACT' AS confidence FROM x UNION ALL SELECT *, 'HEURISTIC' FROM t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.path = t.path AND x.line = t.line)")
def tool_resx_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda kind, n: table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(_text("p", F.col("user_id") % 50).alias("path"), (F.col("event_id") % n).cast("int").alias("line"))
    return _resources(spark, sf_dir).resx_usages(found("click", 40), found("view", 60))


@register(_RULE_SQL + "n AS (SELECT DISTINCT family, name FROM e WHERE culture IS NULL), g AS (SELECT path, name, list_sort(list(line)) AS lines FROM e GROUP BY ALL) SELECT 'RESX005' AS rule, path, name AS key, 'has no neutral counterpart' AS detail FROM e WHERE kind = 'Text' AND culture IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.family = e.family AND n.name = e.name) UNION ALL SELECT 'RESX004', path, name, 'repeated: ' || array_to_string(lines, ', ') FROM g WHERE len(lines) > 1")
def tool_resx_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resources(spark, sf_dir).resx_validate(("RESX004", "RESX005"))


# ---------------------------------------------------------------- markup

_MARKUP = """el AS (SELECT 'v' || (user_id % 5) AS file, event_id::INTEGER AS line, CASE user_id % 3 WHEN 0 THEN 'Button' WHEN 1 THEN 'Grid' ELSE 'TextBox' END AS type_name, CASE WHEN event_id % 4 = 0 THEN 'k' || (event_id % 50) END AS key, CASE WHEN event_id % 3 = 0 THEN 'n' || (event_id % 40) END AS name,
 repeat('Grid/', (event_id % 4)::INTEGER) || 'Leaf' AS path, CASE WHEN event_id % 5 = 0 THEN 'u' || (event_id % 30) END AS uid, CASE WHEN event_id % 2 = 0 THEN 'On' || event_type ELSE '{Binding Path=Item.' || event_type || '}' END AS value FROM events)"""


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    value = F.when(e % 2 == 0, _text("On", F.col("event_type"))).otherwise(_text("{Binding Path=Item.", F.col("event_type"), "}"))
    return table(spark, sf_dir, "events").select(
        _text("v", u % 5).alias("file"),
        e.cast("int").alias("line"),
        F.when(u % 3 == 0, "Button").when(u % 3 == 1, "Grid").otherwise("TextBox").alias("type_name"),
        F.when(e % 4 == 0, _text("k", e % 50)).alias("key"),
        F.when(e % 3 == 0, _text("n", e % 40)).alias("name"),
        F.concat(F.repeat(F.lit("Grid/"), (e % 4).cast("int")), F.lit("Leaf")).alias("path"),
        F.when(e % 5 == 0, _text("u", e % 30)).alias("uid"),
        F.create_map(F.lit("Click"), value).alias("attributes"),
    )


def _flat(found: DataFrame) -> DataFrame:
    return found.withColumn("value", F.element_at("attributes", "Click")).drop("attributes")


@register(f"WITH {_MARKUP} SELECT * FROM el WHERE file = 'v1' AND len(string_split(path, '/')) - 1 <= 2 AND (name IS NOT NULL OR key IS NOT NULL)")
def tool_markup_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_workspace(spark, sf_dir, elements=_elements(spark, sf_dir)).xaml_outline("v1", 2, True))


@register(f"WITH {_MARKUP} SELECT * FROM el WHERE file = 'v2' AND (name IS NOT NULL OR uid IS NOT NULL)")
def tool_markup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_workspace(spark, sf_dir, elements=_elements(spark, sf_dir)).xaml_names("v2"))


@register(f"WITH {_MARKUP} SELECT * FROM el WHERE file = 'v2' AND key IS NOT NULL")
def tool_markup_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_workspace(spark, sf_dir, elements=_elements(spark, sf_dir)).xaml_resources("v2"))


@register(f"WITH {_MARKUP} SELECT * FROM el WHERE contains(value, '{{Binding') AND contains(lower(value), 'click')")
def tool_markup_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_workspace(spark, sf_dir, elements=_elements(spark, sf_dir)).xaml_find("CLICK", "binding"))


@register(f"WITH {_MARKUP} SELECT line, type_name, 'Click' AS event, value AS handler FROM el WHERE file = 'v3' AND NOT contains(value, '{{')")
def tool_markup_codebehind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir, elements=_elements(spark, sf_dir)).xaml_codebehind("v3", ["Click", "Loaded"])


@register(f"""WITH {_MARKUP}, m AS (SELECT 'VM' AS t, 'Item' AS member, 'T' AS r UNION SELECT DISTINCT 'T', event_type, 'S' FROM events WHERE ascii(event_type) % 2 = 0), b AS (SELECT file, line, 'Click' AS attribute, value AS expression, regexp_extract(value, 'Path=([A-Za-z_.]+)', 1) AS binding FROM el WHERE file = 'v4' AND starts_with(value, '{{Binding')),
 w AS (SELECT b.*, x.member AS one, y.member AS two FROM b LEFT JOIN m x ON x.t = 'VM' AND x.member = split_part(binding, '.', 1) LEFT JOIN m y ON y.t = x.r AND y.member = split_part(binding, '.', 2))
 SELECT file, line, attribute, expression, binding, 'VM' AS start, one IS NOT NULL AND two IS NOT NULL AS resolved, CASE WHEN one IS NULL THEN split_part(binding, '.', 1) WHEN two IS NULL THEN split_part(binding, '.', 2) END AS broken FROM w""")
def tool_markup_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = spark.createDataFrame([("VM", "Item", "T")], "type string, member string, member_type string")
    kinds = table(spark, sf_dir, "events").select(F.lit("T").alias("type"), F.col("event_type").alias("member"), F.lit("S").alias("member_type")).where(F.ascii("member") % 2 == 0).distinct()
    return _workspace(spark, sf_dir, elements=_elements(spark, sf_dir)).xaml_bindings("v4", members.unionByName(kinds), "VM")


_STYLES = "st AS (SELECT 's' || (p_partkey % 9) AS file, p_partkey::INTEGER AS line, CASE WHEN p_partkey % 6 <> 0 THEN 'K' || (p_partkey % 25) END AS key, p_brand AS target, CASE p_size % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'app' WHEN 2 THEN 'theme' ELSE 'other' END AS scope FROM part)"


@register(f"WITH {_STYLES} SELECT *, CASE scope WHEN 'local' THEN 1 WHEN 'app' THEN 2 WHEN 'theme' THEN 3 ELSE 4 END::INTEGER AS rank FROM st WHERE key = 'K7'")
def tool_markup_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, z = F.col("p_partkey"), F.col("p_size") % 4
    styles = table(spark, sf_dir, "part").select(_text("s", p % 9).alias("file"), p.cast("int").alias("line"), F.when(p % 6 != 0, _text("K", p % 25)).alias("key"), F.col("p_brand").alias("target"), F.when(z == 0, "local").when(z == 1, "app").when(z == 2, "theme").otherwise("other").alias("scope"))
    return _workspace(spark, sf_dir, styles=styles).xaml_resolve("K7")


@register("""WITH RECURSIVE st AS (SELECT 's' || (p_partkey % 9) AS file, p_partkey::INTEGER AS line, CASE WHEN p_partkey % 6 <> 0 THEN 'K' || p_partkey END AS key, p_brand AS target, 'K' || (p_partkey // 2) AS based_on FROM part),
 w AS (SELECT key AS node, [key] AS chain, key AS at, 0 AS hop FROM st WHERE key IS NOT NULL UNION ALL SELECT w.node, list_append(w.chain, s.based_on), s.based_on, hop + 1 FROM w JOIN st s ON s.key = w.at JOIN st k ON k.key = s.based_on WHERE NOT list_contains(w.chain, s.based_on) AND hop < 16), c AS (SELECT node, arg_max(chain, hop) AS chain FROM w GROUP BY node)
 SELECT st.*, array_to_string(chain, '>') AS chain FROM st LEFT JOIN c ON c.node = st.key WHERE target = 'Brand#13'""")
def tool_markup_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    styles = table(spark, sf_dir, "part").select(_text("s", p % 9).alias("file"), p.cast("int").alias("line"), F.when(p % 6 != 0, _text("K", p)).alias("key"), F.col("p_brand").alias("target"), _text("K", F.floor(p / 2)).alias("based_on"))
    return _workspace(spark, sf_dir, styles=styles).xaml_styles("Brand#13").withColumn("chain", F.array_join("chain", ">"))


@register(f"""WITH {_MARKUP}, s AS (SELECT DISTINCT uid FROM el WHERE uid IS NOT NULL), n AS (SELECT DISTINCT 'u' || (p_partkey % 40) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || p_brand END AS name FROM part)
 SELECT uid, count(name) AS n, coalesce(array_to_string(list_sort(list(name) FILTER (name IS NOT NULL))[1:4], ','), '') AS names FROM s LEFT JOIN n ON name = uid OR starts_with(name, uid || '.') GROUP BY uid""")
def tool_markup_localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    entries = table(spark, sf_dir, "part").select(_text("u", p % 40, F.when(p % 3 == 0, "").otherwise(_text(".", F.col("p_brand")))).alias("name"))
    return _workspace(spark, sf_dir, elements=_elements(spark, sf_dir), entries=entries).xaml_localization()


@register(f"""WITH {_MARKUP}, k AS (SELECT file, line, key, row_number() OVER (PARTITION BY file, key ORDER BY line) AS nth FROM el WHERE key IS NOT NULL), m AS (SELECT file, line, name, row_number() OVER (PARTITION BY file, name ORDER BY line) AS nth FROM el WHERE name IS NOT NULL)
 SELECT 'XAML000' AS rule, 'v9' AS path, '-' AS key, 'the file does not parse' AS detail WHERE (SELECT count(*) FROM region) > 0 UNION ALL SELECT 'XAML001', file, key, 'again at line ' || line FROM k WHERE nth > 1 UNION ALL SELECT 'XAML002', file, name, 'again at line ' || line FROM m WHERE nth > 1
 UNION ALL SELECT 'XAML004', file, key, 'line ' || line FROM k WHERE key NOT IN (SELECT 'k' || (n_nationkey * 2) FROM nation WHERE n_nationkey < 20) UNION ALL SELECT 'XAML005', file, name, 'line ' || line FROM m WHERE true""")
def tool_markup_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "region").limit(1).select(F.lit("v9").alias("file"), F.lit(False).alias("parsed"))
    references = _elements(spark, sf_dir).select("file", "line", F.lit("gone").alias("key"))
    mentions = table(spark, sf_dir, "nation").where(F.col("n_nationkey") < 20).select(_text("k", F.col("n_nationkey") * 2).alias("token"))
    return _workspace(spark, sf_dir, elements=_elements(spark, sf_dir)).xaml_validate(parsed, references, mentions)


# ---------------------------------------------------------------- components

_NODES = """nd AS (SELECT 'c' || (user_id % 6) || '.razor' AS path, event_id::INTEGER AS line, CASE WHEN event_id % 3 = 0 THEN 'Card' ELSE 'div' END AS tag, repeat('div/', (event_id % 3)::INTEGER) || CASE WHEN event_id % 3 = 0 THEN 'Card' ELSE 'div' END AS node_path, event_id % 3 = 0 AS is_component,
 CASE event_id % 5 WHEN 0 THEN '@bind-Value' WHEN 1 THEN '@onclick' WHEN 2 THEN 'class' WHEN 3 THEN '@ref' ELSE 'asp-for' END AS name, CASE event_id % 4 WHEN 0 THEN ' Model.Title ' WHEN 1 THEN '() => Go()' WHEN 2 THEN 'Model.Find(1).Size' ELSE 'Lost.' || event_type END AS expression FROM events)"""


def _components(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    e, u = F.col("event_id"), F.col("user_id")
    tag = F.when(e % 3 == 0, "Card").otherwise("div")
    name = F.when(e % 5 == 0, "@bind-Value").when(e % 5 == 1, "@onclick").when(e % 5 == 2, "class").when(e % 5 == 3, "@ref").otherwise("asp-for")
    expression = F.when(e % 4 == 0, " Model.Title ").when(e % 4 == 1, "() => Go()").when(e % 4 == 2, "Model.Find(1).Size").otherwise(_text("Lost.", F.col("event_type")))
    nodes = table(spark, sf_dir, "events").select(_text("c", u % 6, ".razor").alias("path"), e.cast("int").alias("line"), tag.alias("tag"), F.concat(F.repeat(F.lit("div/"), (e % 3).cast("int")), tag).alias("node_path"), (e % 3 == 0).alias("is_component"), F.array(F.struct(name.alias("name"), expression.alias("expression"))).alias("attributes"))
    n = F.col("n_nationkey")
    directives = table(spark, sf_dir, "nation").select(_text("c", n % 6, ".razor").alias("path"), n.cast("int").alias("line"), F.when(n % 2 == 0, "page").otherwise("using").alias("name"), F.col("n_name").alias("value"))
    members = spark.createDataFrame([("Base", "Model", "M", True, "b.cs", 3), ("C1", "Own", "S", True, "c1.razor", 9), ("C1", "Hidden", "S", True, "c1.razor", 0), ("M", "Title", "S", False, "m.cs", 1), ("M", "Find", "F", True, "m.cs", 2), ("F", "Size", "I", True, "f.cs", 1)], "component string, member string, member_type string, settable boolean, path string, line int")
    lineage = spark.createDataFrame([("C1", "Base")], "derived string, base string")
    held = spark.createDataFrame([("c1.razor", "C1"), ("c2.razor", None)], "path string, component string")
    text = table(spark, sf_dir, "documents").select(_text("c", F.col("doc_id") % 6, ".razor").alias("path"), F.col("doc_id").cast("int").alias("line"), F.col("source").alias("text"))
    return {"nodes": nodes, "directives": directives, "expressions": text, "component_members": members, "component_files": held, "type_edges": lineage}


@register(f"""WITH {_NODES} SELECT 'c1.razor' AS path, 1 AS section, n_nationkey::INTEGER AS line, '@' || CASE WHEN n_nationkey % 2 = 0 THEN 'page' ELSE 'using' END || ' ' || n_name AS text FROM nation WHERE n_nationkey % 6 = 1
 UNION ALL SELECT path, 2, line, repeat('  ', len(string_split(node_path, '/')) - 1) || tag FROM nd WHERE path = 'c1.razor' AND (is_component OR name <> 'class') UNION ALL SELECT 'c1.razor', 3, 9, 'Own'""")
def tool_component_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir, **_components(spark, sf_dir)).component_outline("c1.razor")


_SITES = "si AS (SELECT path, line, tag, name AS attribute, trim(expression) AS expression, CASE name WHEN '@bind-Value' THEN 'bind' WHEN '@onclick' THEN 'event' WHEN '@ref' THEN 'ref' WHEN 'asp-for' THEN 'model' END AS kind FROM nd WHERE name <> 'class')"


@register(f"WITH {_NODES}, {_SITES} SELECT * FROM si WHERE path = 'c3.razor'")
def tool_component_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir, **_components(spark, sf_dir)).component_bindings("c3.razor")


@register(f"""WITH {_NODES}, {_SITES}, m AS (SELECT * FROM (VALUES ('C1', 'Model', 'M', true), ('C1', 'Own', 'S', true), ('C1', 'Hidden', 'S', true), ('M', 'Title', 'S', false), ('M', 'Find', 'F', true), ('F', 'Size', 'I', true)) v(t, member, r, settable)),
 p AS (SELECT *, [x FOR x IN [trim(regexp_replace(y, '\\(.*', '')) FOR y IN string_split(expression, '.')] IF x <> ''] AS s FROM si WHERE path = 'c1.razor'),
 w AS (SELECT p.*, len(s) AS n, a.member AS a, b.member AS b, c.member AS c, CASE len(s) WHEN 1 THEN a.settable WHEN 2 THEN b.settable ELSE c.settable END AS settable FROM p LEFT JOIN m a ON a.t = 'C1' AND a.member = s[1] LEFT JOIN m b ON b.t = a.r AND b.member = s[2] LEFT JOIN m c ON c.t = b.r AND c.member = s[3])
 SELECT path, line, tag, attribute, expression, kind, CASE WHEN contains(expression, '=>') THEN 'INLINE' WHEN a IS NULL OR (n > 1 AND b IS NULL) OR (n > 2 AND c IS NULL) THEN 'UNRESOLVED' WHEN kind = 'bind' AND NOT settable THEN 'NO_SETTER' ELSE 'OK' END AS verdict FROM w""")
def tool_component_bindings_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir, **_components(spark, sf_dir)).component_bindings("c1.razor", validate=True)


@register("""WITH f AS (SELECT 'c' || (doc_id % 50) || '.razor' || CASE doc_id % 4 WHEN 0 THEN '.cs' WHEN 1 THEN '.css' WHEN 2 THEN '.js' ELSE '' END AS file FROM documents), m AS (SELECT 'c' || (p_partkey % 60) || '.razor' AS path, p_partkey::INTEGER AS line, p_name AS member FROM part)
 SELECT path, line, member, (SELECT min(file) FROM f WHERE file = path || '.cs') AS code_behind, (SELECT min(file) FROM f WHERE file = path || '.css') AS style, (SELECT min(file) FROM f WHERE file = path || '.js') AS script FROM m WHERE path = 'c7.razor'""")
def tool_component_codebehind(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p = F.col("doc_id"), F.col("p_partkey")
    files = table(spark, sf_dir, "documents").select(_text("c", d % 50, ".razor", F.when(d % 4 == 0, ".cs").when(d % 4 == 1, ".css").when(d % 4 == 2, ".js").otherwise("")).alias("rel_path"))
    members = table(spark, sf_dir, "part").select(_text("c", p % 60, ".razor").alias("path"), p.cast("int").alias("line"), F.col("p_name").alias("member"))
    return _workspace(spark, sf_dir, files=files, component_members=members).component_codebehind("c7.razor")


@register(f"""WITH {_NODES} SELECT path, line, 'element' AS kind, node_path AS text FROM nd WHERE NOT is_component AND contains(tag, 'iv') UNION ALL SELECT path, line, 'attribute', tag || ' ' || name FROM nd WHERE contains(name, 'bind')
 UNION ALL SELECT 'c' || (doc_id % 6) || '.razor', doc_id::INTEGER, 'expression', trim(source) FROM documents WHERE contains(source, 'src1') UNION ALL SELECT 'c' || (n_nationkey % 6) || '.razor', n_nationkey::INTEGER, 'directive', '@' || CASE WHEN n_nationkey % 2 = 0 THEN 'page' ELSE 'using' END || ' ' || n_name FROM nation WHERE contains(lower(n_name), 'an') OR n_nationkey < 0
 UNION ALL SELECT 'c' || (n_nationkey % 6) || '.razor', 1, 'route', n_name FROM nation WHERE contains(lower(n_name), 'an') AND n_nationkey % 2 = 0""")
def tool_component_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _workspace(spark, sf_dir, **_components(spark, sf_dir))
    out = None
    for kind, query in (("element", "IV"), ("attribute", "Bind"), ("expression", "SRC1"), ("directive", "AN"), ("route", "an")):
        part = ws.component_find(query, kind)
        out = part if out is None else out.unionByName(part)
    return out


@register("SELECT 'Card' AS component, p AS parameter, p = 'Title' AS required, string_agg(DISTINCT '/c/' || n_regionkey, ',' ORDER BY '/c/' || n_regionkey) AS routes FROM nation, (VALUES ('Title'), ('Size')) v(p) GROUP BY p")
def tool_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    parameters = spark.createDataFrame([("Card", "Title", True), ("Card", "Size", False), ("Other", "X", True)], "component string, parameter string, required boolean")
    routes = table(spark, sf_dir, "nation").select(F.lit("Card").alias("component"), _text("/c/", F.col("n_regionkey")).alias("route"))
    return _workspace(spark, sf_dir, parameters=parameters, routes=routes).component("Card").withColumn("routes", F.array_join("routes", ","))


@register("""WITH u AS (SELECT 'p' || event_id AS path, CASE user_id % 3 WHEN 0 THEN 'Card' WHEN 1 THEN 'Free' ELSE 'Gone' END AS component, event_type AS a FROM events), f AS (SELECT 'n' || n_nationkey AS path, n_nationkey % 2 = 0 AS unavailable, n_nationkey % 3 = 0 AS malformed, 'R' || n_regionkey AS r FROM nation)
 SELECT 'RZR001' AS rule, path, component AS key, 'unknown component' AS detail FROM u WHERE component = 'Gone' UNION ALL SELECT 'RZR002', path, a, component FROM u WHERE component = 'Card' AND a NOT IN ('view', 'click') UNION ALL SELECT 'RZR003', path, 'view', component FROM u WHERE component = 'Card' AND a <> 'view'
 UNION ALL SELECT 'RZR004', path, 'Fixed', 'Card' FROM f UNION ALL SELECT 'RZR005', path, 'id', '/' || r || '/{id:int}/{*View}' FROM f UNION ALL SELECT 'RZR006', path, '/' || r || '/{id:int}/{*View}', 'duplicate route' FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY path) AS nth FROM f) WHERE nth > 1
 UNION ALL SELECT 'RZR007', path, 'Card', 'Odd' FROM f UNION ALL SELECT 'RZR008', path || '.razor.css', path || '.razor', 'no component' FROM f UNION ALL SELECT 'RZR009', path, r, 'never registered' FROM f WHERE r NOT IN ('R1', 'R2') UNION ALL SELECT 'RZR000', path, '-', 'no semantics' FROM f WHERE unavailable UNION ALL SELECT 'RZR010', path, '-', 'markup does not parse' FROM f WHERE malformed""")
def tool_component_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    uses = table(spark, sf_dir, "events").select(_text("p", e).alias("path"), F.lit(1).alias("line"), F.when(u % 3 == 0, "Card").when(u % 3 == 1, "Free").otherwise("Gone").alias("component"), F.array("event_type").alias("attributes"))
    parameters = spark.createDataFrame([("Card", "view", True), ("Card", "click", False), ("Free", "one", False)], "component string, parameter string, required boolean")
    files = table(spark, sf_dir, "nation").select(_text("n", F.col("n_nationkey")).alias("path"), (F.col("n_nationkey") % 2 == 0).alias("unavailable"), (F.col("n_nationkey") % 3 == 0).alias("malformed"), _text("R", F.col("n_regionkey")).alias("r"))
    more = {
        "parameters": parameters,
        "routes": files.select("path", F.lit("Card").alias("component"), _text("/", F.col("r"), "/{id:int}/{*View}").alias("route")),
        "binds": files.select("path", F.lit("Card").alias("component"), F.lit("Fixed").alias("property")),
        "properties": spark.createDataFrame([("Card", "Fixed", False), ("Card", "Open", True)], "component string, property string, settable boolean"),
        "component_refs": files.select("path", F.lit("Card").alias("component"), F.lit("Odd").alias("field_type")),
        "lineage": spark.createDataFrame([("Card", "Base")], "type string, base string"),
        "stylesheets": files.select(_text(F.col("path"), ".razor.css").alias("path")),
        "component_files": files,
        "injects": files.select("path", F.col("r").alias("type")),
        "registered": spark.createDataFrame([("R1",)], "type string"),
        "provided": spark.createDataFrame([("R2",)], "type string"),
    }
    return _workspace(spark, sf_dir, **more).component_validate(uses, spark.createDataFrame([("Free",)], "component string"))
