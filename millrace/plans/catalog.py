"""Queries of the library over the driver tables and the SQL that gives the same rows.

The driver tables hold no code facts, so each operator runs on a table of the same shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import globs
from millrace.functions import text as tx
from millrace.operators import caps, components, diff, folds, graph, joins, markdown, rules, search
from millrace.plans import session
from millrace.sources import documents as sources
from millrace.sources import files
from millrace.sources.tables import table
from millrace.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CUT = "CASE WHEN length({0}) > {1} THEN {0}[1:{1}] || '... (+' || (length({0}) - {1}) || ' chars)' ELSE {0} END"
_LINES = "SELECT doc_id, text AS t, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL"
_PAYLOAD = _CUT.format("x", 200)

# ---------------------------------------------------------------- search


@register(f"WITH lines AS ({_LINES}), hits AS (SELECT doc_id, line, {_TRIM.format('l')} AS x FROM lines WHERE contains(l, 'tion the')) SELECT doc_id, line, {_PAYLOAD} AS text FROM hits")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.literal(table(spark, sf_dir, "documents"), "tion the")


@register(f"""WITH lines AS ({_LINES}), hits AS (SELECT doc_id, line, {_TRIM.format('l')} AS x FROM lines WHERE contains(l, 'the')),
numbered AS (SELECT doc_id, line, {_PAYLOAD} AS text, (count(*) OVER ())::BIGINT AS total, (row_number() OVER (ORDER BY doc_id, line))::INTEGER AS rank FROM hits)
SELECT * FROM numbered WHERE rank <= CASE WHEN total <= 110 THEN total ELSE least(total, 100) END""")
def search_text_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.slack_cap(search.literal(table(spark, sf_dir, "documents"), "the"), [F.col("doc_id"), F.col("line")], 100)


@register(f"""WITH lines AS ({_LINES}), hits AS (SELECT doc_id, line, {_TRIM.format('l')} AS x,
 array_to_string(list_filter([CASE WHEN contains(l, 'token') THEN 'q1' END, CASE WHEN contains(l, 'ation') THEN 'q2' END, CASE WHEN contains(l, 'ment') THEN 'q3' END], lambda y: y IS NOT NULL), ',') AS tags FROM lines
 WHERE contains(l, 'token') OR contains(l, 'ation') OR contains(l, 'ment')) SELECT doc_id, line, {_PAYLOAD} AS text, tags FROM hits""")
def search_text_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.multi(table(spark, sf_dir, "documents"), ["token", "ation", "ment"])


@register(f"""WITH lines AS ({_LINES}), around AS (SELECT doc_id, line, l, {_TRIM.format('l')} AS x,
 coalesce(lag(l) OVER w, '') AS before, coalesce(lead(l) OVER w, '') AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line))
 SELECT doc_id, line, {_PAYLOAD} AS text, before, after FROM around WHERE contains(l, 'token')""")
def search_text_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.context(table(spark, sf_dir, "documents"), "token", 1)


@register(f"""WITH lines AS ({_LINES}), around AS (SELECT doc_id, line, l, {_TRIM.format('l')} AS x, array_to_string(list_filter([lag(l, 2) OVER w, lag(l) OVER w], lambda y: y IS NOT NULL), chr(10)) AS before,
 array_to_string(list_filter([lead(l) OVER w, lead(l, 2) OVER w], lambda y: y IS NOT NULL), chr(10)) AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line))
 SELECT doc_id, line, {_PAYLOAD} AS text, array_to_string(list_filter([CASE WHEN contains(l, 'token') THEN 'q1' END, CASE WHEN contains(l, 'ation') THEN 'q2' END], lambda y: y IS NOT NULL), ',') AS tags, before, after FROM around WHERE contains(l, 'token') OR contains(l, 'ation')""")
def search_text_multi_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.context(table(spark, sf_dir, "documents"), ["token", "ation"], 2)


@register(f"""WITH lines AS ({_LINES}), hits AS (SELECT doc_id, line, {_TRIM.format('l')} AS x FROM lines WHERE contains(l, 'the')),
 capped AS (SELECT doc_id, line, {_PAYLOAD} AS text FROM hits ORDER BY doc_id, line LIMIT 500)
 SELECT arg_min(doc_id, (doc_id, line)) AS doc_id, arg_min(line, (doc_id, line)) AS line, text, count(*) AS n FROM capped GROUP BY text""")
def search_text_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.unique(search.literal(table(spark, sf_dir, "documents"), "the"), 500)


@register(f"""WITH lines AS (SELECT page_id, generate_subscripts(string_split(html, chr(10)), 1)::INTEGER AS line, unnest(string_split(html, chr(10))) AS l FROM pages WHERE html IS NOT NULL),
 hits AS (SELECT page_id, line, CASE WHEN {_TRIM.format("regexp_extract(l, 'href=[^ >]+', 0)")} <> '' THEN {_TRIM.format("regexp_extract(l, 'href=[^ >]+', 0)")} ELSE {_TRIM.format('l')} END AS x FROM lines WHERE regexp_matches(l, 'href=[^ >]+'))
 SELECT page_id, line, {_PAYLOAD} AS text FROM hits""")
def search_regex_matches_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.regex(table(spark, sf_dir, "pages"), "href=[^ >]+", "page_id", "html", matches_only=True)


@register(f"""WITH lines AS ({_LINES}), t AS (SELECT doc_id, line, {_TRIM.format('l')} AS x FROM lines) SELECT doc_id, line, {_CUT.format('x', 100)} AS text FROM t WHERE contains(x, 'The and attion') OR starts_with(x, 'The an')""")
def near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.near_miss(table(spark, sf_dir, "documents"), "\nThe and attion\nmore")


@register("""SELECT doc_id, ((length(text) - length(replace(text, 'the ', ''))) // 4)::INTEGER AS n,
 (CASE WHEN (length(text) - length(replace(text, 'the ', ''))) // 4 >= 2 THEN length(string_split(text, 'the ')[1]) + 4 + length(string_split(text, 'the ')[2]) ELSE -1 END)::INTEGER AS second_at FROM documents WHERE text IS NOT NULL""")
def nth_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", tx.occurrences(F.col("text"), "the ").alias("n"), tx.occurrence_offset(F.col("text"), "the ", 2).alias("second_at"))


@register(f"WITH lines AS ({_LINES}), n AS (SELECT *, max(line) OVER (PARTITION BY doc_id) AS m FROM lines) SELECT doc_id, line, l AS text FROM n WHERE line > m - 3")
def read_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.tail(table(spark, sf_dir, "documents"), 3)


# ---------------------------------------------------------------- paths

def _url_path() -> Column:
    return F.regexp_replace(F.regexp_extract("url", r"://([^?#]*)", 1), "/$", "")


_URL_SQL = "regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/$', '')"


@register(f"SELECT page_id, {_URL_SQL} AS path FROM pages WHERE regexp_matches({_URL_SQL}, '(?i)^(?:.*/)?en/[^/]*$')")
def find_files_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select("page_id", _url_path().alias("path"))
    return paths.where(globs.matches(F.col("path"), "**/EN/*"))


@register(f"""WITH p AS (SELECT {_URL_SQL} AS path FROM pages), g AS (SELECT path, CASE WHEN len(string_split(path, '/')) > 2 THEN array_to_string(string_split(path, '/')[1:2], '/') END AS prefix FROM p),
 c AS (SELECT *, CASE WHEN prefix IS NOT NULL THEN count(*) OVER (PARTITION BY prefix) END AS n FROM g)
 SELECT CASE WHEN prefix IS NULL OR n <= 1 THEN path ELSE prefix || '/**  x' || n || ' files' END AS "row", count(*) AS files FROM c GROUP BY 1""")
def find_files_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.rollup(table(spark, sf_dir, "pages").select(_url_path().alias("path")), "path", 2)


@register("SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def find_files_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@register(f"""WITH p AS (SELECT {_URL_SQL} AS path FROM pages), g AS (SELECT path, CASE WHEN len(string_split(path, '/')) > 1 THEN string_split(path, '/')[1] END AS top FROM p),
 c AS (SELECT *, count(*) OVER (PARTITION BY top) AS n FROM g) SELECT CASE WHEN top IS NULL OR n <= 5 THEN path ELSE top || '/**  x' || n || ' untracked' END AS "row", count(*) AS files FROM c GROUP BY 1""")
def untracked_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.untracked(table(spark, sf_dir, "pages").select(_url_path().alias("path")), "path")


# ---------------------------------------------------------------- ranking and caps


@register("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS nth FROM part WHERE contains(lower(p_type), 'steel') OR contains(lower(p_name), 'a')),
 u AS (SELECT p_partkey, p_name, p_brand FROM d WHERE nth = 1), n AS (SELECT *, (count(*) OVER ())::BIGINT AS total, (row_number() OVER (ORDER BY p_brand DESC, length(p_name), p_partkey))::INTEGER AS rank FROM u)
 SELECT * FROM n WHERE rank <= CASE WHEN total <= 55 THEN total ELSE least(total, 50) END""")
def ranked_capped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where(tx.contains_ci(F.col("p_type"), "Steel") | tx.contains_ci(F.col("p_name"), "A"))
    unique = caps.first_wins(part, ["p_name"], [F.col("p_partkey")]).select("p_partkey", "p_name", "p_brand")
    return caps.slack_cap(unique, [F.col("p_brand").desc(), F.length("p_name"), F.col("p_partkey")], 50)


@register("""WITH raw AS (SELECT p_partkey, p_brand, p_size FROM part), h AS (SELECT * FROM raw ORDER BY p_partkey LIMIT 256), u AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS nth FROM h),
 k AS (SELECT p_partkey, p_brand, p_size, (row_number() OVER (ORDER BY p_partkey))::INTEGER AS rank FROM u WHERE nth = 1), t AS (SELECT *, (SELECT count(*) FROM raw) <= 256 AS exact, CASE WHEN (SELECT count(*) FROM raw) <= 256 THEN (SELECT count(*) FROM k) ELSE (SELECT count(*) FROM raw) END AS total FROM k)
 SELECT p_partkey, p_brand, p_size, rank, exact, total FROM t WHERE rank <= CASE WHEN total <= 22 THEN total ELSE least(total, 20) END""")
def ceiling_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return caps.ceiling(part, ["p_brand", "p_size"], [F.col("p_partkey")], 20)


@register("SELECT event_id, event_type, (SELECT count(*) FROM events WHERE event_type = 'click' AND value > 90) AS withheld FROM events WHERE value > 90 AND event_type <> 'click'")
def withhold_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = table(spark, sf_dir, "events").where(F.col("value") > 90).select("event_id", "event_type")
    return caps.withhold(high, F.col("event_type") == "click")


# ---------------------------------------------------------------- folds


@register("""SELECT l_suppkey, l_returnflag, l_linestatus, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_orderkey, l_linenumber) AS positions, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linestatus""")
def usage_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.usages(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus"], ["l_orderkey"], "l_linenumber")


@register("""WITH f AS (SELECT event_type AS head, 'user ' || (user_id % 7) AS message, 'p' || (user_id % 40) AS pos FROM events), c AS (SELECT head, message, pos, count(*) AS n FROM f GROUP BY ALL),
 g AS (SELECT head, message, list_sort(list(CASE WHEN n = 1 THEN pos ELSE pos || ' x' || n END)) AS labels, sum(n)::BIGINT AS n FROM c GROUP BY ALL)
 SELECT head, message, array_to_string(labels[1:20], ', ') || CASE WHEN len(labels) > 20 THEN ', +' || (len(labels) - 20) || ' more' ELSE '' END AS positions, n FROM g""")
def finding_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select(F.col("event_type").alias("h"), F.concat(F.lit("user "), (F.col("user_id") % 7).cast("string")).alias("m"), F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("p"))
    return folds.findings(found, "h", "p", "m")


@register("""WITH k AS (SELECT event_type || ' ' || user_id AS key FROM events), n AS (SELECT key, row_number() OVER (PARTITION BY key) AS nth FROM k)
 SELECT CASE WHEN nth = 1 THEN key ELSE key || '  [' || nth || ']' END AS occurrence FROM n""")
def occurrence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("key"))
    return folds.occurrence_names(keys, "key")


@register("""WITH k AS (SELECT event_type || ' ' || user_id AS key, CASE WHEN ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) THEN 1 ELSE 0 END AS run FROM events), n AS (SELECT run, key, row_number() OVER (PARTITION BY run, key) AS nth FROM k),
 o AS (SELECT run, CASE WHEN nth = 1 THEN key ELSE key || '  [' || nth || ']' END AS occurrence FROM n), a AS (SELECT occurrence FROM o WHERE run = 1), b AS (SELECT occurrence FROM o WHERE run = 0)
 SELECT coalesce(a.occurrence, b.occurrence) AS occurrence, CASE WHEN b.occurrence IS NULL THEN 'appeared' WHEN a.occurrence IS NULL THEN 'fixed' ELSE 'unchanged' END AS state FROM a FULL JOIN b ON a.occurrence = b.occurrence""")
def since_last_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    middle = events.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("t")).scalar()
    events = events.withColumn("t", middle).select(F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("key"), F.when(F.col("ts") >= F.col("t"), 1).otherwise(0).alias("run"))
    keys = lambda run: folds.occurrence_names(events.where(F.col("run") == run), "key")
    return folds.delta(keys(1), keys(0), "occurrence")


# ---------------------------------------------------------------- reach


@register("SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS tests, count(DISTINCT o_orderpriority) AS files FROM orders GROUP BY o_custkey")
def explore_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("tests"), F.count_distinct("o_orderpriority").alias("files"))


@register("SELECT c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name ORDER BY n DESC, c_name LIMIT 10")
def impact_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_name").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "c_name").limit(10)


@register("""WITH RECURSIVE e AS (SELECT DISTINCT conv_id * 1000 + turn AS a, conv_id * 1000 + CASE WHEN turn % 7 = 6 THEN turn - 3 ELSE turn + 1 END AS b FROM conversations), k AS (SELECT e.a, e.b FROM e WHERE e.b IN (SELECT a FROM e)),
 r AS (SELECT a AS node, a AS reached, 0 AS depth FROM k UNION SELECT b, b, 0 FROM k UNION SELECT r.node, k.b, r.depth + 1 FROM r JOIN k ON r.reached = k.a WHERE r.depth < 40)
 SELECT node, reached, min(depth)::INTEGER AS depth FROM r GROUP BY ALL""")
def impact_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that follow each turn of a conversation; every seventh leads back, so there are cycles."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    edges = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("a"), (F.col("conv_id") * 1000 + F.when(F.col("turn") % 7 == 6, F.col("turn") - 3).otherwise(F.col("turn") + 1)).alias("b"))
    return graph.closure(edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi"), "a", "b")


@register("""WITH RECURSIVE e AS (SELECT DISTINCT 'r' || r_regionkey AS a, 'n' || n_nationkey AS b FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT 'n' || n_nationkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 r AS (SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS reached, 0 AS depth FROM region UNION SELECT r.node, e.b, r.depth + 1 FROM r JOIN e ON r.reached = e.a) SELECT node, reached, min(depth)::INTEGER AS depth FROM r GROUP BY ALL""")
def impact_closure_of_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is reached from every region, over nations to suppliers."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nation = table(spark, sf_dir, "nation")
    edges = nation.select(key("r", "n_regionkey").alias("a"), key("n", "n_nationkey").alias("b"))
    edges = edges.unionByName(table(spark, sf_dir, "supplier").select(key("n", "s_nationkey").alias("a"), key("s", "s_suppkey").alias("b")))
    return graph.closure(edges, "a", "b", table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("seed")))


@register("""WITH RECURSIVE e AS (SELECT p_partkey AS k, (p_partkey * 7) % (SELECT count(*) FROM part) AS parent FROM part), w AS (SELECT k AS node, [k] AS chain, k AS at, 0 AS hop FROM e
 UNION ALL SELECT w.node, list_append(w.chain, e.parent), e.parent, hop + 1 FROM w JOIN e ON w.at = e.k JOIN e AS known ON e.parent = known.k WHERE NOT list_contains(w.chain, e.parent) AND hop < 16)
 SELECT node, array_to_string(arg_max(chain, hop), '>') AS chain FROM w GROUP BY node""")
def style_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey")
    n = part.agg(F.count("*").alias("n")).scalar()
    edges = part.withColumn("n", n).select(F.col("p_partkey").alias("k"), ((F.col("p_partkey") * 7) % F.col("n")).alias("parent"))
    return graph.chain(edges, "k", "parent").select("node", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"))


@register("""WITH h AS (SELECT event_id, user_id, (event_id % 400)::INTEGER AS a, (event_id % 400 + event_id % 5)::INTEGER AS b FROM events),
 s AS (SELECT event_id AS span, user_id, (event_id % 200)::INTEGER AS sa, (event_id % 200 + 50 + event_id % 90)::INTEGER AS sb FROM events WHERE event_type = 'view'),
 m AS (SELECT h.*, s.span, row_number() OVER (PARTITION BY h.event_id ORDER BY sb - sa NULLS LAST, s.span) AS rn FROM h LEFT JOIN s ON h.user_id = s.user_id AND sa <= a AND sb >= b)
 SELECT event_id, user_id, a, b, span::VARCHAR AS span, CASE WHEN span IS NULL THEN 'HEURISTIC' ELSE 'EXACT' END AS confidence FROM m WHERE rn = 1""")
def lines_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    hunks = events.select("event_id", "user_id", (F.col("event_id") % 400).cast("int").alias("a"), (F.col("event_id") % 400 + F.col("event_id") % 5).cast("int").alias("b"))
    spans = events.where(F.col("event_type") == "view").select(F.col("event_id").alias("span"), "user_id", (F.col("event_id") % 200).cast("int").alias("sa"), (F.col("event_id") % 200 + 50 + F.col("event_id") % 90).cast("int").alias("sb"))
    return joins.containment(hunks, spans, "user_id", "a", "b", "sa", "sb", "span", "event_id").withColumn("span", F.col("span").cast("string"))


# ---------------------------------------------------------------- resource tables

_ENTRY_SQL = """e AS (SELECT 'f' || (doc_id % 9) AS family, 'f' || (doc_id % 9) || '.' || lang AS path, CASE WHEN lang <> 'en' THEN lang END AS culture, 'k' || (doc_id % 31) AS name,
 CASE WHEN doc_id % 17 = 0 THEN '' ELSE CASE WHEN doc_id % 19 = 0 THEN '  ' ELSE '' END || coalesce(string_split(text, chr(10))[1], '') || CASE WHEN doc_id % 5 = 0 THEN ' {' || (doc_id % 4) || '}' ELSE '' END END AS value,
 CASE WHEN doc_id % 11 = 0 THEN 'Typed' ELSE 'Text' END AS kind, doc_id % 13 = 0 AS preserved, doc_id::INTEGER AS line FROM documents WHERE lang IS NOT NULL)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isNotNull())
    every = lambda n, text: F.when(F.col("doc_id") % n == 0, text).otherwise(F.lit(""))
    value = F.concat(every(19, F.lit("  ")), F.coalesce(F.split("text", "\n")[0], F.lit("")), every(5, F.concat(F.lit(" {"), (F.col("doc_id") % 4).cast("string"), F.lit("}"))))
    family = F.concat(F.lit("f"), (F.col("doc_id") % 9).cast("string"))
    return docs.select(
        family.alias("family"),
        F.concat(family, F.lit("."), "lang").alias("path"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("culture"),
        F.concat(F.lit("k"), (F.col("doc_id") % 31).cast("string")).alias("name"),
        F.when(F.col("doc_id") % 17 == 0, F.lit("")).otherwise(value).alias("value"),
        F.when(F.col("doc_id") % 11 == 0, "Typed").otherwise("Text").alias("kind"),
        (F.col("doc_id") % 13 == 0).alias("preserved"),
        F.col("doc_id").cast("int").alias("line"),
    )


_RULE_SQL = f"WITH {_ENTRY_SQL}, "
_NEUTRAL = "n AS (SELECT family, name, arg_min(value, line) AS neutral FROM e WHERE kind = 'Text' AND culture IS NULL GROUP BY ALL)"
_PAIRED = f"{_NEUTRAL}, p AS (SELECT e.*, n.neutral FROM e JOIN n USING (family, name) WHERE e.kind = 'Text' AND e.culture IS NOT NULL), d AS (SELECT *, list_sort(list_distinct([x::INTEGER FOR x IN regexp_extract_all(value, '\\{{(\\d+)(?:[,:][^}}]*)?\\}}', 1)])) AS a, list_sort(list_distinct([x::INTEGER FOR x IN regexp_extract_all(neutral, '\\{{(\\d+)(?:[,:][^}}]*)?\\}}', 1)])) AS x FROM p), q AS (SELECT *, list_filter(a, lambda v: NOT list_contains(x, v)) AS extra, list_filter(x, lambda v: NOT list_contains(a, v)) AS absent FROM d)"


@register(_RULE_SQL + f"{_NEUTRAL}, f AS (SELECT DISTINCT family, path, culture FROM e WHERE culture IS NOT NULL) SELECT 'RESX001' AS rule, f.path, n.name AS key, f.culture || ': untranslated' AS detail FROM n JOIN f USING (family) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.kind = 'Text' AND e.culture IS NOT NULL AND e.path = f.path AND e.name = n.name)")
def resx_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.resx_missing(_entries(spark, sf_dir))


@register(_RULE_SQL + _PAIRED + " SELECT 'RESX002' AS rule, path, name AS key, 'extra=' || array_to_string(extra, ',') || ' absent=' || array_to_string(absent, ',') AS detail FROM q WHERE len(extra) > 0 OR len(absent) > 0")
def resx_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.resx_placeholders(_entries(spark, sf_dir))


@register(_RULE_SQL + "t AS (SELECT 'k' || (event_id % 20) AS name FROM events) SELECT 'RESX003' AS rule, path, name AS key, 'nothing names it' AS detail FROM (SELECT DISTINCT path, name FROM e WHERE kind = 'Text' AND culture IS NULL) WHERE name NOT IN (SELECT name FROM t)")
def resx_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "events").select(F.concat(F.lit("k"), (F.col("event_id") % 20).cast("string")).alias("token"))
    return rules.resx_unused(_entries(spark, sf_dir), tokens)


@register(_RULE_SQL + "g AS (SELECT path, name, list_sort(list(line)) AS lines FROM e GROUP BY ALL) SELECT 'RESX004' AS rule, path, name AS key, 'repeated: ' || array_to_string(lines, ', ') AS detail FROM g WHERE len(lines) > 1")
def resx_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.resx_duplicates(_entries(spark, sf_dir))


@register(_RULE_SQL + "n AS (SELECT DISTINCT family, name FROM e WHERE culture IS NULL) SELECT 'RESX005' AS rule, path, name AS key, 'has no neutral counterpart' AS detail FROM e WHERE kind = 'Text' AND culture IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.family = e.family AND n.name = e.name)")
def resx_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.resx_orphans(_entries(spark, sf_dir))


@register(_RULE_SQL + _PAIRED + " SELECT 'RESX006' AS rule, path, name AS key, 'blank translation' AS detail FROM q WHERE value = '' AND len(extra) = 0 AND len(absent) = 0")
def resx_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.resx_empty(_entries(spark, sf_dir))


@register(_RULE_SQL + f"x AS (SELECT 1) SELECT 'RESX007' AS rule, path, name AS key, 'padded value' AS detail FROM e WHERE kind = 'Text' AND NOT preserved AND value <> {_TRIM.format('value')}")
def resx_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.resx_whitespace(_entries(spark, sf_dir))


@register(_RULE_SQL + "l AS (SELECT path, name, lag(name) OVER (PARTITION BY path ORDER BY line) AS was FROM e) SELECT DISTINCT 'RESX008' AS rule, path, '-' AS key, 'keys unsorted' AS detail FROM l WHERE was > name")
def resx_unsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.resx_unsorted(_entries(spark, sf_dir))


@register(_RULE_SQL + "d AS (SELECT 'f' || (doc_id % 9) AS family, 'f' || (doc_id % 9) || '.designer' AS designer, string_agg(DISTINCT 'k' || (doc_id % 23 + doc_id % 2), ' ' ORDER BY 'k' || (doc_id % 23 + doc_id % 2)) AS text FROM documents GROUP BY 1, 2) SELECT 'RESX009' AS rule, designer AS path, name AS key, 'missing from generated code' AS detail FROM (SELECT DISTINCT family, name FROM e WHERE kind = 'Text' AND culture IS NULL) JOIN d USING (family) WHERE NOT contains(text, name)")
def resx_designer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = F.concat(F.lit("k"), (F.col("doc_id") % 23 + F.col("doc_id") % 2).cast("string"))
    designers = docs.groupBy(F.concat(F.lit("f"), (F.col("doc_id") % 9).cast("string")).alias("family")).agg(F.array_join(F.sort_array(F.collect_set(key)), " ").alias("text"))
    return rules.resx_designer(_entries(spark, sf_dir), designers.select("family", F.concat("family", F.lit(".designer")).alias("designer"), "text"))


@register(_RULE_SQL + f"{_NEUTRAL}, f AS (SELECT DISTINCT family, path, culture FROM e WHERE culture IS NOT NULL), m AS (SELECT n.family FROM n JOIN f USING (family) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.kind = 'Text' AND e.culture IS NOT NULL AND e.path = f.path AND e.name = n.name)) SELECT family, (SELECT count(*) FROM m WHERE m.family = a.family) AS missing FROM (SELECT DISTINCT family FROM e) a")
def resx_family_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.family_missing(_entries(spark, sf_dir))


@register("""SELECT l_shipmode AS k, a AS "N", b AS "O" FROM (SELECT l_returnflag AS l_shipmode, coalesce(min(l_linenumber) FILTER (l_linestatus = 'N')::VARCHAR, 'MISSING') AS a, coalesce(min(l_linenumber) FILTER (l_linestatus = 'O')::VARCHAR, 'MISSING') AS b FROM lineitem GROUP BY l_returnflag)""")
def resx_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), "l_linestatus", "l_linenumber")
    return joins.matrix(entries, "k", "l_linestatus", "l_linenumber", ["N", "O"])


# ---------------------------------------------------------------- markup tables

_ELEMENT_SQL = "el AS (SELECT source AS file, doc_id::INTEGER AS line, 'k' || (doc_id % 31) AS key, CASE WHEN doc_id % 2 = 0 THEN 'n' || (doc_id % 17) END AS name FROM documents)"


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").cast("int").alias("line"), F.concat(F.lit("k"), (F.col("doc_id") % 31).cast("string")).alias("key"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("n"), (F.col("doc_id") % 17).cast("string"))).alias("name"))


@register(f"WITH {_ELEMENT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY line) AS nth FROM el WHERE name IS NOT NULL) SELECT 'XAML002' AS rule, file AS path, name AS key, 'again at line ' || line AS detail FROM r WHERE nth > 1")
def markup_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.markup_duplicates(_elements(spark, sf_dir), "name", "XAML002")


@register(f"WITH {_ELEMENT_SQL}, refs AS (SELECT event_type AS file, event_id::INTEGER AS line, 'k' || (event_id % 40) AS key FROM events) SELECT 'XAML003' AS rule, file AS path, key, 'line ' || line AS detail FROM refs WHERE key NOT IN (SELECT key FROM el)")
def markup_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), F.col("event_id").cast("int").alias("line"), F.concat(F.lit("k"), (F.col("event_id") % 40).cast("string")).alias("key"))
    elements = _elements(spark, sf_dir)
    return rules.markup_unresolved(refs, elements, elements.select("file", F.lit(True).alias("parsed")).distinct())


@register(f"WITH {_ELEMENT_SQL} SELECT 'XAML004' AS rule, file AS path, key, 'line ' || line AS detail FROM el WHERE key NOT IN (SELECT 'k' || (event_id % 25) FROM events)")
def markup_unused_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "events").select(F.concat(F.lit("k"), (F.col("event_id") % 25).cast("string")).alias("token"))
    return rules.markup_unused(_elements(spark, sf_dir), mentions, "key", "XAML004")


@register("""WITH r AS (SELECT url AS path, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS route FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY lower(route) ORDER BY path, route) AS nth FROM r)
 SELECT 'RZR006' AS rule, path, route AS key, 'duplicate route' AS detail FROM n WHERE nth > 1""")
def component_duplicate_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.duplicate_routes(table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.regexp_extract("url", r"://[^/]*(/[^?#]*)", 1).alias("route")))


@register("""WITH u AS (SELECT DISTINCT user_id, event_type FROM events), w AS (SELECT event_id, user_id, event_type, list_filter(['view', 'purchase'], lambda x: x <> event_type) AS need FROM events)
 SELECT 'RZR003' AS rule, event_id::VARCHAR AS path, unnest(need) AS key, 'c' AS detail FROM w""")
def component_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.lit("c").alias("component"), F.array("event_type").alias("attributes"))
    parameters = spark.createDataFrame([("c", "view", True), ("c", "purchase", True), ("c", "click", False)], "component string, parameter string, required boolean")
    return rules.required_parameters(uses, parameters)


@register("SELECT 'DEAD001' AS rule, p_brand AS path, p_name AS key, 'never referenced' AS detail FROM part WHERE p_size > 25 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def dead_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"), F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("private"))
    refs = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_partkey").alias("symbol_id")).distinct()
    return rules.dead_members(part, refs.join(part.select(F.col("id").alias("symbol_id"), "path"), "symbol_id"))


# ---------------------------------------------------------------- joins


@register("""WITH s AS (SELECT DISTINCT 'a' || (doc_id % 50) AS uid FROM documents), n AS (SELECT 'a' || (p_partkey % 70) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || p_brand END AS name FROM part)
 SELECT uid, count(name) AS n, coalesce(array_to_string(list_sort(list(name) FILTER (name IS NOT NULL))[1:4], ','), '') AS names FROM s LEFT JOIN n ON name = uid OR starts_with(name, uid || '.') GROUP BY uid""")
def uid_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "documents").select(F.concat(F.lit("a"), (F.col("doc_id") % 50).cast("string")).alias("uid"))
    entries = table(spark, sf_dir, "part").select(F.concat(F.lit("a"), (F.col("p_partkey") % 70).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("."), "p_brand"))).alias("name"))
    return joins.prefix(sites, entries, "uid", "name")


@register("""SELECT c_name AS name, n_name AS method FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def registration_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("method"))
    direct = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 9000).join(nation, F.col("c_nationkey") == F.col("k")).select(F.col("c_name").alias("name"), "method")
    bodies = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("k"))
    return joins.expand_through(direct, nation, bodies, "k")


@register("""WITH q AS (SELECT DISTINCT p_brand AS asked FROM part UNION SELECT 'Brand#none' UNION SELECT 'brand#1'), h AS (SELECT q.asked, p_partkey::VARCHAR AS id FROM q LEFT JOIN part ON q.asked = p_brand), g AS (SELECT asked, count(id) AS n, list_sort(list(id) FILTER (id IS NOT NULL)) AS ids FROM h GROUP BY asked),
 c AS (SELECT asked, b, row_number() OVER (PARTITION BY asked ORDER BY levenshtein(lower(asked), lower(b)), b) AS rn FROM g JOIN (SELECT DISTINCT p_brand AS b FROM part) ON n = 0 AND lower(left(asked, 3)) = lower(left(b, 3))), k AS (SELECT asked, string_agg(b, ',' ORDER BY rn) AS near FROM c WHERE rn <= 3 GROUP BY asked)
 SELECT asked, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'ok' WHEN n > 100 THEN 'saturated' ELSE 'ambiguous' END AS status, n, coalesce(array_to_string(ids[1:10], ','), '') AS ids, coalesce(near, '') AS near FROM g LEFT JOIN k USING (asked)""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    asked = part.select(F.col("p_brand").alias("q")).distinct().unionByName(spark.createDataFrame([("Brand#none",), ("brand#1",)], "q string"))
    return joins.resolve(asked, part.select(F.col("p_brand").alias("name"), F.lit("").alias("container"), F.col("p_partkey").alias("id")), "q")


@register("""WITH m AS (SELECT n_name AS t, 'Region' AS member, 'R' || n_regionkey AS r FROM nation UNION ALL SELECT 'R' || r_regionkey, 'Name', 'S' FROM region WHERE r_regionkey <> 2), p AS (SELECT c_custkey, n_name AS t, CASE c_custkey % 3 WHEN 0 THEN 'Region.Name' WHEN 1 THEN 'Region' ELSE 'Other.Name' END AS path FROM customer JOIN nation ON c_nationkey = n_nationkey)
 SELECT c_custkey, t AS start, path, broken IS NULL AS resolved, broken FROM (SELECT p.*, CASE WHEN path = 'Other.Name' THEN 'Other' WHEN path = 'Region' THEN NULL WHEN b.member IS NULL THEN 'Name' END AS broken FROM p LEFT JOIN m a ON p.t = a.t AND a.member = 'Region' LEFT JOIN m b ON a.r = b.t AND b.member = 'Name')""")
def binding_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = lambda c: F.concat(F.lit("R"), F.col(c).cast("string"))
    members = nation.select(F.col("n_name").alias("type"), F.lit("Region").alias("member"), name("n_regionkey").alias("member_type"))
    members = members.unionByName(region.where(F.col("r_regionkey") != 2).select(name("r_regionkey").alias("type"), F.lit("Name").alias("member"), F.lit("S").alias("member_type")))
    kind = F.col("c_custkey") % 3
    paths = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("start"), F.when(kind == 0, "Region.Name").when(kind == 1, "Region").otherwise("Other.Name").alias("path"))
    return joins.member_walk(paths, members, "path", "start", most=2)


@register("""WITH n AS (SELECT conv_id, turn, ((length(text) - length(replace(text, 'the', ''))) // 3)::INTEGER AS occurrences FROM conversations WHERE text IS NOT NULL), l AS (SELECT *, lag(occurrences, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM n)
 SELECT conv_id, turn, occurrences, was FROM l WHERE occurrences <> was""")
def history_pickaxe(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull()).select("conv_id", "turn", "text")
    return joins.pickaxe(turns, "conv_id", "turn", tx.occurrences(F.col("text"), "the")).select("conv_id", "turn", "occurrences", "was")


@register("""SELECT o_orderkey AS path, (o_custkey % 9)::BIGINT AS added, (o_orderkey % 5)::BIGINT AS deleted, coalesce(CASE WHEN o_orderpriority < '3' THEN o_orderstatus END, 'M') AS status FROM orders""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    stats = orders.select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 9).alias("added"), (F.col("o_orderkey") % 5).alias("deleted"))
    return files.changed(stats, orders.where(F.col("o_orderpriority") < "3").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("status")))


# ---------------------------------------------------------------- test runs and tool output

_OUTCOME_SQL = "r AS (SELECT event_id, user_id % 20 AS project, CASE event_type WHEN 'purchase' THEN 'Failed' WHEN 'click' THEN 'Skipped' ELSE 'Passed' END AS outcome, floor(value)::BIGINT AS ms FROM events)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "purchase", "Failed").when(F.col("event_type") == "click", "Skipped").otherwise("Passed")
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("project"), outcome.alias("outcome"), F.floor("value").alias("duration_ms"))


_SUMMARY = "count(*) FILTER (outcome = 'Passed') AS passed, count(*) FILTER (outcome = 'Failed') AS failed, count(*) FILTER (outcome = 'Skipped') AS skipped, count(*) AS total, coalesce(sum(ms), 0)::BIGINT AS duration_ms, CASE WHEN count(*) = 0 THEN 'EMPTY' WHEN count(*) FILTER (outcome = 'Failed') > 0 THEN 'FAILED' ELSE 'PASSED' END AS verdict"


@register(f"WITH {_OUTCOME_SQL} SELECT {_SUMMARY} FROM r")
def test_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.test_summary(_results(spark, sf_dir))


@register(f"WITH {_OUTCOME_SQL} SELECT project, {_SUMMARY} FROM r GROUP BY project")
def test_run_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.test_summary(_results(spark, sf_dir), ["project"])


@register(f"WITH {_OUTCOME_SQL} SELECT event_id, ms AS duration_ms FROM r ORDER BY ms DESC, event_id LIMIT 10")
def slowest_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).orderBy(F.col("duration_ms").desc(), "event_id").limit(10).select("event_id", "duration_ms")


@register(f"WITH {_OUTCOME_SQL} SELECT event_id, project FROM r WHERE project IN (SELECT project FROM r WHERE outcome = 'Failed' AND ms > 90)")
def rerun_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _results(spark, sf_dir)
    failed = results.where((F.col("outcome") == "Failed") & (F.col("duration_ms") > 90)).select("project").distinct()
    return results.join(failed, "project", "left_semi").select("event_id", "project")


@register("SELECT DISTINCT trim(p_name) AS name FROM part WHERE contains(lower(p_name), 'a') AND trim(p_name) <> ''")
def list_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.test_names(table(spark, sf_dir, "part"), "A", "p_name")


@register("""WITH l AS (SELECT DISTINCT 'f' || (event_id % 10) || '.x(' || (event_id % 40 + 1) || ',' || (event_id % 9 + 1) || '): ' || CASE WHEN event_type = 'purchase' THEN 'error' ELSE 'warning' END || ' E' || (user_id % 5) || ': ' || event_type || ' [p]' AS v FROM events)
 SELECT regexp_extract(v, '^(.*?)\\(', 1) AS path, regexp_extract(v, '\\((\\d+),', 1)::INTEGER AS line, regexp_extract(v, ',(\\d+)\\)', 1)::INTEGER AS col, regexp_extract(v, ': (error|warning) ', 1) AS severity, regexp_extract(v, ' (E\\d+): ', 1) AS id, regexp_extract(v, 'E\\d+: (.*?) \\[p\\]$', 1) AS message FROM l""".replace("\\\\", "\\"))
def diagnostics_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: c.cast("string")
    e, u = F.col("event_id"), F.col("user_id")
    value = F.concat(F.lit("f"), s(e % 10), F.lit(".x("), s(e % 40 + 1), F.lit(","), s(e % 9 + 1), F.lit("): "), F.when(F.col("event_type") == "purchase", "error").otherwise("warning"), F.lit(" E"), s(u % 5), F.lit(": "), "event_type", F.lit(" [p]"))
    return files.diagnostics(table(spark, sf_dir, "events").select(value.alias("value")))


# ---------------------------------------------------------------- markdown


@register("SELECT r_regionkey::INTEGER AS id, n_name AS \"Name\", n_nationkey::VARCHAR AS \"Key\" FROM nation JOIN region ON n_regionkey = r_regionkey")
def markdown_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("id"), F.concat_ws("", F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | x\\|y | "), "n_name", F.lit(" |")).alias("row"))
    text = nation.groupBy("id").agg(F.concat(F.lit("# t\n\n| key | other | NAME |\n|---|:-:|--|\n"), F.array_join(F.sort_array(F.collect_list("row")), "\n")).alias("text"))
    return markdown.table(text, ["Name", "Key"], "id", "text").select("id", "Name", "Key")


@register(f"""WITH lines AS ({_LINES}), m AS (SELECT doc_id, line, l, max(line) OVER (PARTITION BY doc_id) AS n FROM lines), h AS (SELECT doc_id AS id, line, line * 2 AS start_line, 1 + line % 3 AS level, 'Part ' || line AS heading, n FROM m WHERE line % 2 = 1)
 SELECT id, heading, level::INTEGER AS level, start_line::INTEGER AS start_line, coalesce((SELECT min(o.start_line) FROM h o WHERE o.id = h.id AND o.start_line > h.start_line AND o.level <= h.level) - 1, h.n * 2)::INTEGER AS end_line FROM h""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a line put after each of its lines, a heading behind every other one."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    mark = lambda i: F.when(i % 2 == 0, F.concat(F.repeat(F.lit("#"), (1 + (i + 1) % 3).cast("int")), F.lit(" Part "), (i + 1).cast("string"))).otherwise(F.lit("text"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.regexp_replace(x, r"^(\s*)([#`~])", "$1.$2"), F.lit("\n"), mark(i)))
    return markdown.sections(docs.select(F.col("doc_id").alias("id"), F.array_join(lines, "\n").alias("text")), "id", "text")


@register("""SELECT n_regionkey AS id, 'Top' AS heading, 1 AS level, 1 AS start_line, (count(*) + 4)::INTEGER AS end_line FROM nation GROUP BY ALL
 UNION ALL SELECT n_regionkey, n_name, 2, (4 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name))::INTEGER, (4 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name))::INTEGER FROM nation""")
def markdown_sections_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.sort_array(F.collect_list(F.concat(F.lit("## "), "n_name"))).alias("h"))
    return markdown.sections(names.select("id", F.concat(F.lit("# Top\n```\n# not one\n```\n"), F.array_join("h", "\n")).alias("text")), "id", "text")


# ---------------------------------------------------------------- change stream and diff


@register("""WITH c AS (SELECT event_id AS seq, 'd/f' || (user_id % 300) || CASE user_id % 4 WHEN 0 THEN '.cs' WHEN 1 THEN '.xaml' WHEN 2 THEN '.resx' ELSE '.txt' END AS path, CASE WHEN event_type = 'purchase' THEN 'deleted' ELSE 'changed' END AS op, value FROM events),
 l AS (SELECT path, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM c WHERE NOT ends_with(path, '.txt') GROUP BY path)
 SELECT path, floor(value)::BIGINT AS length, CASE WHEN ends_with(path, '.cs') THEN 'Code' WHEN ends_with(path, '.xaml') THEN 'Xaml' ELSE 'Resx' END AS kind FROM l WHERE op <> 'deleted'""")
def change_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after two drains of a change log, the earlier half of the events and then the rest."""
    u = F.col("user_id") % 4
    path = F.concat(F.lit("d/f"), (F.col("user_id") % 300).cast("string"), F.when(u == 0, ".cs").when(u == 1, ".xaml").when(u == 2, ".resx").otherwise(".txt"))
    log = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("seq"), path.alias("path"), F.when(F.col("event_type") == "purchase", "deleted").otherwise("changed").alias("op"), F.col("ts").cast("timestamp").alias("modified"), F.floor("value").alias("length"))
    temporary = [F.lit(x) for x in ("~", ".tmp", ".orig")]
    noise = log.withColumn("path", F.concat("path", F.get(F.array(*temporary), (F.col("seq") % 3).cast("int"))))
    noise = noise.unionByName(log.withColumn("path", F.concat(F.lit("x/obj/"), "path")))
    folder = session.shared_folder(spark, "changes")
    middle = log.agg(F.max("seq") / 2).scalar()
    for part in (log.unionByName(noise).where(F.col("seq") <= middle), log.unionByName(noise).where(F.col("seq") > middle)):
        part.write.mode("append").parquet(f"{folder}/log")
        changes.drain(spark, f"{folder}/log", f"{folder}/held")
    return changes.state(spark, f"{folder}/held").select("path", "length", "kind")


@register()
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace("text", F.lit(". "), F.lit(".\n")).alias("text"))
    later = turns.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("new"))
    pairs = turns.withColumnRenamed("text", "old").join(later, ["conv_id", "turn"])
    return diff.diff_texts(pairs, "old", "new")
