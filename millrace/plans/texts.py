"""Queries that work from whole texts: scanned markup and components, patterns across lines, mentions, hunks, lineage; each with its SQL.

The texts are the driver's documents and pages, or files written from them line by line, so that SQL can tell what the scan must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import components, diff, grep, joins, markdown, mentions, reading, rules
from millrace.plans.catalog import _CUT, _LINES, _PAYLOAD, _RULE_SQL, _TRIM, _entries, register
from millrace.plans.tools import _FILES, _files, _text
from millrace.plans.workspace import Workspace
from millrace.sources import markup
from millrace.sources.tables import table

_NL = "(length({0}) - length(replace({0}, chr(10), '')))"

# ---------------------------------------------------------------- scanned markup and components


@register(f"""WITH t AS (SELECT page_id, generate_subscripts(regexp_extract_all(html, '(?s)<!--.*?-->|<[^>]*>|[^<]+|<'), 1) AS i, unnest(regexp_extract_all(html, '(?s)<!--.*?-->|<[^>]*>|[^<]+|<')) AS x FROM pages WHERE html IS NOT NULL),
 p AS (SELECT *, (1 + coalesce(sum({_NL.format('x')}) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS line FROM t)
 SELECT page_id, line, regexp_extract(x, '^<([A-Za-z0-9_.:-]+)', 1) AS tag, len(regexp_extract_all(x, '\\s+[^\\s=>/]+(="[^"]*")?'))::INTEGER AS n_attributes, nullif(regexp_extract(x, ' href="([^"]*)"', 1), '') AS href FROM p WHERE regexp_matches(x, '^<[A-Za-z0-9_]')""")
def component_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of every page, with its line."""
    found = markup.components(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html").where(F.col("kind") == "element")
    href = F.get(F.filter("attributes", lambda a: a["name"] == "href"), F.lit(0))["expression"]
    return found.select("page_id", "line", F.col("name").alias("tag"), F.size("attributes").alias("n_attributes"), F.nullif(href, F.lit("")).alias("href"))


def _plain_lines() -> Column:
    return F.split(F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f￾￿]", ""), "\n")


_PLAIN = "string_split(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f]', '', 'g'), chr(10))"


@register(f"""WITH d AS (SELECT doc_id AS file, {_PLAIN} AS l FROM documents WHERE text IS NOT NULL), e AS (SELECT file, len(l) AS n, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM d)
 SELECT file, true AS parsed, NULL AS problem, 1::INTEGER AS line, 'Page' AS type_name, NULL AS name, 'Page' AS path, NULL AS value FROM d WHERE file % 10 <> 3
 UNION ALL SELECT file, true, NULL, (i + 1)::INTEGER, 'Line', 'n' || i, 'Page/Line' || CASE WHEN n > 1 THEN '[' || (i - 1) || ']' ELSE '' END, md5(replace(x, chr(9), ' ')) FROM e WHERE file % 10 <> 3
 UNION ALL SELECT file, false, '<Page> is never closed', (len(l) + 2)::INTEGER, NULL, NULL, NULL, NULL FROM d WHERE file % 10 = 3""")
def markup_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as markup, an element for each of its lines; every tenth never closes."""
    quoted = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    lines = F.transform(_plain_lines(), lambda x, i: F.concat(F.lit('<Line x:Name="n'), (i + 1).cast("string"), F.lit('" Text="'), quoted(x), F.lit('"/>')))
    end = F.when(F.col("doc_id") % 10 == 3, "").otherwise("</Page>")
    text = F.concat(F.lit('<Page xmlns:x="u">\n'), F.array_join(lines, "\n"), F.lit("\n"), end)
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("file"), text.alias("text"))
    return markup.markup(docs).select("file", "parsed", "problem", "line", "type_name", "name", "path", F.md5(F.element_at("attributes", "Text")).alias("value"))


def _component_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    text = _text('@page "/d/', d, '"\n@using S', F.coalesce("source", F.lit("")), '\n<Card Title="@(T.Get("', d, '"))" @bind-Value="Model.V', d % 5, '">\n<p>@Name.Of(', d, ")<br>\n", F.when(d % 4 != 0, "</Card>").otherwise(""))
    return table(spark, sf_dir, "documents").select(_text("c/f", d, ".razor").alias("rel_path"), text.alias("text"))


@register("""WITH f AS (SELECT doc_id AS d, 'c/f' || doc_id || '.razor' AS path, coalesce(source, '') AS s FROM documents)
 SELECT path, 1::INTEGER AS line, 'directive' AS kind, '@page "/d/' || d || '"' AS text FROM f UNION ALL SELECT path, 3, 'attribute', 'Card @bind-Value' FROM f UNION ALL SELECT path, 4, 'expression', '@Name.Of(' || d || ')' FROM f
 UNION ALL SELECT path, 3, 'component', 'Card' FROM f UNION ALL SELECT path, 4, 'element', 'Card/p/br' FROM f UNION ALL SELECT path, 1, 'route', '"/d/' || d || '"' FROM f UNION ALL SELECT path, 3, 'issue', '<Card> is never closed' FROM f WHERE d % 4 = 0""")
def tool_component_find_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all kinds in component files that were scanned, and what is malformed in them."""
    ws = Workspace(spark, "w", {"files": _component_files(spark, sf_dir)}).scanned()
    out = ws["issues"].select("path", "line", F.lit("issue").alias("kind"), F.col("problem").alias("text"))
    for query, kind in (("page", "directive"), ("@BIND", "attribute"), ("name.of", "expression"), ("card", "component"), ("br", "element"), ("/d/", "route")):
        out = out.unionByName(components.find(kind, query, ws["directives"], ws["nodes"], ws["expressions"]))
    return out


def _markup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_nationkey")
    text = _text('<Page xmlns:x="u">\n<Style x:Key="s', d % 40, '"/>\n<Button x:Name="b', d % 9, '" Style="{StaticResource s', d * 7 % 60, '}"/>\n<Button x:Name="b', d % 9, '"/>\n</Page>')
    views = table(spark, sf_dir, "documents").select(_text("v/f", d, ".xaml").alias("rel_path"), text.alias("text"))
    code = table(spark, sf_dir, "nation").select(_text("c/", n, ".cs").alias("rel_path"), _text("x.b", n % 5, ".Click();").alias("text"))
    return views.unionByName(code)


@register("""WITH f AS (SELECT doc_id AS d, 'v/f' || doc_id || '.xaml' AS path, 's' || (doc_id % 40) AS k, 'b' || (doc_id % 9) AS n, 's' || (doc_id * 7 % 60) AS r FROM documents)
 SELECT 'XAML002' AS rule, path, n AS key, 'again at line 4' AS detail FROM f UNION ALL SELECT 'XAML003', path, r, 'line 3' FROM f WHERE r NOT IN (SELECT k FROM f) UNION ALL SELECT 'XAML004', path, k, 'line 2' FROM f WHERE k NOT IN (SELECT r FROM f)
 UNION ALL SELECT 'XAML005', path, n, 'line ' || l FROM f, (VALUES (3), (4)) v(l) WHERE n NOT IN (SELECT 'b' || (n_nationkey % 5) FROM nation)""")
def tool_markup_validate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All markup rules from the files alone: scan, references and mentions."""
    return Workspace(spark, "w", {"files": _markup_files(spark, sf_dir)}).scanned().xaml_validate()


# ---------------------------------------------------------------- patterns over whole texts

_ACROSS = "([a-z]{3,}[.,]?\\n[A-Z][a-z]+)"


@register(f"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?s)(.*?){_ACROSS}([^\\n]*\\n?)', 1) AS a, regexp_extract_all(text, '(?s)(.*?){_ACROSS}([^\\n]*\\n?)', 2) AS b, regexp_extract_all(text, '(?s)(.*?){_ACROSS}([^\\n]*\\n?)', 3) AS c FROM documents WHERE text IS NOT NULL),
 u AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS lead, unnest(b) AS hit, unnest(c) AS rest FROM m), n AS (SELECT *, {_NL.format('lead')} AS nl, {_NL.format('lead || hit || rest')} AS nt FROM u),
 l AS (SELECT doc_id, (1 + nl + coalesce(sum(nt) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS line, {_TRIM.format('hit')} AS x FROM n) SELECT doc_id, line, {_PAYLOAD} AS text FROM l""")
def grep_across_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep(table(spark, sf_dir, "documents"), r"[a-z]{3,}[.,]?\n[A-Z][a-z]+", matches_only=True)


@register(f"""WITH {_FILES}, l AS (SELECT rel_path, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line, unnest(string_split(text, chr(10))) AS l FROM files WHERE rel_path LIKE 'src/d4/%'),
 a AS (SELECT *, {_TRIM.format('l')} AS x, coalesce(lag(l) OVER w, '') AS before, coalesce(lead(l) OVER w, '') AS after, regexp_matches(l, '[aeiou]t(h|t)') AS p, regexp_matches(l, '([A-Z][a-z]+ ){{2}}') AS q FROM l WINDOW w AS (PARTITION BY rel_path ORDER BY line)),
 n AS (SELECT rel_path, line, {_PAYLOAD} AS text, CASE WHEN p AND q THEN 'q1,q2' WHEN p THEN 'q1' ELSE 'q2' END AS tags, before, after, (count(*) OVER ())::BIGINT AS total, (row_number() OVER (ORDER BY rel_path, line))::INTEGER AS rank FROM a WHERE p OR q)
 SELECT * FROM n WHERE rank <= CASE WHEN total <= 88 THEN total ELSE least(total, 80) END""")
def tool_search_regex_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "w", {"files": _files(spark, sf_dir)})
    return ws.search_regex(["[aeiou]t(h|t)", "([A-Z][a-z]+ ){2}"], glob="src/d4/*", context=1, cap=80)


# ---------------------------------------------------------------- mentions

_IDENTIFIERS = "regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*')"


@register(f"""WITH lines AS ({_LINES}), d AS (SELECT doc_id, line, {_IDENTIFIERS.format('l')} AS d FROM lines), t AS (SELECT doc_id, line, unnest(list_distinct(list_concat(d, flatten([string_split(x, '.') FOR x IN d])))) AS token FROM d)
 SELECT token, count(*) AS lines, count(DISTINCT doc_id) AS texts FROM t GROUP BY token""")
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many lines, and in how many documents, each identifier is mentioned."""
    return mentions.counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _key_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document: its first line, a use of a resource key in one of six forms, and in some a key put together."""
    d = F.col("doc_id")
    key = _text("k", d % 23)
    use = F.when(d % 6 == 0, _text("var x = Strings . ", key, ";")).when(d % 6 == 1, _text('GetString("', key, '")')).when(d % 6 == 2, _text('<a x:Uid="', key, '"/>')).when(d % 6 == 3, _text('localizer["', key, '"]')).when(d % 6 == 4, _text('x = "', key, '";')).otherwise(_text("Gets(", key, ")"))
    first = F.coalesce(F.split("text", "\n")[0], F.lit(""))
    path = _text("src/f", d, F.when(d % 8 == 7, ".Designer.cs").otherwise(".cs"))
    return table(spark, sf_dir, "documents").select(path.alias("rel_path"), _text(first, "\n", use, F.when(d % 11 == 0, '\nGetString(p + "k")').otherwise("")).alias("text"))


_KEY_FILES = """kf AS (SELECT doc_id AS d, 'src/f' || doc_id || '.cs' AS path, 'k' || (doc_id % 23) AS k, CASE doc_id % 6 WHEN 0 THEN 'member' WHEN 1 THEN 'GetString' WHEN 2 THEN 'x:Uid' WHEN 3 THEN 'localizer[]' WHEN 4 THEN 'literal' END AS form FROM documents WHERE doc_id % 8 <> 7)"""


@register(f"""WITH {_KEY_FILES}, h AS (SELECT path, 2::INTEGER AS line, CASE WHEN d % 5 = 0 THEN 'Strings.k7' ELSE form END AS form, CASE WHEN d % 5 = 0 THEN 'EXACT' ELSE 'HEURISTIC' END AS confidence FROM kf WHERE k = 'k7' AND (form IS NOT NULL OR d % 5 = 0)),
 n AS (SELECT *, (count(*) OVER ())::BIGINT AS total, (row_number() OVER (ORDER BY path, line, form))::INTEGER AS rank FROM h) SELECT *, (SELECT count(*) FROM kf WHERE d % 11 = 0) AS composed FROM n WHERE rank <= CASE WHEN total <= 33 THEN total ELSE least(total, 30) END""")
def tool_resx_key_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages of a key in the texts, exact ones first."""
    d = F.col("doc_id")
    exact = table(spark, sf_dir, "documents").where((d % 5 == 0) & (d % 23 == 7) & (d % 8 != 7)).select(_text("src/F", d, ".cs").alias("path"), F.lit(2).alias("line"), F.lit("Strings.k7").alias("form"))
    found = Workspace(spark, "w", {"files": _key_files(spark, sf_dir)}).resx_key_usages("k7", exact.withColumn("path", F.replace("path", F.lit("F"), F.lit("f"))), cap=30)
    return found


@register(_RULE_SQL + f"{_KEY_FILES} SELECT 'RESX003' AS rule, path, name AS key, 'nothing names it' AS detail FROM (SELECT DISTINCT path, name FROM e WHERE kind = 'Text' AND culture IS NULL) WHERE name NOT IN (SELECT k FROM kf)")
def tool_resx_unused_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource keys that no file mentions."""
    return Workspace(spark, "w", {"files": _key_files(spark, sf_dir), "entries": _entries(spark, sf_dir)}).resx_validate(("RESX003",))


# ---------------------------------------------------------------- hunks


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, a sentence a line, each with the turn two later."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace("text", F.lit(". "), F.lit(".\n")).alias("text"))
    later = turns.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("new"))
    return turns.withColumnRenamed("text", "old").join(later, ["conv_id", "turn"])


@register("""WITH t AS (SELECT conv_id, turn, replace(text, '. ', '.' || chr(10)) AS text FROM conversations) SELECT a.conv_id, a.turn, replace(coalesce(b.text, ''), chr(13) || chr(10), chr(10)) AS text FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2""")
def diff_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hunks between two turns applied to the first: the second one."""
    pairs = _versions(spark, sf_dir)
    return diff.replayed(pairs.select("conv_id", "turn", "old"), diff.hunks_between(pairs, "old", "new"), ["conv_id", "turn"], "old")


@register()
def tool_diff_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded unified text of every change of a turn; the tests replay it."""
    return Workspace(spark, "w", {}).diff_unified(_versions(spark, sf_dir), "old", "new", 40)


# ---------------------------------------------------------------- lineage

_LINEAGE = """e AS (SELECT DISTINCT p_size AS d, p_size // 2 AS b, false AS i FROM part WHERE p_size > 1 UNION SELECT DISTINCT p_size, p_size * 2 // 3, true FROM part WHERE p_size > 2),
 chain AS (SELECT DISTINCT d AS t, d AS c, 0 AS depth FROM e UNION SELECT chain.t, e.b, chain.depth + 1 FROM chain JOIN e ON e.d = chain.c AND NOT e.i), every AS (SELECT DISTINCT d AS t, d AS c, 0 AS depth FROM e UNION SELECT every.t, e.b, every.depth + 1 FROM every JOIN e ON e.d = every.c)"""


def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size")
    of = lambda least, base, interface: table(spark, sf_dir, "part").where(z > least).select(_text("T", z).alias("derived"), _text("T", F.floor(base)).alias("base"), F.lit(interface).alias("is_interface")).distinct()
    return of(1, z / 2, False).unionByName(of(2, z * 2 / 3, True))


@register(f"""WITH RECURSIVE {_LINEAGE}, o AS (SELECT t, c, 0 AS via, min(depth) AS depth FROM chain GROUP BY ALL UNION ALL SELECT t, c, 1, min(depth) FROM every WHERE (t, c) NOT IN (SELECT t, c FROM chain) GROUP BY t, c UNION ALL SELECT DISTINCT p_size, p_size, 0, 0 FROM part WHERE p_size NOT IN (SELECT d FROM e)),
 m AS (SELECT DISTINCT p_size AS c, 'M' || (p_partkey % 7) AS member, 'T' || (p_size % 9) AS member_type, p_partkey % 7 <> 3 AS settable FROM part WHERE p_partkey % 3 = 0), r AS (SELECT 'T' || t AS type, member, member_type, settable, row_number() OVER (PARTITION BY t, member ORDER BY via, depth, 'T' || o.c) AS nth FROM o JOIN m USING (c))
 SELECT type, member, member_type, settable FROM r WHERE nth = 1""")
def component_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of every type, its own before those of its bases, and these before those of interfaces."""
    p, z = F.col("p_partkey"), F.col("p_size")
    members = table(spark, sf_dir, "part").where(p % 3 == 0).select(_text("T", z).alias("component"), _text("M", p % 7).alias("member"), _text("T", z % 9).alias("member_type"), (p % 7 != 3).alias("settable")).distinct()
    return components.inherited(members, _lineage(spark, sf_dir))


@register(f"""WITH RECURSIVE {_LINEAGE}, r AS (SELECT 'p' || event_id AS path, (1 + user_id % 40) AS c, (1 + event_id % 20) AS f FROM events)
 SELECT 'RZR007' AS rule, path, 'T' || c AS key, 'T' || f AS detail FROM r WHERE c <> f AND (c, f) NOT IN (SELECT t, c FROM every)""")
def component_reference_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to components whose fields can't hold them, by the whole lineage of the component."""
    e, u = F.col("event_id"), F.col("user_id")
    refs = table(spark, sf_dir, "events").select(_text("p", e).alias("path"), _text("T", 1 + u % 40).alias("component"), _text("T", 1 + e % 20).alias("field_type"))
    return rules.reference_types(refs, _lineage(spark, sf_dir).withColumnRenamed("derived", "type"))


# ---------------------------------------------------------------- markdown


@register(f"""WITH lines AS ({_LINES}), c AS (SELECT doc_id, line, {_TRIM.format("regexp_replace(l, '[|\\\\]', '', 'g')")} AS x FROM lines WHERE (line - 1) % 6 > 1) SELECT doc_id, line, x AS "Text", (line - 1)::VARCHAR AS "KEY" FROM c""")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as tables of up to four rows."""
    clean = lambda x: F.regexp_replace(x, r"[|\\]", "")
    row = lambda x, i: F.when(i % 6 == 0, "").when(i % 6 == 1, "| Key | Text |").otherwise(F.concat(F.lit("| "), i.cast("string"), F.lit(" | "), clean(x), F.lit(" |")))
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), row), "\n").alias("text"))
    return markdown.table(docs, ["Text", "KEY"], "doc_id", "text")


# ---------------------------------------------------------------- bounded reading

# Lines of each document without the empty one after a last line feed, stripped at the end, with the UTF-8 size of the document.
_STRIPPED = r"""d AS (SELECT doc_id, regexp_replace(text, '\n$', '') AS t, strlen(text)::BIGINT AS bytes FROM documents WHERE text <> ''), p AS (SELECT doc_id, bytes, string_split(t, chr(10)) AS a FROM d),
 l AS (SELECT doc_id, bytes, len(a)::INTEGER AS total_lines, generate_subscripts(a, 1)::INTEGER AS line, regexp_replace(unnest(a), '\s+$', '') AS x FROM p)"""


@register(f"""WITH {_STRIPPED}, k AS (SELECT *, row_number() OVER w AS nth, sum(length(x)) OVER w - length(x) AS before FROM l WHERE line BETWEEN 2 AND 60 AND x <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
 r AS (SELECT *, 600 - before AS room FROM k WHERE nth <= 12 AND before < 600)
 SELECT doc_id, line, CASE WHEN length(x) > room THEN x[1:room::BIGINT] || '... (+' || (length(x) - room)::BIGINT || ' chars)' ELSE x END AS text, length(x) > room AS is_cut, length(x) >= room AS is_last, total_lines,
 max(CASE WHEN (nth = 12 OR length(x) >= room) AND line < least(60, total_lines) THEN line + 1 END) OVER (PARTITION BY doc_id) AS next_line, bytes FROM r""")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 60 of every document, at most 12 of them and 600 characters."""
    return reading.windows(table(spark, sf_dir, "documents").select("doc_id", "text"), 2, 60, most_lines=12, most_chars=600)


@register(f"""WITH {_STRIPPED}, asked AS (SELECT unnest(['f12', 'gone', 'f3', 'f40', 'f41']) AS path, unnest(range(1, 6))::INTEGER AS place),
 k AS (SELECT place, l.*, row_number() OVER (PARTITION BY place ORDER BY line) AS nth FROM l JOIN asked ON path = 'f' || doc_id WHERE x <> ''), b AS (SELECT *, 2500 - (sum(length(x)) OVER (ORDER BY place, line) - length(x)) AS room FROM k WHERE nth <= 20),
 r AS (SELECT place, line, CASE WHEN length(x) > room THEN x[1:room::BIGINT] || '... (+' || (length(x) - room)::BIGINT || ' chars)' ELSE x END AS text, length(x) > room AS is_cut, length(x) >= room AS is_last, total_lines,
  max(CASE WHEN (nth = 20 OR length(x) >= room) AND line < total_lines THEN line + 1 END) OVER (PARTITION BY place) AS next_line FROM b WHERE room > 0)
 SELECT a.place, path AS rel_path, CASE WHEN f.doc_id IS NULL THEN 'NOT_FOUND' WHEN line IS NULL AND a.place > (SELECT max(place) FROM r WHERE is_last) THEN 'CLIPPED' ELSE 'OK' END AS status, line, r.text, is_cut, total_lines, next_line, CASE WHEN f.doc_id IS NOT NULL THEN strlen(coalesce(f.text, '')) END::BIGINT AS bytes
 FROM asked a LEFT JOIN documents f ON path = 'f' || f.doc_id LEFT JOIN r ON r.place = a.place""")
def tool_read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five files, one of them missing, with one budget of 2,500 characters and 20 lines each."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("rel_path"), "text")
    return Workspace(spark, "w", {"files": files}).read_texts(["f12", "gone", "f3", "f40", "f41"], most_lines=20, most_chars=2500)


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as markdown files of 50: a section for each document, with a table of its language and characters."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("k"), "doc_id", F.col("doc_id").cast("string").alias("i"), F.coalesce("lang", F.lit("-")).alias("lang"), F.coalesce(F.length("text"), F.lit(0)).cast("string").alias("n"))
    part = F.concat(F.lit("## Doc "), "i", F.lit("\n| Id | Lang | Size |\n|---|---|---|\n| "), "i", F.lit(" | "), "lang", F.lit(" | "), "n", F.lit(" |"))
    listed = d.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("part")))).alias("parts"))
    return listed.select(F.concat(F.lit("n"), F.col("k").cast("string"), F.lit(".md")).alias("rel_path"), F.concat(F.lit("# Notes\n"), F.array_join("parts.part", "\n")).alias("text"))


_NOTED = "o AS (SELECT doc_id, lang, text, (row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id))::INTEGER AS nth FROM documents), s AS (SELECT 'n' || (doc_id // 50) || '.md' AS rel_path, doc_id, coalesce(lang, '-') AS lang, coalesce(length(text), 0) AS n, 4 * nth - 2 AS first FROM o)"


@register(f"WITH {_NOTED} SELECT rel_path, first AS line, '## Doc ' || doc_id AS text FROM s WHERE doc_id = 20 UNION ALL SELECT rel_path, first + 1, '| Id | Lang | Size |' FROM s WHERE doc_id = 20 UNION ALL SELECT rel_path, first + 2, '|---|---|---|' FROM s WHERE doc_id = 20 UNION ALL SELECT rel_path, first + 3, '| ' || doc_id || ' | ' || lang || ' | ' || n || ' |' FROM s WHERE doc_id = 20")
def tool_read_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workspace(spark, "w", {"files": _notes(spark, sf_dir)}).read_section("n0.md", "## doc 20")


@register(f"""WITH {_NOTED} SELECT rel_path, first + 3 AS line, n::VARCHAR AS "size", doc_id::VARCHAR AS "Id" FROM s WHERE doc_id // 50 = 0""")
def tool_read_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workspace(spark, "w", {"files": _notes(spark, sf_dir)}).read_columns("n0.md", ["size", "Id"], section="Notes")


# ---------------------------------------------------------------- projects, overloads


def _project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each supplier, which imports the properties of its nation, which import those of its region."""
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    own = _text('<Project>\n<Import Project="../../geo/n', F.col("s_nationkey"), '.props"/>\n<PropertyGroup>\n<A>$(B)-x', s, "</A><!-- <A>no</A> -->\n<B>s</B>\n<C>$(A);$(C)</C>\n<E Condition=\"'$(D)' == 'r1'\">one</E>\n</PropertyGroup>\n<ItemGroup><Item>i</Item></ItemGroup></Project>")
    projects = table(spark, sf_dir, "supplier").select(_text("src/p", s, "/p", s, ".csproj").alias("rel_path"), own.alias("text"))
    nations = table(spark, sf_dir, "nation").select(_text("geo/n", n, ".props").alias("rel_path"), _text('<Project><Import Project="r', F.col("n_regionkey"), '.props"/><Import Project="n', n, '.props"/><PropertyGroup><B>n$(D)</B></PropertyGroup></Project>').alias("text"))
    regions = table(spark, sf_dir, "region").select(_text("geo/r", F.col("r_regionkey"), ".props").alias("rel_path"), _text("<Project><PropertyGroup><D>r", F.col("r_regionkey"), "</D><C>c</C><E>$(Root)</E></PropertyGroup></Project>").alias("text"))
    shared = table(spark, sf_dir, "region").limit(1).select(F.lit("src/Directory.Build.props").alias("rel_path"), F.lit("<Project><PropertyGroup><Root>top</Root></PropertyGroup></Project>").alias("text"))
    return projects.unionByName(nations).unionByName(regions).unionByName(shared)


@register("""WITH p AS (SELECT 'src/p' || s_suppkey || '/p' || s_suppkey || '.csproj' AS path, s_suppkey AS s, 'r' || n_regionkey AS d, 'geo/r' || n_regionkey || '.props' AS rf FROM supplier JOIN nation ON s_nationkey = n_nationkey)
 SELECT path, 'Root' AS name, 'top' AS value, 'src/Directory.Build.props' AS file FROM p UNION ALL SELECT path, 'D', d, rf FROM p UNION ALL SELECT path, 'A', 'n' || d || '-x' || s, path FROM p UNION ALL SELECT path, 'B', 's', path FROM p
 UNION ALL SELECT path, 'C', 'n' || d || '-x' || s || ';c', path FROM p UNION ALL SELECT path, 'E', CASE WHEN d = 'r1' THEN 'one' ELSE 'top' END, CASE WHEN d = 'r1' THEN path ELSE rf END FROM p""")
def tool_project_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workspace(spark, "w", {"files": _project_files(spark, sf_dir)}).project_properties()


@register("""WITH s AS (SELECT 'S' || p_partkey AS id, 'F' || (p_size % 10) AS name, 'N.' || replace(p_brand, '#', '') AS container, split_part(p_type, ' ', 1) AS a, split_part(p_type, ' ', 3) AS b, p_partkey % 5 = 0 AS field FROM part),
 q AS (SELECT DISTINCT replace(p_brand, '#', '') || '.F' || (p_size % 10) || '(List<' || split_part(p_type, ' ', 1) || '>, ' || split_part(p_type, ' ', 3) || ')' AS asked, 'F' || (p_size % 10) AS name, 'N.' || replace(p_brand, '#', '') AS container, split_part(p_type, ' ', 1) AS a, split_part(p_type, ' ', 3) AS b FROM part),
 h AS (SELECT q.asked, s.id FROM q LEFT JOIN s ON s.name = q.name AND s.container = q.container AND s.a = q.a AND s.b = q.b AND NOT s.field)
 SELECT asked, CASE count(id) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status, count(id) AS n, coalesce(array_to_string(list_sort(list(id) FILTER (id IS NOT NULL))[1:10], ','), '') AS ids FROM h GROUP BY asked""")
def resolution_of_overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with parameter lists, among symbols of which hundreds share a name."""
    part = table(spark, sf_dir, "part")
    word = lambda i: F.split_part("p_type", F.lit(" "), F.lit(i))
    brand, name = F.replace("p_brand", F.lit("#"), F.lit("")), _text("F", F.col("p_size") % 10)
    parameters = F.when(F.col("p_partkey") % 5 != 0, F.array(_text("X.Y.List<X.", word(1), ">"), word(3)))
    symbols = part.select(_text("S", F.col("p_partkey")).alias("id"), name.alias("name"), _text("N.", brand).alias("container"), parameters.alias("parameters"))
    asked = part.select(_text(brand, ".", name, "(List<", word(1), ">, ", word(3), ")").alias("q"))
    return joins.resolve_overloads(asked, symbols, "q")
