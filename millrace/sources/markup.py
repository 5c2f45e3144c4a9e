"""Markup and component files as rows: elements with their lines, paths and attributes, read from the texts.

Spark's XML reader keeps no places, so each text is scanned where it is read: from one opening character to the next, in Arrow batches, with no
shuffle.  A text is read once from left to right whatever it holds, and what is kept of it is its elements.

``markup`` takes XML: a text that is not well formed gives no elements and one row that says where it broke.  ``components`` takes component files
(elements with ``@`` code between them) and web pages: nothing is refused, and what does not fit together is an issue.

Defined results
---------------
* a null text is the empty one: not well formed as markup, without rows as a component; repeated rows give their elements again;
* lines count from 1; a carriage return ends a line in markup, as XML has it, and only a line feed does in components;
* an element without an end, a tag or a quote that never closes reaches to the end of the text (components);
* a path names elements from the root, with their place among like ones: ``Grid/Button[1]``; of more than ``MOST_SEGMENTS`` it keeps the last
  ones, after ``...``; ``node`` and ``parent`` (places in the text from 1, 0 for none) tell the tree whatever its depth.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx

MOST_SEGMENTS = 256
#: Rows of an Arrow batch that goes out.
_BATCH = 4096

# Endings of markup and component files, words after ``@``, and elements without an end or whose end may lack.
MARKUP_ENDINGS = (".xaml", ".axaml", ".paml")
COMPONENT_ENDINGS = (".razor", ".cshtml")
DIRECTIVES = "page using inject inherits implements layout namespace attribute typeparam rendermode model addTagHelper removeTagHelper tagHelperPrefix preservewhitespace".split()
BLOCKS = "code functions".split()
STATEMENTS = "if else for foreach while switch do try catch finally lock await section".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPTIONAL_END = frozenset("p li td tr th tbody thead tfoot option dt dd colgroup".split())


class _Lines:
    """Lines of places in a text that only move on."""

    def __init__(self, text: str):
        self.text, self.at, self.line = text, 0, 1

    def of(self, place: int) -> int:
        self.line += self.text.count("\n", self.at, place)
        self.at = place
        return self.line


def _path(segments: list[str]) -> str:
    return "/".join(segments) if len(segments) <= MOST_SEGMENTS else "/".join(["...", *segments[-MOST_SEGMENTS:]])


# ---------------------------------------------------------------- markup

_NAME = r"[A-Za-z_\x80-\U0010ffff][-.\w\x80-\U0010ffff]*+(?::[A-Za-z_\x80-\U0010ffff][-.\w\x80-\U0010ffff]*+)?"
_START = re.compile(rf"<({_NAME})")
_ATTRIBUTE = re.compile(rf"""\s++({_NAME})\s*+=\s*+(?:"([^"<]*+)"|'([^'<]*+)')""")
_END = re.compile(rf"</({_NAME})\s*+>")
_REFERENCE = re.compile(r"&(?:(lt|gt|amp|quot|apos)|#([0-9]{1,7})|#x([0-9A-Fa-f]{1,6}));")
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
_CHARACTERS = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
_SKIPPED = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"))


class Malformed(ValueError):
    """Where and why a text is no markup."""

    def __init__(self, place: int, why: str):
        super().__init__(why)
        self.place, self.why = place, why


def _decoded(value: str, place: int) -> str:
    """Text of a value: its references resolved."""

    def one(m: re.Match) -> str:
        if m[1]:
            return _CHARACTERS[m[1]]
        code = int(m[2]) if m[2] else int(m[3], 16)
        if code > 0x10FFFF or _ILLEGAL.match(chr(code)):
            raise Malformed(place, f"{m[0]} is no character")
        return chr(code)

    if "&" in _REFERENCE.sub("", value):
        raise Malformed(place, "an ampersand begins no known reference")
    return _REFERENCE.sub(one, value)


class _Element:
    __slots__ = ("attributes", "bound", "line", "name", "parent", "qualified", "written")

    def __init__(self, written: str, parent: int, line: int):
        self.written, self.parent, self.line = written, parent, line
        self.name, self.qualified = written, ("", written)
        self.bound: dict[str, str] | None = None
        self.attributes: dict[str, str] = {}


def scan_markup(text: str) -> list[tuple]:
    """(node, parent, line, name, path, attributes) of the elements of an XML text; ``Malformed`` if it is not well formed."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if bad := _ILLEGAL.search(text):
        raise Malformed(bad.start(), "a character that markup can't hold")
    lines, elements, open_ = _Lines(text), [], []
    spaces: list[dict[str, str]] = [{"xml": "xml", "": ""}]
    at = 0
    while (place := text.find("<", at)) >= 0:
        _check_text(text, at, place, bool(open_))
        for begin, end in _SKIPPED:
            if text.startswith(begin, place):
                if begin == "<![CDATA[" and not open_:
                    raise Malformed(place, "text outside of the root")
                if begin == "<?" and re.compile(r"<\?xml\b", re.IGNORECASE).match(text, place) and place:
                    raise Malformed(place, "the declaration is not at the beginning")
                at = text.find(end, place + len(begin)) + len(end)
                if at < len(end):
                    raise Malformed(place, f"{begin} is never closed")
                if begin == "<!--" and "--" in text[place + 4 : at - 3]:
                    raise Malformed(place, "two hyphens in a comment")
                break
        else:
            if text.startswith("<!DOCTYPE", place):
                if elements:
                    raise Malformed(place, "a document type after the root")
                at = _after_doctype(text, place)
            elif m := _END.match(text, place):
                if not open_ or elements[open_[-1]].written != m[1]:
                    raise Malformed(place, f"</{m[1]}> closes nothing")
                open_.pop()
                spaces.pop()
                at = m.end()
            elif m := _START.match(text, place):
                if elements and not open_:
                    raise Malformed(place, "a second root")
                parent = open_[-1] + 1 if open_ else 0
                element = _Element(m[1], parent, lines.of(place))
                at, empty = _attributes(text, m.end(), element, spaces)
                elements.append(element)
                if empty:
                    spaces.pop()
                else:
                    open_.append(len(elements) - 1)
            else:
                raise Malformed(place, "a tag without a name")
    _check_text(text, at, len(text), False)
    if open_:
        raise Malformed(len(text), f"<{elements[open_[-1]].written}> is never closed")
    if not elements:
        raise Malformed(len(text), "there is no root")
    return _placed(elements)


def _check_text(text: str, at: int, end: int, inside: bool) -> None:
    between = text[at:end]
    if not inside:
        if between.strip(" \t\n"):
            raise Malformed(at, "text outside of the root")
        return
    if "]]>" in between:
        raise Malformed(at, "]]> in a text")
    if "&" in between:
        _decoded(between, at)


def _after_doctype(text: str, place: int) -> int:
    """Past a document type; what it declares is not taken up."""
    depth = 0
    for m in re.compile(r"""[\[\]>]|"[^"]*+"|'[^']*+'""").finditer(text, place):
        depth += {"[": 1, "]": -1}.get(m[0], 0)
        if m[0] == ">" and depth <= 0:
            return m.end()
    raise Malformed(place, "<!DOCTYPE is never closed")


def _attributes(text: str, at: int, element: _Element, spaces: list[dict[str, str]]) -> tuple[int, bool]:
    """Take up the attributes of a tag and its namespaces: (place after it, whether it is empty)."""
    found: list[tuple[str, str]] = []
    while m := _ATTRIBUTE.match(text, at):
        raw = m[2] if m[2] is not None else m[3]
        found.append((m[1], _decoded(raw.replace("\t", " ").replace("\n", " "), at)))
        at = m.end()
    closing = re.compile(r"\s*+(/?)>").match(text, at)
    if closing is None:
        raise Malformed(at, f"the tag <{element.written} is not well formed")
    scope = spaces[-1]
    declared = {k[6:]: v for k, v in found if k == "xmlns" or k.startswith("xmlns:")}
    if declared:
        if any(k in ("xml", "xmlns") and not (k == "xml" and v == "http://www.w3.org/XML/1998/namespace") or (k and not v) for k, v in declared.items()):
            raise Malformed(at, "a namespace that can't be declared")
        scope = {**scope, **declared}
    spaces.append(scope)
    names = [("", k) if ":" not in k else tuple(k.split(":", 1)) for k, _ in found]
    own = ("", element.written) if ":" not in element.written else tuple(element.written.split(":", 1))
    for prefix, local in [own, *(n for n in names if n[0] != "xmlns")]:
        if prefix not in scope and prefix:
            raise Malformed(at, f"the prefix of {prefix}:{local} is not declared")
    for group in (found, [(scope.get(p, p), n) for p, n in names if p and p != "xmlns"]):
        if len({x[0] if group is found else x for x in group}) < len(group):
            raise Malformed(at, "an attribute twice")
    element.name, element.qualified = own[1], (scope.get(own[0], ""), own[1])
    for (_, local), (_, value) in zip(names, found, strict=True):
        element.attributes.setdefault(local, value)
    return closing.end(), closing[1] == "/"


def _placed(elements: list[_Element]) -> list[tuple]:
    alike = Counter((e.parent, e.qualified) for e in elements)
    seen: Counter = Counter()
    out, chain = [], []
    depths = [0]
    for node, e in enumerate(elements, 1):
        key = (e.parent, e.qualified)
        segment = f"{e.name}[{seen[key]}]" if alike[key] > 1 and e.parent else e.name
        seen[key] += 1
        depth = depths[e.parent]
        depths.append(depth + 1)
        del chain[depth:]
        chain.append(segment)
        out.append((node, e.parent, e.line, e.name, _path(chain), e.attributes))
    return out


# ---------------------------------------------------------------- components

_OPENING = re.compile(r"[<@]")
_TAG_NAME = re.compile(r"[^\W]?[\w.:-]*+")
_WORD = re.compile(r"\w*+")
_ATTRIBUTE_NAME = re.compile(r"\s*+([^\s=>/]*+)")
_BARE = re.compile(r"[^\s>]*+")
_QUOTED_STOP = {'"': re.compile(r'"|@\('), "'": re.compile(r"'|@\(")}
_CHAIN = re.compile(r"[\w.]*+")
_LITERAL = r"""//[^\n]*+|/\*(?s:.*?)(?:\*/|\Z)|@"(?:[^"]++|"")*+(?:"|\Z)|"(?:[^"\\]++|\\(?s:.))*+(?:"|\Z|\\\Z)|'(?:[^'\\]++|\\(?s:.))*+(?:'|\Z|\\\Z)"""
_BRACKETS = {"(": re.compile(_LITERAL + r"|[()]"), "{": re.compile(_LITERAL + r"|[{}]")}


def _balanced(text: str, at: int) -> int:
    """Past the bracket that closes the one at ``at``, or the end of the text."""
    depth = 0
    for m in _BRACKETS[text[at]].finditer(text, at):
        if m[0] in "({":
            depth += 1
        elif m[0] in ")}":
            depth -= 1
            if not depth:
                return m.end()
    return len(text)


class _Components:
    """One pass over a component text; ``rows`` gets (kind, line, name, text, node, parent, path, self_closing, attributes)."""

    def __init__(self, text: str):
        self.text, self.lines = text, _Lines(text)
        self.rows: list[tuple] = []
        self.issues: list[tuple[int, str]] = []
        #: Open elements: (tag in lower case, tag, line, node, children seen by name), and how many are open of a tag.
        self.open: list[tuple[str, str, int, int, Counter]] = []
        self.segments: list[str] = []
        self.opened: Counter = Counter()
        self.roots: Counter = Counter()
        self.nodes = 0

    def run(self) -> list[tuple]:
        text, at = self.text, 0
        while m := _OPENING.search(text, at):
            at = self._markup(m.start()) if m[0] == "<" else self._code(m.start())
        for lower, tag, line, *_ in self.open:
            if lower not in OPTIONAL_END:
                self.issues.append((line, f"<{tag}> is never closed"))
        return self.rows + [("issue", line, None, what, None, None, None, None, []) for line, what in self.issues]

    def _past(self, end: str, at: int) -> int:
        found = self.text.find(end, at)
        return len(self.text) if found < 0 else found + len(end)

    def _say(self, kind: str, at: int, name: str | None, text: str) -> None:
        self.rows.append((kind, self.lines.of(at), name, text, None, None, None, None, []))

    # -- between ``@`` and what ends it

    def _code(self, at: int) -> int:
        text, after = self.text, self.text[at + 1 : at + 2]
        if after == "@":
            return at + 2
        if after == "*":
            return self._past("*@", at)
        if after == "(":
            return self._expression(at, _balanced(text, at + 1))
        if after == "{":
            return self._block("{", at, at + 1)
        word = _WORD.match(text, at + 1)[0]
        after = at + 1 + len(word)
        if not word:
            return at + 1
        if word in BLOCKS:
            return self._block(word, at, after)
        if word in DIRECTIVES and not (word == "using" and text[after:].lstrip(" \t")[:1] == "("):
            end = text.find("\n", after)
            end = len(text) if end < 0 else end
            self._say("directive", at, word, text[after:end].strip())
            return end
        if word in STATEMENTS:
            return after
        end = _CHAIN.match(text, at + 1).end()
        return self._expression(at, _balanced(text, end) if text[end : end + 1] == "(" else end)

    def _expression(self, at: int, end: int) -> int:
        self._say("expression", at, None, self.text[at:end])
        return end

    def _block(self, word: str, at: int, after: int) -> int:
        begin = self.text.find("{", after)
        if begin < 0:
            return after
        end = _balanced(self.text, begin)
        self._say("block", at, word, self.text[begin + 1 : max(end - 1, begin + 1)])
        return end

    # -- between ``<`` and ``>``

    def _markup(self, at: int) -> int:
        text = self.text
        if text.startswith("<!--", at):
            return self._past("-->", at)
        if text.startswith("<!", at):
            return self._past(">", at)
        if text.startswith("</", at):
            return self._close(at)
        tag = _TAG_NAME.match(text, at + 1)[0]
        return self._element(tag, at) if tag else at + 1

    def _close(self, at: int) -> int:
        tag = _TAG_NAME.match(self.text, at + 2)[0]
        lower = tag.lower()
        line = self.lines.of(at)
        if not self.opened[lower]:
            self.issues.append((line, f"</{tag}> closes nothing"))
        else:
            gone = None
            while gone != lower:
                gone = self.open.pop()[0]
                self.segments.pop()
                self.opened[gone] -= 1
        return self._past(">", at)

    def _element(self, tag: str, at: int) -> int:
        line = self.lines.of(at)
        counts = self.open[-1][4] if self.open else self.roots
        segment = f"{tag}[{counts[tag]}]" if counts[tag] else tag
        counts[tag] += 1
        self.nodes += 1
        end, attributes = self._given(at + 1 + len(tag))
        closed = self.text[end : end + 1] == "/"
        end += closed
        end += self.text[end : end + 1] == ">"
        self.rows.append(("element", line, tag, None, self.nodes, self.open[-1][3] if self.open else 0, _path([*self.segments[-MOST_SEGMENTS:], segment]), closed, attributes))
        if not closed and tag.lower() not in VOID:
            self.open.append((tag.lower(), tag, line, self.nodes, Counter()))
            self.segments.append(segment)
            self.opened[tag.lower()] += 1
        return end

    def _given(self, at: int) -> tuple[int, list[tuple[str, str, int]]]:
        """(place after the attributes, [(name, value, line)]); they end at a slash, a closing bracket, or an equals sign without a name."""
        text, out = self.text, []
        while True:
            m = _ATTRIBUTE_NAME.match(text, at)
            at, name, begin = m.end(), m[1], m.start(1)
            if not name:
                return at + (text[at : at + 1] == "="), out
            line, value = self.lines.of(begin), ""
            if text[at : at + 1] == "=":
                quote = text[at + 1 : at + 2]
                if quote in _QUOTED_STOP:
                    end = self._quote_end(quote, at + 2)
                    value, at = text[at + 2 : end], min(end + 1, len(text))
                else:
                    end = _BARE.match(text, at + 1).end()
                    value, at = text[at + 1 : end], end
            out.append((name, value, line))

    def _quote_end(self, quote: str, at: int) -> int:
        """The quote that ends a value; code in brackets may hold quotes of its own."""
        while m := _QUOTED_STOP[quote].search(self.text, at):
            if m[0] == quote:
                return m.start()
            at = _balanced(self.text, m.end() - 1)
        return len(self.text)


def scan_components(text: str) -> list[tuple]:
    """(kind, line, name, text, node, parent, path, self_closing, attributes) of elements, directives, expressions, blocks and issues."""
    return _Components(text).run()


# ---------------------------------------------------------------- as frames


def _scanned(files: DataFrame, id_col: str, text_col: str, scan: Callable[[str], list[tuple]], fields: list[pa.Field], schema: str) -> DataFrame:
    """Rows of a scan of every text, with the id first."""
    source = files.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.schema([pa.field("_id", batch.schema.field(0).type), *fields])
            owners: list[int] = []
            rows: list[tuple] = []

            def made() -> pa.RecordBatch:
                ids = batch.column(0).take(pa.array(owners, pa.int64()))
                return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields))], schema=whole)

            for i in range(batch.num_rows):
                found = scan(batch.column(1)[i].as_py())
                for a in range(0, len(found), _BATCH):
                    part = found[a : a + _BATCH]
                    rows += part
                    owners += [i] * len(part)
                    if len(rows) >= _BATCH:
                        yield made()
                        rows, owners = [], []
            if rows:
                yield made()

    return source.mapInArrow(run, f"_id {kind}, {schema}").withColumnRenamed("_id", id_col)


def markup(files: DataFrame, id_col: str = "file", text_col: str = "text") -> DataFrame:
    """(file, parsed, problem, node, parent, line, type_name, key, name, path, uid, attributes) of markup texts.

    A text that is not well formed has one row: not ``parsed``, its line and the ``problem``.  Names are local ones; of attributes that share a
    local name the first counts.
    """

    def scan(text: str) -> list[tuple]:
        try:
            found = scan_markup(text)
        except Malformed as e:
            plain = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
            return [(False, e.why, None, None, plain.count("\n", 0, e.place) + 1, None, None, None, None, None, [])]
        return [(True, None, node, parent, line, name, a.get("Key"), a.get("Name"), path, a.get("Uid"), list(a.items())) for node, parent, line, name, path, a in found]

    plain = [("problem", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("line", pa.int32()), *[(c, pa.string()) for c in ("type_name", "key", "name", "path", "uid")]]
    fields = [pa.field("parsed", pa.bool_()), *(pa.field(*x) for x in plain), pa.field("attributes", pa.map_(pa.string(), pa.string()))]
    schema = "parsed boolean, problem string, node int, parent int, line int, type_name string, key string, name string, path string, uid string, attributes map<string,string>"
    return _scanned(files, id_col, text_col, scan, fields, schema)


def components(files: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, kind, line, name, text, node, parent, node_path, self_closing, attributes) of component texts or pages; see ``scan_components``."""
    given = pa.list_(pa.struct([("name", pa.string()), ("expression", pa.string()), ("line", pa.int32())]))
    plain = [("kind", pa.string()), ("line", pa.int32()), ("name", pa.string()), ("text", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("node_path", pa.string()), ("self_closing", pa.bool_())]
    fields = [*(pa.field(*x) for x in plain), pa.field("attributes", given)]
    schema = "kind string, line int, name string, text string, node int, parent int, node_path string, self_closing boolean, attributes array<struct<name:string,expression:string,line:int>>"

    def scan(text: str) -> list[tuple]:
        return [(*row[:-1], [{"name": n, "expression": v, "line": at} for n, v, at in row[-1]]) for row in scan_components(text)]

    return _scanned(files, id_col, text_col, scan, fields, schema)


def markup_tables(files: DataFrame) -> dict[str, DataFrame]:
    """Tables of the markup questions from files (rel_path, text): ``elements`` and ``parsed`` (file, parsed, problem, line)."""
    of = files.where(tx.extension(F.col("rel_path")).isin(*MARKUP_ENDINGS)).select(F.col("rel_path").alias("file"), "text")
    found = markup(of)
    return {
        "elements": found.where("parsed").drop("parsed", "problem"),
        "parsed": found.where("not parsed or node = 1").select("file", "parsed", "problem", "line"),
    }


def component_tables(files: DataFrame) -> dict[str, DataFrame]:
    """Tables of the component questions from files (rel_path, text): nodes, directives, expressions, routes, issues and component_files."""
    of = files.where(tx.extension(F.col("rel_path")).isin(*COMPONENT_ENDINGS)).select(F.col("rel_path").alias("path"), "text")
    facts = components(of)
    only = lambda kind: facts.where(F.col("kind") == kind)
    component = F.regexp_extract("path", r"([^/\\]*)\.[^.]*$", 1)
    directives = only("directive").select("path", "line", "name", F.col("text").alias("value"))
    issues = only("issue").select("path", "line", F.col("text").alias("problem"))
    held = of.select("path", component.alias("component")).join(issues.select("path", F.lit(True).alias("malformed")).distinct(), "path", "left")
    return {
        "nodes": only("element").select("path", "line", F.col("name").alias("tag"), "node_path", F.col("name").rlike(r"^\p{Lu}").alias("is_component"), "attributes", "node", "parent"),
        "directives": directives,
        "expressions": only("expression").select("path", "line", "text"),
        "routes": directives.where(F.col("name") == "page").select("path", component.alias("component"), F.regexp_replace("value", '^"|"$', "").alias("route")),
        "issues": issues,
        "component_files": held.select("path", "component", F.coalesce("malformed", F.lit(False)).alias("malformed")),
    }
