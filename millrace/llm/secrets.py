"""Secret scanning with multipart credential linking.

Three kinds of strong spans are found by pattern: ``assign``, ``access`` and ``hex``.  A credential often
comes in parts that are weak evidence alone: an access identifier, a secret string and the endpoint they open.  The
text is cut into *scopes* (unbroken paragraphs), and the parts are joined with the scopes as intervals: two parts are linked if they lie
in one scope, however far apart.  A weak part is reported only if a complementary part is linked to it: a bare secret needs an
identifier, an identifier needs a secret, an endpoint needs both.

No part has a line break in it, so it lies in one scope, found by a binary search; the join is linear in parts and no pairs are made.

Defined results
---------------
* null text is the empty text: no spans;
* very long texts are scanned whole;
* ties: spans are ordered by start, then by kind in the order of ``KINDS``;
* each row is scanned alone, repeated rows alike;
* extra columns pass through; an input column named like a result is replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "identifier", "bare_secret", "endpoint")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_IDENTIFIER = re.compile(r"""\b(?:access_?key(?:_?id)?|client_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})""", re.IGNORECASE | re.ASCII)
#: An unbroken key of any length, in either alphabet of base64; ``_mixed`` looks at its characters.
_BARE = re.compile(r"(?<![A-Za-z0-9+/=_-])(?:[A-Za-z0-9+/]{32,}+|[A-Za-z0-9_-]{32,}+)={0,2}+(?![A-Za-z0-9+/=_-])")
_MIXED = (re.compile("[0-9]"), re.compile("[A-Z]"), re.compile("[a-z]"))
_ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+")
_BREAK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The strong spans, leftmost and non-overlapping within each kind."""
    spans: list[Span] = []
    if ":" in text or "=" in text:
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return spans


def _reach(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Begins in order and, for each, the greatest end so far."""
    ordered = sorted(spans, key=lambda s: s[1])
    ends: list[int] = []
    for s in ordered:
        ends.append(max(ends[-1], s[2]) if ends else s[2])
    return [s[1] for s in ordered], ends


def _linked(spans: list[Span], others: list[Span], scopes: list[int]) -> list[Span]:
    """Those ``spans`` that have one of the ``others`` in their scope; ``scopes`` are the starts of all scopes but the first."""
    held = {bisect_right(scopes, s[1]) for s in others}
    return [s for s in spans if bisect_right(scopes, s[1]) in held]


def _mixed(text: str, start: int, end: int) -> bool:
    """Whether digits, capitals and small letters are all there."""
    return all(kind.search(text, start, end) for kind in _MIXED)


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """The weak spans that complementary parts support."""
    if not base and "=" not in text and ":" not in text:
        return []
    access = [s for s in base if s[0] == "access"]
    begins, reached = _reach(base)

    def free(found: list[Span]) -> list[Span]:
        """Those that no strong span overlaps."""
        return [s for s in found if not (at := bisect_left(begins, s[2])) or reached[at - 1] <= s[1]]

    bare = free([("bare_secret", m.start(), m.end()) for m in _BARE.finditer(text) if _mixed(text, *m.span())])
    names = free([("identifier", m.start(1), m.end(1)) for m in _IDENTIFIER.finditer(text)]) if "=" in text or ":" in text else []
    secrets = [s for s in base if s[0] != "access"] + bare
    identifiers = access + names
    if not secrets or not identifiers:
        return []
    scopes = [m.end() for m in _BREAK.finditer(text)]
    bare = _linked(bare, identifiers, scopes)
    strong = [s for s in base if s[0] != "access"] + bare
    names = _linked(names, strong, scopes)
    ends = free([("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]) if "://" in text else []
    ends = _linked(_linked(ends, strong, scopes), access + names, scopes)
    return bare + names + ends


_ORDER = {k: i for i, k in enumerate(KINDS)}


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2])))


_SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(docs: DataFrame, text_col: str = "text", redact_to: str | None = None) -> DataFrame:
    """``docs`` with ``secret_spans``: kind, start and end (code points, end exclusive), by start.

    With ``redact_to``, the text of every span is replaced by that string as well (overlapping spans as one).
    """
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        spans, texts = [], []
        for value in batch.column(at):
            text = value.as_py() or ""
            base = base_spans(text)
            every = sorted(base + linked_spans(text, base), key=lambda s: (s[1], _ORDER[s[0]], s[2]))
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in every])
            if redact_to is not None:
                texts.append(redacted(text, every, redact_to) if every else value.as_py())
        if redact_to is not None:
            batch = batch.set_column(at, text_col, pa.array(texts, batch.schema.field(at).type))
        return common.append_columns(batch, ["secret_spans"], [pa.array(spans, arrow)])

    return common.map_arrow(docs, kernel, common.with_outputs(docs, [T.StructField("secret_spans", _SPAN_TYPE)]))


def redacted(text: str, spans: list[Span], mark: str) -> str:
    out, done = [], 0
    for _, a, b in spans:
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join(out) + text[done:]


def digest(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with span counts of the base kinds, their digest and all spans as text."""
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    fields = [T.StructField(n, T.LongType()) for n in names[:3]] + [T.StructField(n, T.StringType()) for n in names[3:]]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[], [], []]
        sums, alls = [], []
        for value in batch.column(batch.schema.get_field_index(text_col)):
            text = value.as_py() or ""
            base = base_spans(text)
            for kind, out in zip(BASE_KINDS, counts, strict=True):
                out.append(sum(s[0] == kind for s in base))
            sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
            alls.append(joined(base + linked_spans(text, base)))
        out = common.append_columns(batch, names, [*(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(alls, pa.string())])
        return out.drop_columns([text_col])

    schema = common.with_outputs(docs, fields)
    return common.map_arrow(docs, kernel, T.StructType([f for f in schema.fields if f.name != text_col]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(docs.select("doc_id", F.col("text")))
