"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_any(c: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` strips only spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def cut(c: Column, most: int = 200) -> Column:
    """At most ``most`` characters; what is cut is told: ``... (+n chars)``."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("... (+"), (F.length(c) - most).cast("string"), F.lit(" chars)"))).otherwise(c)


def collapse(c: Column, most: int = 160) -> Column:
    """White space runs as one space, cut hard at ``most``."""
    return F.left(F.regexp_replace(trim_any(c), r"(?U)\s+", " "), F.lit(most))


def unified_endings(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def dominant_ending(c: Column) -> Column:
    """The more frequent of CRLF and LF; LF where they tie."""
    crlf = F.regexp_count(c, F.lit("\r\n"))
    return F.when(crlf > F.regexp_count(c, F.lit("\n")) - crlf, "\r\n").otherwise("\n")


def contains_ci(c: Column, needle: str) -> Column:
    return F.contains(F.lower(c), F.lit(needle.lower()))


def last_segment(c: Column, separator: str = ".") -> Column:
    return F.substring_index(c, separator, -1)


def is_suffix_of(name: Column, dotted: Column) -> Column:
    """``name`` equals the dotted name or is a whole-segment suffix of it."""
    return (dotted == name) | F.endswith(dotted, F.concat(F.lit("."), name))


def placeholders(c: Column) -> Column:
    """Distinct indices of ``{n}``, ``{n,width}`` and ``{n:format}`` in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\{(\d+)(?:[,:][^}]*)?\}"), F.lit(1)), lambda x: x.cast("int")))


def identifiers(c: Column) -> Column:
    """Distinct identifier tokens, and the parts of dotted ones."""
    dotted = F.regexp_extract_all(c, F.lit(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"), F.lit(0))
    return F.array_distinct(F.concat(dotted, F.flatten(F.transform(dotted, lambda x: F.split(x, r"\.")))))


def is_identifier(c: Column) -> Column:
    return c.rlike(r"^[\p{L}_][\p{L}\p{Nd}_]*$")


def occurrences(c: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def occurrence_offset(c: Column, needle: str, nth: int) -> Column:
    """Offset from 0 of the nth non-overlapping occurrence, -1 if there are fewer."""
    lead = F.substring_index(c, needle, nth)
    return F.when(occurrences(c, needle) >= nth, F.length(lead)).otherwise(-1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def utc_stamp(c: Column) -> Column:
    """A timestamp as ``2024-01-31T09:05:00Z``, whatever the zone of the session; null stays null."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def duration_ms(c: Column) -> Column:
    """Milliseconds of ``hh:mm:ss.fffffff``; 0 where it cannot be read."""
    part = lambda i, kind: F.regexp_extract(c, r"^(\d+):(\d+):(\d+(?:\.\d+)?)$", i).try_cast(kind)
    return F.coalesce(F.floor((part(1, "long") * 3600 + part(2, "long") * 60) * 1000 + part(3, "decimal(20,9)") * 1000), F.lit(0)).cast("long")


def entity_decoded(c: Column) -> Column:
    """The five named character entities decoded, ``&amp;`` last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def dedented(lines: Column) -> Column:
    """Lines without the indent that all non-blank ones share."""
    indent = F.array_min(F.transform(F.filter(lines, lambda x: x.rlike(r"\S")), lambda x: F.length(x) - F.length(F.ltrim(x))))
    return F.transform(lines, lambda x: F.substr(x, F.coalesce(indent, F.lit(0)) + 1))


def common_prefix(first: Column, last: Column) -> Column:
    """Longest common prefix of two strings; of the least and greatest name of a set, that of the whole set."""
    n = F.least(F.length(first), F.length(last))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.left(first, k) == F.left(last, k))
    return F.left(first, F.array_max(same))


def arguments(c: Column) -> Column:
    """Comma-separated arguments, split only where no bracket is open: ``A<B,C>, D[,]`` has two."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        cut = (x == ",") & (acc["depth"] == 0)
        depth = acc["depth"] + F.when(x.isin("<", "(", "[", "{"), 1).when(x.isin(">", ")", "]", "}"), -1).otherwise(0)
        return F.struct(
            depth.alias("depth"),
            F.when(cut, F.lit("")).otherwise(F.concat(acc["now"], x)).alias("now"),
            F.when(cut, F.array_append(acc["done"], F.trim(acc["now"]))).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, step, lambda acc: F.array_append(acc["done"], F.trim(acc["now"])))
