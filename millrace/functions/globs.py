"""Globs over paths: ``**/``, ``**``, ``*`` and ``?``; case-insensitive and anchored."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import InvalidQuery
from millrace.functions import text


def pattern(glob: str) -> str:
    """The regular expression of a glob; braces are refused, not guessed at."""
    if not glob or not glob.strip():
        raise InvalidQuery("the glob is blank", "name a pattern such as **/*.txt")
    if "{" in glob or "}" in glob:
        raise InvalidQuery(f"braces are not supported in {glob!r}", "ask once for each alternative")
    glob = glob.replace("\\", "/")
    out, i = [], 0
    while i < len(glob):
        for sign, meaning in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(sign, i):
                out.append(meaning)
                i += len(sign)
                break
        else:
            out.append(re.escape(glob[i]) if not glob[i].isalnum() and glob[i] != "_" else glob[i])
            i += 1
    return "(?i)^" + "".join(out) + "$"


def matches(path: Column, glob: str) -> Column:
    """A glob without a separator is held against the file name, one with a separator against the whole path."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return (path if "/" in glob.replace("\\", "/") else text.file_name(path)).rlike(pattern(glob))
