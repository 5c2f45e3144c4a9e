"""URL rules by a bit-parallel wildcard automaton.

All glob rules are packed side by side into multiword Shift-And masks: one bit per pattern symbol.  The
automaton reads the *canonical URL* (host with A-Z lower-cased, path, and what remains of the query once tracking
parameters are gone; the fragment is dropped) and advances every rule on every URL of a batch with a few word
operations per byte.  In a glob, ``**`` stands for any bytes, ``*`` for bytes other than ``/ ? #``, ``?`` for one byte.

A host rule such as ``org/`` becomes the globs ``org/**`` and ``*.org/**``: it fits the host and all its subdomains if the
path starts with the rule's.  The longest fitting host rule wins; where none fits, a URL that matches
a block glob is blocked and any other is allowed.

Defined results
---------------
* null URL, or one without ``://``: host, path and canonical URL are empty; no rule fits; the verdict is ``allow``;
* very long URLs are read whole; ties between rules of one length go to the one named first;
* each row is judged alone, repeated rows alike;
* extra columns pass through; an input column named like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common

#: (action, host, path); the rules of the public query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Globs over the canonical URL that block where no rule fits.
BLOCK_GLOBS = ("**cheap-pills**", "**spam-farm**", "*casino*/**", "*.click/**", "**/wp-login.php**", "**.exe", "**/ads/**")

TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


@dataclass
class GlobAutomaton:
    """Packed masks of a list of globs; ``accept[i]`` is (word, bit) of the state in which glob i has matched."""

    words: int
    symbol: np.ndarray  # (256, words): states that a byte may enter
    loop: np.ndarray  # (256, words): states that a byte may stay in
    start: np.ndarray  # (words,): states before the first byte
    skip: list[np.ndarray]  # closure steps over stars
    accept: list[tuple[int, int]]

    @classmethod
    def compile(cls, globs: list[str]) -> GlobAutomaton:
        parsed = [_symbols(g) for g in globs]
        total = sum(len(p) + 1 for p in parsed)
        bits = np.zeros((256, total), bool)
        loops = np.zeros((256, total), bool)
        start = np.zeros(total, bool)
        stars = np.zeros(total, bool)
        accept, at = [], 0
        for symbols in parsed:
            # State at + k: k symbols of this glob are behind.
            start[at] = True
            for k, (kind, byte) in enumerate(symbols):
                if kind == "byte":
                    bits[byte, at + k + 1] = True
                elif kind == "any":
                    bits[:, at + k + 1] = True
                else:
                    stars[at + k + 1] = True  # entered from its neighbour without a byte
                    loops[:, at + k + 1] = True
                    if kind == "star":
                        loops[[0x2F, 0x3F, 0x23], at + k + 1] = False
            at += len(symbols) + 1
            accept.append(((at - 1) // 64, (at - 1) % 64))
        words = max(1, -(-total // 64))
        longest = max((_run(stars)), default=0)
        return cls(words, _pack(bits, words), _pack(loops, words), _pack(start[None], words)[0], [_pack(stars[None], words)[0]] * longest, accept)

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(n, globs) bool: which globs match each whole string."""
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, size = offsets[:-1][order], lengths[order]
        state = self._closed(np.repeat(self.start[None], n, axis=0))
        for step in range(int(size[0]) if n else 0):
            live = int(np.searchsorted(-size, -step, side="left"))
            byte = data[begin[:live] + step]
            now = state[:live]
            state[:live] = self._closed((_shift(now) & self.symbol[byte]) | (now & self.loop[byte]))
        out = np.empty((n, len(self.accept)), bool)
        for i, (word, bit) in enumerate(self.accept):
            out[order, i] = (state[:, word] >> np.uint64(bit)) & np.uint64(1) == 1
        return out

    def _closed(self, state: np.ndarray) -> np.ndarray:
        for stars in self.skip:
            state = state | (_shift(state) & stars)
        return state


def _symbols(glob: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    raw, i = glob.encode(), 0
    while i < len(raw):
        if raw[i : i + 2] == b"**":
            out.append(("all", 0))
            i += 2
        elif raw[i] == 0x2A:
            out.append(("star", 0))
            i += 1
        else:
            out.append(("any", 0) if raw[i] == 0x3F else ("byte", raw[i]))
            i += 1
    return out


def _run(flags: np.ndarray) -> list[int]:
    runs, now = [], 0
    for f in flags:
        now = now + 1 if f else 0
        runs.append(now)
    return runs


def _pack(bits: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros((len(bits), words * 64), bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64).reshape(len(bits), words)


def _shift(state: np.ndarray) -> np.ndarray:
    out = state << np.uint64(1)
    out[:, 1:] |= state[:, :-1] >> np.uint64(63)
    return out


def canonical_parts(url_col: str) -> tuple[F.Column, F.Column, F.Column]:
    """(host, path, canonical URL) of a URL column; all empty where there is no ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    wanted = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1), rf"(?:^|&){TRACKING}=[^&]*", "")
    wanted = F.regexp_replace(wanted, r"^&+", "")
    return host, path, F.concat(host, path, F.when(wanted != "", F.concat(F.lit("?"), wanted)).otherwise(F.lit("")))


def judge(pages: DataFrame, url_col: str = "url", rules: tuple = RULES, block_globs: tuple = BLOCK_GLOBS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``canonical``, ``rule`` and ``verdict``."""
    globs = [g for _, host, path in rules for g in (f"{host}{path}**", f"*.{host}{path}**")] + list(block_globs)
    automaton = GlobAutomaton.compile(globs)
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))
    names = ["host", "path", "canonical"]
    cols = dict(zip(names, canonical_parts(url_col), strict=True))
    prepared = pages.withColumns({f"_{n}": c for n, c in cols.items()})
    prepared = prepared.select(*[c for c in pages.columns if c not in names], *[F.col(f"_{n}").alias(n) for n in names])
    fields = [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = common.text_buffers(batch.column(batch.schema.get_field_index("canonical")))
        hits = automaton.match(data, offsets)
        fits = hits[:, 0 : 2 * len(rules) : 2] | hits[:, 1 : 2 * len(rules) : 2]
        blocked = hits[:, 2 * len(rules) :].any(axis=1)
        chosen = np.full(batch.num_rows, -1)
        for i in reversed(ranked):
            chosen[fits[:, i]] = i
        rule = [None if c < 0 else rules[c][1] + rules[c][2] for c in chosen]
        verdict = [("block" if b else "allow") if c < 0 else rules[c][0] for c, b in zip(chosen, blocked, strict=True)]
        return common.append_columns(batch, ["rule", "verdict"], [pa.array(rule, pa.string()), pa.array(verdict, pa.string())])

    return common.map_arrow(prepared, kernel, common.with_outputs(prepared, fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(regexp_replace(regexp_extract(r, '^[^?#]*\?([^#]*)', 1), '(?:^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS q
  FROM rest
), canon AS (
  SELECT page_id, host, path, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS c FROM parts
), rules(rule_action, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT page_id, rule_action, rule_host || rule_path AS rule,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, rule_host) AS rn
  FROM canon JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT canon.page_id, host, path, fit.rule AS rule,
  coalesce(fit.rule_action, CASE WHEN regexp_matches(c, 'cheap-pills|spam-farm|^[^/?#]*casino[^/?#]*/|^[^/?#]*\.click/|/wp-login\.php|\.exe$|/ads/') THEN 'block' ELSE 'allow' END) AS verdict
FROM canon LEFT JOIN fit ON canon.page_id = fit.page_id AND fit.rn = 1
"""
