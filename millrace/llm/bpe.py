"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at *safe boundaries*: a place between a letter and a space or line feed, across
which no match of the split pattern reaches, so encoding the parts gives the ids of the whole.  A single match of many
thousand bytes (which no boundary can cut) is merged by a heap instead of the library's quadratic loop.
Decoding joins the raw bytes of the ids.

Defined results
---------------
* null text encodes like the empty text: no ids, decoded to no bytes; a null id list decodes to null;
* an id outside the rank file makes decoding fail with ``KeyError``;
* each row is coded alone, so ties and repeated rows need no rule;
* extra columns pass through; an input column named like a result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.llm import common

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Characters from which on a text is cut before encoding, and bytes from which on a match is merged by the heap.
LONG_TEXT = 1 << 16
LONG_MATCH = 1 << 12

_SAFE = regex.compile(r"(?<=\p{L})(?=[ \n])")


class BpeCodec:
    """Encoder and decoder of one rank file."""

    def __init__(self, rank_path: str, pattern: str):
        with open(rank_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.digits = {rank: str(rank) for rank in self.bytes_of}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= LONG_TEXT:
            return self._encode_part(text)
        ids: list[int] = []
        start = 0
        while start < len(text):
            cut = _SAFE.search(text, min(len(text), start + LONG_TEXT))
            end = cut.start() if cut else len(text)
            ids += self._encode_part(text[start:end])
            start = end
        return ids

    def _encode_part(self, text: str) -> list[int]:
        if len(text) < LONG_MATCH or not regex.search(r"\S{%d}|\s{%d}" % (LONG_MATCH // 4, LONG_MATCH // 4), text):
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for m in self.pattern.finditer(text):
            piece = m.group().encode()
            ids += self.encoding.encode_ordinary(m.group()) if len(piece) < LONG_MATCH and self._alone(m.group()) else self._merge(piece)
        return ids

    def _alone(self, match: str) -> bool:
        """Whether the pattern takes ``match`` as one piece also when it stands alone."""
        first = self.pattern.match(match)
        return first is not None and first.end() == len(match)

    def _merge(self, piece: bytes) -> list[int]:
        """Merge lowest rank first, leftmost among equals, in O(n log n)."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        end = list(range(1, n + 1))
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if not alive[i] or end[i] != middle or j >= n or end[j] != stop:
                continue
            end[i], alive[j] = stop, False
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := self.ranks.get(piece[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[right[i]]))
            if left[i] >= 0 and (r := self.ranks.get(piece[left[i] : stop])) is not None:
                heapq.heappush(heap, (r, left[i], i, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = right[i]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str | None, str | None], BpeCodec] = {}


def codec(rank_path: str | None = None, pattern: str | None = None) -> BpeCodec:
    """The codec of a rank file on this machine; the public file and its pattern if none is named."""
    key = (rank_path, pattern)
    if key not in _CODECS:
        import public_tokenizers

        _CODECS[key] = BpeCodec(rank_path or public_tokenizers.path(RANK_FILE), pattern or public_tokenizers.PATTERN)
    return _CODECS[key]


def encode(docs: DataFrame, text_col: str = "text", rank_path: str | None = None, pattern: str | None = None, verify: bool = False) -> DataFrame:
    """``docs`` with ``token_ids`` (array of int) and ``n_tokens``.

    With ``verify``, each id list is decoded at once, and ``round_trip`` tells whether that gives the text's bytes.
    """
    names = ["token_ids", "n_tokens"] + ["round_trip"] * verify
    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())] + [T.StructField("round_trip", T.BooleanType())] * verify

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(rank_path, pattern)
        ids, same = [], []
        for value in batch.column(batch.schema.get_field_index(text_col)):
            text = value.as_py()
            own = c.encode(text)
            ids.append(np.array(own, np.int32))
            if verify:
                same.append(c.decode(own) == (text or "").encode())
        columns = [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())] + [pa.array(same, pa.bool_())] * verify
        return common.append_columns(batch, names, columns)

    return common.map_arrow(docs, kernel, common.with_outputs(docs, fields), sliced_by=text_col)


def decode(tokens: DataFrame, ids_col: str = "token_ids", rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``tokens`` with ``decoded`` (binary): the raw bytes of each id list."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(rank_path, pattern)
        found = [None if x is None else c.decode(x) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
        return common.append_columns(batch, ["decoded"], [common.binary_array(found)])

    return common.map_arrow(tokens, kernel, common.with_outputs(tokens, [T.StructField("decoded", T.BinaryType())]), sliced_by=ids_col)


def round_trip(docs: DataFrame, text_col: str = "text", rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` without its text, with ``n_tokens`` and digests of the ids and of the bytes they decode to.

    Encodes, then decodes the ids in the same pass, so that neither ids nor bytes travel.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(rank_path, pattern)
        counts, id_sums, byte_sums = [], [], []
        for text in batch.column(batch.schema.get_field_index(text_col)):
            ids = c.encode(text.as_py())
            counts.append(len(ids))
            id_sums.append(hashlib.sha256(",".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
            byte_sums.append(hashlib.sha256(c.decode(ids)).hexdigest())
        out = common.append_columns(batch, names, [pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(byte_sums, pa.string())])
        return out.drop_columns([text_col])

    schema = common.with_outputs(docs, fields)
    return common.map_arrow(docs, kernel, T.StructType([f for f in schema.fields if f.name != text_col]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs.select("doc_id", "text"))
