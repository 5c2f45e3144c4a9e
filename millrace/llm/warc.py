"""WARC archives: writing, normalising monolithic gzip files to one member a record, and reading by offset.

``write`` streams the pages of a task into archives of at most about ``ROLL_BYTES``, each one gzip stream as a whole: compact, and unreadable but from its
start.  ``normalise`` inflates each such file once, as a stream, and writes every record as a gzip member of its own into a new archive, with a
sidecar index of offsets beside it; records are copied in pieces of ``PIECE``, so no record is held whole.  ``read`` takes index rows and inflates
just their members, in ranges that are dealt across files, so a large archive is read by many tasks.

A page whose payload is that of another is a *revisit*: it has the headers of the response and refers to it, and holds no payload.  Digests
are made where pages are read; only (digest, id) pairs are grouped.  Digests that occur again come back by a broadcast if they are
few; of more, those of very large groups (whose number the size of the table bounds) are broadcast and the others joined by digest.

Files are named after the attempt that wrote them and only those that finished attempts report are known, so a lost task leaves no trace.

Defined results
---------------
* a null payload is the empty one; pages that repeat with the smallest id of their payload are all responses; a page without an id never
  is the one referred to, and is a response only where no page with an id has its payload;
* payloads below ``least_bytes`` are all responses; control characters and spaces in urls are percent-encoded; a null url is left out;
* ``normalise`` takes archives of one member, of many, or of a member for each record; an empty file has no records; a file that is
  cut off or damaged keeps the whole records before that, and its index ends with a row whose ``error`` says where it broke;
* an empty table gives no archives and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: Bytes of records (not compressed) of one archive, about; bytes of a piece of a stream.
ROLL_BYTES = 256 << 20
PIECE = 1 << 20
#: Bytes of members that a reading task takes on average.
READ_BYTES = 16 << 20
#: Levels of compression: of the stream that is only passed on, and of the archive that stays.
STREAM_LEVEL, MEMBER_LEVEL = 1, 6
#: The date of all records, so that a rerun writes the same bytes.
DATE = "2000-01-01T00:00:00Z"
LEAST_BYTES = 0
#: Most digests that occur again that are broadcast, and rows from which on a group counts as very large.
MOST_BROADCAST = 500_000
LARGE_GROUP = 10_000
#: Longest header of a record.
MOST_HEADER = 1 << 20

INDEX = "file string, offset long, length long, record_id string, record_type string, target_uri string, payload_digest string, error string"
RECORD = "file string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_ID = "urn:x-page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, again: bool, date: str) -> bytes:
    """A response, or a revisit with the headers of the response and no payload; its block begins with HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if again else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if again:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Fields of a header by their lower-case name; the version line, or the HTTP status line, is ``''``."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    out = {"": first}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _bare(uri: str | None) -> str | None:
    return None if uri is None else uri.strip("<>")


# ---------------------------------------------------------------- writing


def marked(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int, most_broadcast: int = MOST_BROADCAST, large: int = LARGE_GROUP) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is null but for revisits."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    key = F.unhex(F.sha1("payload"))
    digests = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", key.alias("key"))
    again = common.materialise(digests.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()), "payload-digests")
    keyed = rows.withColumn("key", key).withColumn("_long", F.octet_length("payload") >= least_bytes)
    if again.count() <= most_broadcast:
        joined = keyed.join(F.broadcast(again.select("key", "first")), "key", "left")
    else:
        # A page moves to its digest only if its group is not one of the large ones, of which there are at most rows / large.
        hot = F.broadcast(again.where(F.col("n") >= large).select("key", F.col("first").alias("_hot")))
        parted = keyed.join(hot, "key", "left")
        rest = parted.where(F.col("_hot").isNull()).join(again.where(F.col("n") < large).select("key", "first"), "key", "left")
        joined = parted.where(F.col("_hot").isNotNull()).withColumn("first", F.col("_hot")).unionByName(rest)
    refers = F.when(F.col("_long") & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES, date: str = DATE, roll_bytes: int = ROLL_BYTES, **bounds: int) -> DataFrame:
    """Archives of the pages in a folder, each one gzip stream: (file, records, bytes)."""
    base = common.qualified(pages.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        store, place = common.open_store(name)
        files: list[tuple[str, int, int]] = []
        sink = packer = None
        held = records = 0

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.write(packer.flush())
                files.append((f"{name}-{len(files)}.warc.gz", records, sink.tell()))
                sink.close()
                sink = None

        for batch in batches:
            for part in common.slices(batch, "payload"):
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if sink is None:
                        store.create_dir(place.rpartition("/")[0], recursive=True)
                        sink, packer = store.open_output_stream(f"{place}-{len(files)}.warc.gz", compression=None), zlib.compressobj(STREAM_LEVEL, wbits=31)
                        held = records = 0
                    blob = record(page_id, url, payload, digest(payload), refers_to, refers_to is not None, date)
                    sink.write(packer.compress(blob))
                    held, records = held + len(blob), records + 1
                    if held >= roll_bytes:
                        close()
        close()
        if files:
            names, counts, sizes = zip(*files, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "records", "bytes"])

    return common.materialise(marked(pages, id_col, url_col, payload_col, least_bytes, **bounds).mapInArrow(run, "file string, records long, bytes long"), "warc-files")


# ---------------------------------------------------------------- normalising


class Broken(ValueError):
    """A stream that is no archive from some place on."""


class Inflated:
    """A gzip file as one stream of its bytes, whatever its members; at most a piece and a header of it are held."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.inflater, self.held, self.raw = source, None, bytearray(), b""

    def _more(self) -> bool:
        """Take in another piece; False at the end of the file."""
        data = self.raw or self.source.read(PIECE)
        self.raw = b""
        if not data:
            if self.inflater is not None:
                raise Broken("the gzip stream is cut off")
            return False
        if self.inflater is None:
            self.inflater = zlib.decompressobj(wbits=31)
        try:
            self.held += self.inflater.decompress(data, PIECE)
        except zlib.error as e:
            raise Broken(f"the gzip stream is damaged: {e}") from e
        if self.inflater.eof:
            self.raw, self.inflater = self.inflater.unused_data, None
        else:
            self.raw = self.inflater.unconsumed_tail
        return True

    def header(self) -> bytes | None:
        """The bytes before the next empty line; None at the end."""
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.held)
            if seen > MOST_HEADER:
                raise Broken("a header does not end")
            if not self._more():
                if self.held.strip(b"\r\n"):
                    raise Broken("a header is cut off")
                return None
        head = bytes(self.held[:end])
        del self.held[: end + 4]
        return head

    def body(self, length: int) -> Iterator[bytes]:
        """The next bytes, in pieces."""
        while length:
            if not self.held and not self._more():
                raise Broken("a record is cut off")
            piece = bytes(self.held[: min(length, PIECE)])
            del self.held[: len(piece)]
            length -= len(piece)
            if piece:
                yield piece

    def gap(self) -> None:
        """The two line ends after a record; their lack at the end of a file is forgiven."""
        while len(self.held) < 4 and self._more():
            pass
        while self.held[:2] == b"\r\n":
            del self.held[:2]
            while len(self.held) < 2 and self._more():
                pass


def normalise_file(source: pa.NativeFile, sink: pa.NativeFile) -> Iterator[tuple[int, int, dict[str, str], str | None]]:
    """Copy an archive so that each record is a gzip member: (offset, length, header fields, error) of each; an error comes last."""
    stream = Inflated(source)
    done = sink.tell()
    try:
        while (head := stream.header()) is not None:
            head = head.lstrip(b"\r\n")
            fields = headers(head)
            length = fields.get("content-length", "")
            if not fields[""].startswith("WARC/") or not re.fullmatch(r"[0-9]{1,18}", length):
                raise Broken("what follows is no WARC record")
            packer = zlib.compressobj(MEMBER_LEVEL, wbits=31)
            parts = [packer.compress(head + b"\r\n\r\n")]
            size = len(parts[0])
            sink.write(parts[0])
            for piece in stream.body(int(length)):
                size += sink.write(packer.compress(piece))
            size += sink.write(packer.compress(b"\r\n\r\n") + packer.flush())
            stream.gap()
            yield done, size, fields, None
            done += size
    except Broken as e:
        # What was begun of a record stays as bytes that the index does not name.
        yield done, 0, {}, str(e)


def normalise(files: DataFrame, folder: str, path_col: str = "file") -> DataFrame:
    """The index (``INDEX``) of archives rewritten into a folder with a gzip member for each record; beside each stands ``<name>.idx``, the same as text.

    A file is one stream and so one task's; what a task holds does not depend on its size.
    """
    spark = files.sparkSession
    base = common.qualified(spark, folder)
    kind = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *[(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "payload_digest", "error")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = common.open_store(path)
                name = f"{base}/{re.sub(r'(\.warc)?(\.gz)?$', '', path.rpartition('/')[2])}-{attempt}.warc.gz"
                out_store, out = common.open_store(name)
                out_store.create_dir(out.rpartition("/")[0], recursive=True)
                with store.open_input_stream(place, compression=None) as source, out_store.open_output_stream(out, compression=None) as sink, out_store.open_output_stream(f"{out}.idx", compression=None) as sidecar:
                    rows: list[tuple] = []
                    for offset, length, fields, error in normalise_file(source, sink):
                        rows.append((name, offset, length, _bare(fields.get("warc-record-id")), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, error))
                        sidecar.write(("\t".join("" if x is None else str(x) for x in rows[-1][1:]) + "\n").encode())
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(kind.names)}, schema=kind)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(kind.names)}, schema=kind)

    count = files.count()
    dealt = files.select(F.col(path_col).alias("file")).repartition(max(1, count))
    return common.materialise(dealt.mapInArrow(run, INDEX), "warc-index")


# ---------------------------------------------------------------- reading


def parse_record(blob: bytes) -> tuple:
    """(record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, payload) of one record's bytes.

    A payload is checked against its digest; a revisit has none, and its size is that of the response's HTTP headers.
    """
    head, _, rest = blob.partition(b"\r\n\r\n")
    fields = headers(head)
    block = rest[: int(fields["content-length"])]
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(headers(http).get("content-length", len(payload)))
    sha1 = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if fields.get("warc-type") == "revisit":
        payload = None
    elif sha1 is not None and sha1 != digest(payload):
        raise Broken(f"the payload of {fields.get('warc-record-id')} has another digest")
    else:
        size = len(payload)
    return _bare(fields.get("warc-record-id")), fields.get("warc-type"), fields.get("warc-target-uri"), _bare(fields.get("warc-refers-to")), sha1, size, payload


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (``RECORD``) that index rows name, each inflated from its own member; without ``payloads`` these are checked and left out."""
    kind = pa.schema([("file", pa.string()), ("offset", pa.int64()), *[(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")], ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = source = None
        for batch in batches:
            rows: list[tuple] = []
            held = 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(kind.names)}, schema=kind)

            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != opened:
                    if source is not None:
                        source.close()
                    store, place = common.open_store(path)
                    source, opened = store.open_input_file(place), path
                found = parse_record(zlib.decompress(source.read_at(length, offset), wbits=31))
                rows.append((path, offset, *found[:-1], found[-1] if payloads else None))
                held += len(found[-1] or b"") if payloads else 0
                if held >= common.PIECE_BYTES:
                    yield made()
                    rows, held = [], 0
            if rows:
                yield made()

    named = index.where(F.col("error").isNull()).select("file", "offset", "length")
    total = named.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return named.repartitionByRange(max(1, -(-total // READ_BYTES)), "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def archive(pages: DataFrame, **options: object) -> DataFrame:
    """Pages written, normalised and indexed in the shared folder: the index."""
    spark = pages.sparkSession
    folder = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    common.written(folder)
    return normalise(write(pages, f"{folder}/streams", **options), f"{folder}/archives")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    number = lambda c: F.nullif(F.substr(c, F.lit(len(_ID) + 1)), F.lit("")).cast("long")
    return read(index, payloads=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first, [('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT FOR i IN range(8)] AS parts FROM d
), b AS (
  SELECT *, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> s) & 31)::INTEGER, 1) FOR s IN [15, 10, 5, 0]], '') FOR x IN parts], '') AS payload_digest FROM f
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM b
"""
