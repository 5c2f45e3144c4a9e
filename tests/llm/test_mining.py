"""Hard negatives, spelling variants and archives against brute-force versions, and the odd inputs that they must stand."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives, spelling, warc

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, embedding array<float>"


def clashing(df):
    names = ["id", "n", "word", "anchor", "window", "rank", "score", "key", "first", "run", "payload", "length", "slice", "file"]
    return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})


# ---------------------------------------------------------------- hard negatives


def hard(rows, anchors, positives=5, negatives=5, share=(80, 100), scale=256):
    used = [(i, l, [int(np.floor(scale * float(x))) for x in v]) for i, l, v in rows if None not in (i, l, v) and all(x is not None and np.isfinite(x) for x in v)]
    chosen = {}
    for i, l, v in used:
        if anchors(i) and (i not in chosen or (l, v) < chosen[i]):
            chosen[i] = (l, v)
    out = []
    for a, (label, vector) in chosen.items():
        scored = sorted((-sum(x * y for x, y in zip(vector, v, strict=True)), i, l) for i, l, v in used if i != a and len(v) == len(vector))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and share[0] * -s <= share[1] * -x[0] and -x[0] <= -s]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fit[:negatives])]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def some_vectors(n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(n)]
    rows += [(5, 1, [0.5, 0.5, 0.5, 0.5]), (5, 1, [0.5, 0.5, 0.5, 0.5]), (10, 2, [1.0, 1.0, 1.0, 1.0]), (None, 1, [1.0] * 4), (n + 1, None, [1.0] * 4), (n + 2, 1, None), (n + 3, 1, [1.0, None, 1.0, 1.0]), (n + 4, 1, [float("nan")] * 4), (n + 5, 1, [float("inf")] * 4)]
    return rows + [(n + 6 + i, i % 2, [1.0, float(i)]) for i in range(9)] + [(n + 20, 0, [])]


@pytest.mark.parametrize("anchor_bytes", [hard_negatives.ANCHOR_BYTES, 300])
def test_hard_negatives(spark, anchor_bytes):
    rows = some_vectors(120, 3)
    df = clashing(spark.createDataFrame(rows, VECTORS).repartition(5))
    got = told(hard_negatives.mine(df, df.where("vec_id % 5 = 0"), anchor_bytes=anchor_bytes))
    want = hard(rows, lambda i: i % 5 == 0)
    assert want and got == want


def test_hard_negatives_of_one_label_or_none(spark):
    rows = [(i, 1, [1.0, float(i % 3)]) for i in range(20)]
    df = spark.createDataFrame(rows, VECTORS)
    assert told(hard_negatives.mine(df, df.where("vec_id = 0"))) == []
    assert told(hard_negatives.mine(df.where("false"), df.where("false"))) == []
    lone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], VECTORS)
    assert told(hard_negatives.mine(lone, lone)) == []


def test_hard_negatives_among_thousands_of_equal_rows(spark):
    rows = [(i, i % 2, [1.0, 0.5]) for i in range(3000)] + [(3000 + i, i % 2, [1.0, 0.25 * i]) for i in range(20)]
    df = spark.createDataFrame(rows, VECTORS).repartition(7)
    assert told(hard_negatives.mine(df, df.where("vec_id in (0, 3007)"))) == hard(rows, lambda i: i in (0, 3007))


def test_hard_negatives_with_scores_that_doubles_round(spark):
    big = float(2**18)
    rows = [(i, i % 2, [big, float(i) / 256, big]) for i in range(30)]
    df = spark.createDataFrame(rows, VECTORS)
    assert told(hard_negatives.mine(df, df.where("vec_id < 4"))) == hard(rows, lambda i: i < 4)
    huge = spark.createDataFrame([(0, 1, [2.0**21]), (1, 1, [2.0**21])], VECTORS)
    with pytest.raises(Exception, match="2\\*\\*55"):
        hard_negatives.mine(huge, huge)


# ---------------------------------------------------------------- spelling


def spelled(docs, ratio=5, least_length=6, least_count=5):
    count = Counter()
    for k, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= least_length and c >= least_count}

    def near(v, w):
        if len(v) == len(w):
            return sum(a != b for a, b in zip(v, w, strict=True)) == 1
        v, w = sorted((v, w), key=len)
        return len(w) == len(v) + 1 and any(w[:i] + w[i + 1 :] == v for i in range(len(w)))

    form, out = {}, {}
    for v in n:
        close = [w for w in n if near(v, w)]
        best = min(close, key=lambda w: (-n[w], w), default=None)
        form[v] = best if best is not None and n[best] >= ratio * n[v] else None
        out[v] = len(close)
    for v in n:
        root = v
        while form[root] is not None:
            root = form[root]
        out[v] = (form[v], root, n[v], out[v], n.get(form[v]))
    return out


def grouped(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def variants(seed, alphabet="abcdeé", words=40):
    """Texts of words, their misspellings with few occurrences, and chains of ever rarer ones."""
    rng = random.Random(seed)
    texts = []
    for _ in range(words):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 10)))
        n = 5
        for _ in range(3):
            texts += [w] * n
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]])
            n *= 5
    rng.shuffle(texts)
    return [(i, " ".join(texts[i * 50 : i * 50 + 50])) for i in range(len(texts) // 50 + 1)]


DOCS = "doc_id long, text string"


@pytest.mark.parametrize(("shard", "scan", "plain"), [(1 << 16, 1 << 15, 12), (7, 5, 0), (20, 100, 2)])
def test_spelling(spark, monkeypatch, shard, scan, plain):
    monkeypatch.setattr(spelling, "PLAIN_OWNERS", plain)
    docs = variants(5) + [(None, "Repeated REPEATED repeated"), (None, "repeated repeated"), (7, None), (8, ""), (9, "x" * 20_000), (9, "naïve×naïve÷naïve " * 9)]
    df = clashing(spark.createDataFrame(docs, DOCS).repartition(4))
    want = spelled(docs)
    assert sum(f is not None for f, *_ in want.values()) > 20 and any(r not in (w, f) for w, (f, r, *_) in want.items())
    assert grouped(spelling.group(df, shard_words=shard, scan_words=scan)) == want


def test_words_that_share_a_half(spark):
    rng = random.Random(2)
    texts = ["prefix" + "".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))) for _ in range(600)] + ["".join(rng.choice("abc") for _ in range(4)) + "ending" for _ in range(100)]
    docs = [(i, " ".join([w] * rng.randrange(1, 40))) for i, w in enumerate(texts)]
    assert grouped(spelling.group(spark.createDataFrame(docs, DOCS), shard_words=100, scan_words=90)) == spelled(docs)


def test_spelling_of_the_corpus_and_of_nothing(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert grouped(spelling.query(spark, SF)) == spelled(docs)
    assert spelling.group(spark.createDataFrame([], DOCS)).collect() == []


def test_one_edit():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))) for _ in range(120)]
    for v in words:
        for w in words:
            a, b = sorted((v, w), key=len)
            want = sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
            assert spelling.one_edit(v, w) == want


# ---------------------------------------------------------------- archives

PAGES = "page_id long, url string, html string"
LONG = "<p>lorem ipsum</p>\r\n\r\n" * 200_000
ROWS = [
    (3, "http://a/ b\r\nc", "<p>x</p>"),
    (1, "http://a/1", "<p>x</p>"),
    (1, "http://a/1", "<p>x</p>"),
    (2, None, None),
    (4, "http://a/é", ""),
    (5, "", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
    (6, "http://a/6", LONG),
    (7, "http://a/7", LONG),
    (None, "http://a/8", "<p>x</p>"),
    (None, "http://a/9", "only here"),
    (None, "http://a/9", "only here"),
    (9, "http://a/10", "日本語 \U0001d4b3 \x00"),
]


def archived(rows, least_bytes=0):
    out = []
    for k, _, html in rows:
        payload = (html or "").encode()
        alike = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        again = len(payload) >= least_bytes and alike and k != min(alike)
        out.append((k, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", min(alike) if again else None))
    return sorted(out, key=str)


def records(index):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back."""
    number = lambda uri: int(uri[len("urn:x-page:") :]) if uri and uri != "urn:x-page:" else None
    found = warc.read(index).collect()
    for r in found:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        if r["payload"] is not None:
            assert warc.digest(bytes(r["payload"])) == r["payload_digest"]
    return sorted(((number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in found), key=str)


@pytest.mark.parametrize("bounds", [{}, {"most_broadcast": 0, "large": 3}, {"least_bytes": 9}, {"roll_bytes": 100}])
def test_archive(spark, bounds):
    pages = clashing(spark.createDataFrame(ROWS, PAGES).repartition(3))
    assert records(warc.archive(pages, **bounds)) == archived(ROWS, bounds.get("least_bytes", 0))
    assert warc.archive(pages.where("false")).count() == 0


def test_each_record_is_a_member(spark, tmp_path):
    files = warc.write(spark.createDataFrame(ROWS, PAGES).coalesce(1), f"{tmp_path}/streams")
    assert files.count() == 1 and files.first()["records"] == len(ROWS)
    stream = gzip.decompress(open(files.first()["file"].removeprefix("file:"), "rb").read())
    index = warc.normalise(files, f"{tmp_path}/archives").collect()
    path = index[0]["file"].removeprefix("file:")
    whole = open(path, "rb").read()
    assert gzip.decompress(whole) == stream
    sidecar = open(path + ".idx", encoding="utf-8").read().splitlines()
    assert len(index) == len(sidecar) == len(ROWS)
    for row, line in zip(sorted(index, key=lambda r: r["offset"]), sidecar, strict=True):
        one = zlib.decompressobj(wbits=31)
        blob = one.decompress(whole[row["offset"] : row["offset"] + row["length"]])
        assert one.eof and not one.unused_data and blob.startswith(b"WARC/1.1\r\n") and blob.endswith(b"\r\n\r\n")
        assert line.split("\t")[:3] == [str(row["offset"]), str(row["length"]), row["record_id"]]


def rewritten(tmp_path, blob, name="a.warc.gz"):
    (tmp_path / name).write_bytes(blob)
    fs = pafs.LocalFileSystem()
    with fs.open_input_stream(f"{tmp_path}/{name}", compression=None) as source, fs.open_output_stream(f"{tmp_path}/out", compression=None) as sink:
        found = list(warc.normalise_file(source, sink))
    return found, (tmp_path / "out").read_bytes()


def test_streams_of_any_members_and_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 37)
    one = [warc.record(i, f"u{i}", b"\r\n\r\nbody %d " % i * 40, "D", None, False, warc.DATE) for i in range(6)]
    whole = b"".join(one)
    members = b"".join(gzip.compress(x) for x in one)
    odd = b"".join(gzip.compress(whole[i : i + 1001]) for i in range(0, len(whole), 1001))
    for blob in (gzip.compress(whole), members, odd, gzip.compress(whole.rstrip(b"\r\n"))):
        found, out = rewritten(tmp_path, blob)
        assert [e for *_, e in found] == [None] * 6
        assert [zlib.decompress(out[o : o + n], wbits=31) for o, n, *_ in found] == one
    for blob, kept in ((gzip.compress(whole)[:-20], 5), (members[: len(members) - 3], 6), (gzip.compress(b"".join(one[:3]) + b"junk\r\n\r\n" + one[3]), 3), (members + b"no gzip", 6), (gzip.compress(one[0] + b"WARC/1.1\r\nContent-Length: 5"), 1)):
        found, out = rewritten(tmp_path, blob)
        *good, last = found
        assert last[3] and last[1] == 0 and len(good) in (kept, kept - 1) and all(e is None for *_, e in good)
        assert [zlib.decompress(out[o : o + n], wbits=31) for o, n, *_ in good] == one[: len(good)]
    assert rewritten(tmp_path, b"")[0] == [] and rewritten(tmp_path, gzip.compress(b""))[0] == []


def test_payload_with_another_digest():
    blob = warc.record(1, "u", b"abc", "WRONG", None, False, warc.DATE)
    with pytest.raises(warc.Broken):
        warc.parse_record(blob)


def test_archive_of_the_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted((tuple(r) for r in warc.query(spark, SF).collect()), key=str)
    assert got == archived(rows)
