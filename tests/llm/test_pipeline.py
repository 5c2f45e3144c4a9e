"""The pipeline's stages against brute-force versions of them."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from millrace.llm import bpe, language_id, mixing, secrets
from tests.llm import brute
from tests.llm.test_operators import DOCS, ODD, near_copies

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.select(*pipeline.COLUMNS).collect()]


def test_stages_are_named_and_keep_columns(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "source_mix", "bpe"]
    docs = documents(spark)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == pipeline.COLUMNS


def test_language_stage(spark):
    docs = documents(spark)
    got = rows(pipeline.stage_language_id(spark, docs, SF))
    net = language_id.train(docs.where(~language_id.held_out()))
    judged = language_id.identify(docs, net).collect()
    want = [tuple(r[c] for c in pipeline.COLUMNS) for r in judged if r["lang_pred"] != "und" and r["score"] >= pipeline.ABOVE_CHANCE / len(net.labels)]
    assert Counter(got) == Counter(want)
    clean = [r for r in rows(docs) if sum(c.isalpha() for c in r[1] or "") > 0.5 * len(r[1] or " ")]
    assert not set(clean) - set(got)


def test_language_stage_with_few_and_many_labels(spark):
    """The least score follows the number of labels: clean texts of two or of twenty languages stay."""
    rng = random.Random(8)
    for labels in (1, 2, 20):
        alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 12)) for _ in range(labels)]
        docs = [(i, " ".join("".join(rng.choices(alphabets[i % labels], k=6)) for _ in range(60)), f"l{i % labels:02}", "s", 0) for i in range(30 * labels)]
        table = spark.createDataFrame([*docs, (10_000, "12 34 !", None, "s", 7)], DOCS)
        assert Counter(rows(pipeline.stage_language_id(spark, table, SF))) == Counter(docs)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_near_duplicate_stage(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pipeline, "MOST_BROADCAST", broadcast)
    docs = [(i, t, "en", "s", len(t)) for i, t in near_copies(21)]
    got = rows(pipeline.stage_near_duplicates(spark, spark.createDataFrame(docs, DOCS), SF))
    part = brute.jaccard([(d[0], d[1]) for d in docs], 5, 80, 100)
    kept = [d for d in docs if part[d[0]][1] == d[0]]
    assert Counter(got) == Counter(kept) and 0 < len(got) < len(docs)
    # Repeated rows are one document, as are rows of one id with different texts: the least stands for them.
    first = kept[0]
    more = [*docs, first, (first[0], "z " + first[1], None, "s", 0), (None, first[1], "en", "s", 0), (None, first[1], "en", "s", 0)]
    got = rows(pipeline.stage_near_duplicates(spark, spark.createDataFrame(more, DOCS).repartition(3), SF))
    assert Counter(got) == Counter([*kept, *more[-2:]])


def test_secret_stage(spark):
    docs = documents(spark)
    want = []
    for d in rows(docs):
        base = secrets.base_spans(d[1] or "")
        spans = sorted(base + secrets.linked_spans(d[1] or "", base), key=lambda s: s[1])
        text = secrets.redacted(d[1], spans, pipeline.SECRET_MARK) if spans else d[1]
        want.append((d[0], text, d[2], d[3], len(text) if spans else d[4]))
    assert Counter(rows(pipeline.stage_secret_scan(spark, docs, SF))) == Counter(want)
    leaky = [(1, "x password = abcdefghijklmnop y", "en", "s", 31)]
    assert rows(pipeline.stage_secret_scan(spark, spark.createDataFrame(leaky, DOCS), SF)) == [(1, "x [secret] y", "en", "s", 12)]


def test_mix_stage(spark):
    docs = documents(spark)
    got = pipeline.stage_source_mix(spark, docs, SF).collect()
    planned = {r["doc_id"]: r for r in mixing.plan(docs).collect()}
    words = Counter()
    for r in got:
        words[r["doc_id"]] += len(brute.words(r["text"]))
        assert planned[r["doc_id"]]["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert words == Counter({k: r["taken"] for k, r in planned.items() if r["taken"]})
    partial = [r for r in got if r["text"] != planned[r["doc_id"]]["text"]]
    assert len(partial) <= len({r["source"] for r in planned.values()})


def test_secret_stage_against_plain_patterns(spark):
    """Every base secret is gone, and a text without an access identifier loses nothing else."""
    docs = rows(documents(spark))
    assert len({d[0] for d in docs}) == len(docs)
    got = {r[0]: r[1] for r in rows(pipeline.stage_secret_scan(spark, documents(spark), SF))}
    assert set(got) == {d[0] for d in docs}
    hits = 0
    for key, text, *_ in docs:
        found = [m.span() for m in brute.ASSIGN.finditer(text or "") if len(m.group(2)) >= 12]
        found += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 18]
        found += [m.span() for m in re.finditer(r"[0-9a-f]+", text or "") if len(m.group()) >= 16]
        hits += bool(found)
        if not found:
            assert got[key] == text
            continue
        covered = {i for a, z in found for i in range(a, z)}
        assert all(text[a:z] not in got[key] for a, z in found)
        if "AKIA" not in text:
            left = "".join(c for i, c in enumerate(text) if i not in covered)
            assert got[key].replace(pipeline.SECRET_MARK, "") == left
    assert hits


def test_mix_stage_against_water_filling(spark):
    """Words by source meet targets that are filled here step by step; no document is taken more than twice."""
    docs = rows(documents(spark))
    size = {d[0]: len(brute.words(d[1])) for d in docs}
    sources = sorted({d[3] for d in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d[0]] for d in docs if d[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(total.values())
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s]}
        for s in over or free:
            target[s] = 2.0 * total[s] if over else share[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    by_source, by_doc = Counter(), Counter()
    for d in rows(pipeline.stage_source_mix(spark, documents(spark), SF)):
        by_source[d[3]] += len(brute.words(d[1]))
        by_doc[d[0]] += len(brute.words(d[1]))
    assert all(abs(by_source[s] - target[s]) <= 1 for s in sources), (by_source, target)
    assert all(n <= 2 * size[k] for k, n in by_doc.items())


def test_bpe_stage(spark):
    for r in pipeline.stage_bpe(spark, documents(spark), SF).collect():
        assert r["round_trip"] and r["token_ids"] == bpe.codec().encode(r["text"])


def test_whole_run(spark):
    docs = documents(spark)
    got = pipeline.run(spark, SF).collect()
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert Counter((r["doc_id"], r["text"], r["n_tokens"]) for r in got) == Counter((r["doc_id"], r["text"], r["n_tokens"]) for r in docs.collect())
    assert got and all(r["round_trip"] for r in got)


def test_odd_and_empty_tables(spark):
    from pyspark.sql import functions as F

    odd = spark.createDataFrame(ODD, DOCS).withColumns({n: F.lit("clash") for n in ("id", "size", "score", "lang_pred", "component_id", "_row", "token_ids")})
    for table in (odd, odd.limit(0)):
        docs = table
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, SF)
        n = docs.count()
        assert n == 0 if table is not odd else n > 0
