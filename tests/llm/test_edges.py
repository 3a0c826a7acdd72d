"""Nulls, empty and very long texts, ties, repeated rows, empty tables and odd column names."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from barloom.llm import bm25, byte_bpe, decontam, line_dedup, secret_ledger, simhash, token_store, toxicity, url_rules, warc_zip
from barloom.llm.common import work_path

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
LONG = " ".join(f"word{i}" for i in range(30_000))
LINE = "one two three four five six seven eight nine ten"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, key string, line_dedup_lines int, id long, row string"
ROWS = [
    (1, None), (2, ""), (3, "   \n \t "), (4, LONG), (5, LONG), (6, f"{LINE}\nshort"), (6, f"{LINE}\nshort"), (7, f"{LINE} \nshort\ná é ñ"),
    (None, "a text without an id"), (None, None), (8, "tie"), (9, "tie"), (10, f"{LINE} eleven"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "dot", "k", 5, 6, "r") for i, t in rows], SCHEMA)


@pytest.fixture
def docs(spark):
    return frame(spark)


@pytest.fixture
def none(spark):
    return frame(spark, [])


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    blank = [r for r in rows if r["doc_id"] in (1, 2, 3)]
    assert {(r["fingerprint"], r["component_id"]) for r in blank} == {("0" * 16, 1)}
    assert {r["component_id"] for r in rows if r["doc_id"] in (8, 9)} == {8}
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5)} == {4}
    assert simhash.near_duplicates(none).count() == 0


def test_near_dedup(docs, none):
    kept = simhash.dedup_documents(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    # a null id comes first, so that the blank row without an id stands for all blank ones
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, (r["text"] or "")[:4]) for r in rows) == [
        (False, 0, ""), (False, 0, "a te"), (True, 4, "word"), (True, 6, "one "), (True, 7, "one "), (True, 8, "tie"), (True, 10, "one "),
    ]
    assert {(r["a.b"], r["key"], r["line_dedup_lines"], r["id"]) for r in rows} == {("dot", "k", 5, 6)}
    assert simhash.dedup_documents(none).collect() == [] and simhash.dedup_documents(none).columns == docs.columns


def test_line_dedup(docs, none):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "line_dedup_lines", "line_dedup_dropped"]
    rows = [r.asDict() | {"dropped": r[-1], "lines": r[-2]} for r in out.collect()]
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["text"], r["lines"], r["dropped"]))
    assert by[1] == [(None, 1, 0)] and by[2] == [("", 1, 0)] and by[3] == [("   \n \t ", 2, 0)]
    assert by[4] == [(LONG, 1, 0)] and by[5] == [("", 1, 1)]
    # repeated rows have the same places, and keep their lines
    assert by[6] == [(f"{LINE}\nshort", 2, 0)] * 2
    assert by[7] == [("á é ñ", 3, 2)] and by[8] == [("tie", 1, 0)] and by[9] == [("", 1, 1)] and by[10] == [("", 1, 1)]
    assert line_dedup.dedup_lines(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, LINE), (1, "á é ñ"), (2, None), (3, ""), (4, LINE)], "item_id long, text string")
    found = decontam.find_contamination(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["similarity"]) for r in found) == sorted(
        [(6, 1, 1.0), (6, 4, 1.0)] * 2 + [(7, 1, 1.0), (7, 1, 1.0), (7, 4, 1.0), (10, 1, 1.0), (10, 4, 1.0)]
    )
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == len(ROWS)
    assert decontam.find_contamination(none, items).count() == decontam.find_contamination(docs, items.limit(0)).count() == 0


def test_blocks_of_items(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, LINE), (1, "á é ñ"), (4, LINE)], "item_id long, text string")
    want = sorted(map(tuple, decontam.find_contamination(docs, items).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_LIMIT", 700)
    assert decontam._blocks(items, "item_id", "text")[0] > 1
    assert sorted(map(tuple, decontam.find_contamination(docs, items).collect())) == want
    assert decontam.drop_contaminated(docs, items).count() == len(ROWS) - 4


def test_byte_bpe(docs, none):
    out = byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    assert len(out) == len(ROWS) and all(r["same_text"] and r["covered"] for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (1, 2)} == {0}
    assert byte_bpe.round_trip(none, RANKS, P.PATTERN).count() == 0


def test_byte_bpe_offsets_and_split_characters(spark):
    texts = {1: "añ😀b \U0001f9ecก", 2: "plain words", 3: "☃☄" * 3}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    encoded = byte_bpe.encode(df, RANKS, P.PATTERN)
    split = 0
    for r in encoded.collect():
        t = texts[r["doc_id"]]
        assert r["starts"][0] == 0 and r["ends"][-1] == len(t) and len(r["ids"]) == len(r["starts"])
        split += sum(a < b for a, b in zip(r["starts"][1:], r["ends"]))
    assert split  # some character is cut between ids
    for r in byte_bpe.decode(encoded, RANKS, P.PATTERN).collect():
        assert r["text"] == texts[r["doc_id"]] and bytes(r["data"]) == r["text"].encode() and "".join(r["pieces"]) == r["text"]
        assert "�" not in "".join(r["pieces"])


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "http://A.com/en/x"), (4, "http://A.com/en/x"), (5, "http://" + "x/" * 20_000)], "page_id long, url string")
    out = url_rules.judge(pages.withColumn("a.b", url_rules.F.lit(1)), pages.select("url", url_rules.F.lit(None).cast("boolean").alias("bad")), [url_rules.HostRule("block", "com", "/en/")])
    rows = {r["page_id"]: r for r in out.collect()}
    assert out.count() == 6 and rows[4]["verdict"] == "block" and rows[4]["host"] == "a.com"
    assert all((rows[i]["host"], rows[i]["path"], rows[i]["verdict"]) == ("", "", "allow") for i in (1, 2, 3))
    assert url_rules.judge(pages.limit(0), pages.select("url", url_rules.F.lit(True).alias("bad")).limit(0), []).count() == 0


def test_url_rules_of_equal_lift_block(spark):
    labelled = [(f"http://x.org/{i}?bad", True) for i in range(40)] + [(f"http://x.org/{i}?good", False) for i in range(40)] + [(f"http://x.org/{i}", i % 2 == 0) for i in range(20)]
    df = spark.createDataFrame(labelled, "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://x.org/1?good&bad"), (2, "http://x.org/1?good"), (3, "http://x.org/77")], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["label"]) for r in url_rules.judge(pages, df, []).collect()}
    assert got == {1: ("block", url_rules.BAD), 2: ("allow", url_rules.GOOD), 3: ("allow", None)}


def test_token_store(spark, docs, none):
    path = work_path(spark, "edge-store")
    token_store.write_store(docs, path, WORDS, 2)
    rows = token_store.read_index(spark, path).orderBy("start").collect()
    assert len(rows) == len(ROWS) and all(r["verified"] for r in rows)
    assert [r["doc"] for r in rows] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    ids = {r["start"]: r["ids"] for r in token_store.read_documents(spark, path).collect()}
    for r in rows:
        own = ids[r["start"]]
        assert own[-1] == 2 and len(own) == r["n_tokens"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
    empty = work_path(spark, "edge-store")
    token_store.write_store(none, empty, WORDS, 2)
    assert token_store.read_index(spark, empty).count() == 0


def test_token_store_finds_a_changed_chunk(spark, docs):
    path, other = work_path(spark, "edge-store"), work_path(spark, "edge-store")
    token_store.write_store(docs.where("doc_id in (4, 8)"), path, WORDS, 2)
    for part in ("chunks", "recipes", "manifest"):
        df = spark.read.parquet(f"{path}/{part}")
        if part == "recipes":  # another order of chunks
            df = df.withColumn("addresses", url_rules.F.reverse("addresses"))
        df.write.parquet(f"{other}/{part}")
    assert {r["doc"]: r["verified"] for r in token_store.read_index(spark, other).collect()} == {4: False, 8: True}


@pytest.mark.parametrize("n", [1, 2, 5, 8, 13])
def test_merkle_proofs(n):
    leaves = [hashlib.md5(bytes([i])).digest() for i in range(n)]
    root = token_store.merkle_root(leaves)
    for i, leaf in enumerate(leaves):
        proof = token_store.merkle_proof(leaves, i)
        assert len(proof) <= 4 and token_store.proven_root(leaf, proof) == root
        assert token_store.proven_root(leaf[::-1], proof) != root


def test_secret_ledger_scans_only_unseen_pairs(spark, docs, none):
    secret = "password = hunter2hunter2"
    ledger = work_path(spark, "edge-ledger")
    size = lambda: spark.read.parquet(ledger).count()
    secret_ledger.update(none, ledger)
    assert size() == 0
    secret_ledger.update(docs, ledger)
    texts = {t or "" for _, t in ROWS}
    assert size() == len(texts) and secret_ledger.findings(docs, ledger).count() == len(ROWS)
    secret_ledger.update(docs, ledger)
    assert size() == len(texts)
    later = frame(spark, [*ROWS, (20, secret), (21, secret), (22, "-----BEGIN RSA PRIVATE KEY-----")])
    secret_ledger.update(later, ledger)
    assert size() == len(texts) + 2
    found = {r["doc_id"]: r["spans"] for r in secret_ledger.findings(later, ledger).where("doc_id >= 20").collect()}
    assert found == {20: "assign:0:25", 21: "assign:0:25", 22: "pem:0:31"}
    secret_ledger.update(later, ledger, rule_version="2")
    assert size() == 2 * (len(texts) + 2)


def test_toxicity(spark, docs, none):
    assert toxicity.drop_toxic(docs, toxicity.train_outside_fold(docs, labels(spark))).count() == len(ROWS)
    assert toxicity.drop_toxic(none, toxicity.train_outside_fold(none, labels(spark))).columns == docs.columns
    many = frame(spark, [(i, "you vile awful fool" if i % 2 else "a calm and friendly note") for i in range(100)])
    model = toxicity.train_outside_fold(many, labels(spark, [(i, 1, i % 2) for i in range(100)]))
    kept = toxicity.drop_toxic(many, model)
    assert kept.columns == docs.columns and {r["doc_id"] % 2 for r in kept.collect()} == {0}
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == len(ROWS)


def test_bm25(spark, docs, none):
    path = work_path(spark, "edge-bm25")
    bm25.build_index(docs, path)
    rows = bm25.search(spark, path, docs.where("doc_id in (1, 4, 8) or doc_id is null"), k=3).collect()
    assert [(r["found_id"], r["rank"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["doc_id"] == 8] == [(8, 1), (9, 2)]
    assert [r["found_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["doc_id"] == 4] == [4, 5]
    assert not [r for r in rows if r["doc_id"] == 1]
    empty = work_path(spark, "edge-bm25")
    bm25.build_index(none, empty)
    assert bm25.search(spark, empty, docs).count() == 0 and bm25.search(spark, path, none).count() == 0


def test_bm25_passes_over_blocks():
    """One query against a shard of 20 blocks: the best ten documents, with few postings read."""
    build = bm25._Builder()
    for i in range(20 * bm25.BLOCK):
        build.add(i, "common " + ("rare " * 5 if i // bm25.BLOCK == 7 and i % 10 == 0 else "") + f"filler{i % 50}")
    shard = bm25.Shard(*build.row(), avgdl=3.0)
    at = shard.numbers([b"common", b"rare"])
    score, ids = shard.top(at, np.array([0.1, 5.0]), 0.0, 10)
    assert ids == [i for i in range(7 * bm25.BLOCK, 8 * bm25.BLOCK) if i % 10 == 0][:10]
    assert shard.read < len(shard.docs) / 10


def test_warc(spark, none):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 5000), (4, "x" * 5000), (5, "y" * 999), (6, "y" * 999), (7, "é" * 300_000)], "page_id long, html string").withColumn("url", url_rules.F.lit(None).cast("string"))
    path = work_path(spark, "edge-warc")
    warc_zip.write_archives(pages, path)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_zip.read_archives(spark, path).collect()}
    assert got == {
        1: (0, "response", None), 2: (0, "response", None), 3: (5000, "revisit", 4), 4: (5000, "response", None),
        5: (999, "response", None), 6: (999, "response", None), 7: (600_000, "response", None),
    }


def test_every_stage_of_the_pipeline(spark, docs, none, tmp_path):
    labels(spark, [(1, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, LINE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, none):
            out = stage(spark, df, str(tmp_path))
            out.write.parquet(work_path(spark, "edge-stage"))
            assert name == "byte_bpe" or out.columns == df.columns, name
