"""The ten queries against brute force, libraries or SQL on the smallest tables."""

import base64
import binascii
import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
import xxhash

import __spark_entry__ as entry
from compare import connection, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    rows = connection(SF_DIR).execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    return {i: t or "" for i, t in rows}


def run(spark, name):
    return {r[0]: r.asDict() for r in entry.queries()[name](spark, SF_DIR).collect()}


def test_op1(spark, documents):
    def print_of(text):
        low = text.translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x20\x09-\x0d]+", low)
        made = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in made]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: print_of(t) for i, t in documents.items()}
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] < label[b]:
                    label[b], changed = label[a], True
    got = run(spark, "op1_simhash_pivots")
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", label[i]) for i in prints}


def test_op2(spark, documents):
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = run(spark, "op2_byte_bpe")
    assert len(got) == len(documents)
    for i, t in documents.items():
        ids = enc.encode_ordinary(t)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want, i


def test_op4(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    got = run(spark, "op4_url_rules")
    pages = connection(SF_DIR).execute("SELECT page_id, url FROM pages").fetchall()
    assert len(got) == len(pages)
    for i, url in pages:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[1] + best[2])
        assert got[i]["verdict"] == best[0] if best else got[i]["verdict"] in ("allow", "block")


def test_op5(spark, documents):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = run(spark, "op5_token_store")
    assert len(got) == len(documents)
    for i, text in documents.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want = (start, len(ids), binascii.crc32(np.array(ids, "<u4").tobytes()))
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == want, i
        start += len(ids)


def test_op7(spark, documents):
    kinds = {
        "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24),
    }
    got = run(spark, "op7_secret_ledger")
    assert len(got) == len(documents)
    for i, text in documents.items():
        found = sorted((m.start(), k, kind, m.end()) for k, (kind, (p, g, n)) in enumerate(kinds.items()) for m in re.finditer(p, text, re.ASCII) if len(m[g]) >= n)
        base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), i
        assert set(base.split(",")) - {""} <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(f[2] == k for f in found) for k in kinds]


def test_op8(spark):
    got = entry.queries()["op8_toxicity_nb"](spark, "/root/testdata/sf0.01").collect()
    toxic = dict(connection("/root/testdata/sf0.01").execute("SELECT doc_id, toxic FROM labels").fetchall())
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert all(r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_op10(spark, documents):
    from collections import Counter

    def words(t):
        return re.findall(r"[^\W_]+|[^\x00-\x7f]+", t.lower()) if t.isascii() else bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in t.lower().encode()).split()

    got = {}
    for r in entry.queries()["op10_decontamination"](spark, SF_DIR).collect():
        got[r["doc_id"], r["item_id"]] = r["similarity"]
    items = connection(SF_DIR).execute("SELECT item_id, text FROM benchmark").fetchall()
    want, held = {}, {i: [w if isinstance(w, bytes) else w.encode() for w in words(t)] for i, t in documents.items()}
    for item, text in items:
        w = [x if isinstance(x, bytes) else x.encode() for x in words(text or "")]
        if not w:
            continue
        size = min(5, len(w))
        own = Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
        for i, d in held.items():
            some = [tuple(d[k : k + size]) for k in range(len(d) - size + 1)]
            for k, s in enumerate(some):
                if s in own:
                    for a in range(max(0, k - len(w) + size), k + 1):
                        win = Counter(some[a : a + len(w) - size + 1])
                        if sum(win.values()) == sum(own.values()):
                            v = sum((win & own).values()) / sum((win | own).values())
                            if v >= 0.8:
                                want[i, item] = max(want.get((i, item), 0), round(v, 6))
    assert got == pytest.approx(want)


@pytest.mark.parametrize("name", ["op3_line_dedup", "op6_warc_zip", "op9_bm25_wand"])
def test_sql(spark, name):
    assert differences(entry.queries()[name](spark, SF_DIR), entry.oracle_sql()[name], connection(SF_DIR)) == []


def test_pipeline(spark, documents):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF_DIR)
    rows = out.select("doc_id", "same_text").collect()
    assert rows and all(r["same_text"] for r in rows)
    assert {r["doc_id"] for r in rows} < set(documents) and len({r["doc_id"] for r in rows}) == len(rows)
