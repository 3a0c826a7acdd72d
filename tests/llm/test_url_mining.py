"""Rules mined from URLs of many tokens, against all sets of tokens."""

import random
from itertools import combinations

import pytest

from barloom.llm import url_rules

KEYS = [f"k{i:02d}" for i in range(11)]


def urls():
    """Labels follow the URLs: two rare keys together, or one rarer path word, are bad."""
    draw, out = random.Random(3), []
    for i in range(400):
        keys = [k for k in KEYS if draw.random() < 0.93]
        rare = [k for k in ("ya", "yb") if draw.random() < 0.35]
        word = "/evil" if draw.random() < 0.1 else ""
        out.append((f"https://a.b.example.com{word}?" + "&".join(f"{k}=1" for k in keys + rare), len(rare) == 2 or bool(word)))
    return out


def tokens(url):
    query = url.split("?")[1].split("&")
    return {"s=a.b.example.com", "s=b.example.com", "s=example.com", "s=com", *(["p=evil"] if "/evil" in url else []), *("q=" + k[:-2] for k in query)}


def brute(rows, least, confidence):
    held = [(tokens(u), bad) for u, bad in rows]
    bits = {t: sum(1 << i for i, (x, _) in enumerate(held) if t in x) for t in {t for x, _ in held for t in x}}
    bad, out, level = sum(1 << i for i, (_, b) in enumerate(held) if b), {}, []
    level = [((t,), bits[t]) for t in sorted(bits)]
    while level:
        following = []
        for own, at in level:
            if any(set(r) < set(own) for r in out):
                continue
            n = (at & bad).bit_count()
            if n < least:
                continue
            if n >= confidence * at.bit_count():
                out[own] = n / at.bit_count()
            else:
                following += [((*own, t), at & bits[t]) for t in bits if t > own[-1]]
        level = following
    return {r: c for r, c in out.items() if not any(set(x) < set(r) for x in out)}


def test_mining_takes_every_token(spark):
    rows = urls()
    assert max(len(tokens(u)) for u, _ in rows) > 16
    df = spark.createDataFrame(rows, "url string, bad boolean").repartition(4)
    got = {tuple(r["tokens"]): r["confidence"] for r in url_rules.mine(df, min_count=20).collect()}
    want = brute(rows, 20, 0.8)
    assert ("p=evil",) in want and ("q=ya", "q=yb") in want
    assert got == {r: pytest.approx(c) for r, c in want.items()}


def test_tokens_of_the_same_urls_stand_for_each_other(spark):
    rows = [(f"https://x.bad.net/p?{'&'.join(f'c{j}' for j in range(25))}", True) for i in range(30)]
    rows += [(f"https://fine.org/q{i}", False) for i in range(70)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    got = {tuple(r["tokens"]) for r in url_rules.mine(df, min_count=20).collect()}
    assert got == {(t,) for t in ("s=x.bad.net", "s=bad.net", "s=net", "p=p", *(f"q=c{j}" for j in range(25)))}
    blocked = url_rules.judge(df.select(url_rules.F.monotonically_increasing_id().alias("page_id"), "url"), df, []).where("verdict = 'block'")
    assert blocked.count() == 30
