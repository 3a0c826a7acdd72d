"""Near copies of texts against all pairs, where the buckets of fingerprints are overfull."""

import random

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import simhash
from barloom.llm.common import ship
from barloom.llm.components import connected_components
from barloom.llm.shingles import shingle_lists


def groups_of(nodes, links):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


def overfull(n=160, words=120):
    """Pairs of near copies, all of one template, of which each pair has replaced other words."""
    draw, template, out = random.Random(5), [f"w{i}" for i in range(words)], {}
    for i in range(n):
        own = list(template)
        for k in draw.sample(range(words // 5), 4):
            own[k * 5] = f"p{i}x{k}"
        other = list(own)
        for k in draw.sample(range(words), 2):
            other[k] = f"q{i}x{k}"
        out[f"{i:04d}a".encode()], out[f"{i:04d}b".encode()] = " ".join(own), " ".join(other)
    return out


def test_similar_texts_loses_nothing(spark):
    ship(spark)
    texts = overfull()
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, t.split()) for k, t in texts.items())}
    keys = sorted(sets)
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    links = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if near(sets[a], sets[b])}
    df = spark.createDataFrame([(bytearray(k), t) for k, t in texts.items()], "key binary, text string")
    found = simhash.similar_texts(df).cache()
    assert {(bytes(r["a"]), bytes(r["b"])) for r in found.collect()} <= links
    got = {bytes(r["node"]): bytes(r["label"]) for r in connected_components(found).collect()}
    want = groups_of(keys, links)
    assert len(set(want.values())) > 20
    assert {k: got.get(k, k) for k in keys} == want


def alone(members):
    """Every text as a star of its own."""
    return members.withColumns({"label": F.col("key"), "center": F.col("key"), "far": F.lit(0.0), "radius": F.lit(0.0)})


def test_hot_shingles_are_sliced(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(simhash, "HOT_SLICE", 3)
    texts = {f"{i:03d}".encode(): f"one two three four five own{i}" for i in range(40)}
    df = spark.createDataFrame([(bytearray(k), t) for k, t in texts.items()], "key binary, text string")
    got = [(bytes(r["a"]), bytes(r["b"])) for r in simhash._near_stars(alone(simhash._members(simhash._marks(df, 5, 0.3))), 0.3).collect()]
    keys = sorted(texts)
    assert sorted(got) == [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]


def judged_pairs(monkeypatch):
    """Counts the pairs that are judged, pass by pass."""
    counts, real = [], simhash._judged

    def judged(pairs, *rest):
        counts.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(simhash, "_judged", judged)
    return counts


def test_a_large_group_with_an_outsider(spark, monkeypatch):
    """5,000 near copies, and texts that share a passage with all of them but are no copies: no
    two copies are compared with each other but through their leaders."""
    ship(spark)
    draw, counts = random.Random(2), judged_pairs(monkeypatch)
    template = [f"w{i}" for i in range(150)]

    def copy(i):
        own = list(template)
        own[draw.randrange(150)] = f"c{i}"
        return " ".join(own)

    n = 5000
    texts = {i: copy(i) for i in range(n)}
    for k in range(3):
        texts[n + k] = " ".join(template[40 : 60] + [f"o{k}x{i}" for i in range(60)])
    df = spark.createDataFrame(list(texts.items()), "key long, text string")
    groups = connected_components(simhash.similar_texts(df)).groupBy("label").count().collect()
    assert [r["count"] for r in groups] == [n]
    assert sum(counts) < 25 * n and counts[1] < 5000 and counts[2] < 5000


def test_groups_that_meet_at_their_edges(spark, monkeypatch):
    """Two large groups whose centers are apart, with one text of each that is near the other:
    found through the members of the stars that are left."""
    ship(spark)
    draw, counts = random.Random(4), judged_pairs(monkeypatch)
    template = [f"w{i}" for i in range(200)]
    changed = lambda base, places, mark: [f"{mark}{i}" if i in places else w for i, w in enumerate(base)]
    other = changed(template, set(range(0, 24)), "z")
    rows = [changed(template, {100 + draw.randrange(100)}, f"a{i}x") for i in range(60)] + [changed(other, {100 + draw.randrange(100)}, f"b{i}x") for i in range(60)]
    rows += [changed(template, set(range(0, 12)), "z"), changed(other, {30}, "e")]
    texts = {i: " ".join(r) for i, r in enumerate(rows)}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in enumerate(rows)}
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    links = {(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])}
    df = spark.createDataFrame(list(texts.items()), "key long, text string")
    found = {(r["a"], r["b"]) for r in simhash.similar_texts(df).collect()}
    assert found <= links and groups_of(sets, found) == groups_of(sets, links)


def test_random_groups_lose_no_link(spark):
    """Chains and overlapping groups of every similarity, against all pairs."""
    ship(spark)
    for seed in range(3):
        draw = random.Random(seed)
        rows, base = [], [f"s{seed}w{i}" for i in range(90)]
        for i in range(130):
            own = list(draw.choice(rows)) if rows and draw.random() < 0.8 else list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3])):
                own[draw.randrange(len(own))] = f"n{draw.randrange(300)}"
            if draw.random() < 0.3:
                del own[draw.randrange(len(own)) :][: draw.randrange(6)]
            rows.append(own)
        rows = [list(x) for x in dict.fromkeys(map(tuple, rows))]
        sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for k, w in enumerate(rows)}
        links = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
        df = spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], "key long, text string")
        found = {(r["a"], r["b"]) for r in simhash.similar_texts(df).collect()}
        assert found <= links and groups_of(sets, found) == groups_of(sets, links)


def test_shingles_are_ordered_by_all_texts(spark, monkeypatch):
    """Every text counts, however many there are, and counts of tasks add up in two steps."""
    monkeypatch.setattr(simhash, "ORDER_TEXTS", 10, raising=False)
    monkeypatch.setattr(simhash, "ORDER_TASKS", 2, raising=False)
    ship(spark)
    draw = random.Random(8)
    texts = [" ".join(draw.choices("abcdefgh", k=12)) for _ in range(90)]
    want = np.zeros(1 << simhash.ORDER_BITS, dtype="i8")
    for h in shingle_lists(texts, 2):
        want[np.unique(h >> np.uint64(64 - simhash.ORDER_BITS))] += 1
    got = simhash._frequencies(spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(7), 2)
    assert want.max() >= 16
    assert np.array_equal(got, np.where(want < 16, want, 16 + 8 * np.log2(np.maximum(want, 16) / 16)).astype("u1"))
