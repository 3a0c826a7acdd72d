"""Documents with fewer words than a benchmark item, against a brute force of short windows."""

from collections import Counter

import pytest

from barloom.llm import decontam

ITEM = [f"w{i}" for i in range(50)]
DOCS = {
    1: ITEM[:-1], 2: ITEM[1:], 3: ITEM[:41], 4: ITEM[:40], 5: ITEM[:20] + ["x"] + ITEM[21:49], 6: ITEM, 7: ["a", "b", *ITEM],
    8: ["w1", "w2"], 9: [], 10: [f"v{i}" for i in range(6)], 11: [f"v{i}" for i in range(5)], 12: ITEM[:2] * 20,
}
ITEMS = {1: ITEM, 2: [f"v{i}" for i in range(6)], 3: ITEM[:48] + ["y", "z"]}


def brute():
    out = {}
    for i, d in DOCS.items():
        for j, w in ITEMS.items():
            cut = lambda x: [tuple(x[k : k + 5]) for k in range(len(x) - 4)]
            some, own = cut(d), Counter(cut(w))
            width = min(len(w) - 4, len(some))
            for a in range(len(some) - width + 1) if width else ():
                win = Counter(some[a : a + width])
                v = sum((win & own).values()) / sum((win | own).values())
                if v >= 0.8 and v > out.get((i, j), (0, 0))[0]:
                    out[i, j] = (v, a)
    return out


def test_short_documents(spark):
    docs = spark.createDataFrame([(i, " ".join(d)) for i, d in DOCS.items()], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(d)) for i, d in ITEMS.items()], "item_id long, text string")
    want = brute()
    assert {1, 2, 3} <= {i for i, _ in want} and want[1, 1][0] == pytest.approx(45 / 46)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in decontam.find_contamination(docs, items).collect()}
    assert got == {k: (pytest.approx(v[0]), v[1]) for k, v in want.items()}
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()} == set(DOCS) - {i for i, _ in want}
