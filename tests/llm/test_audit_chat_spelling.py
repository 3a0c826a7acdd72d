"""Source divergence, chat windows and spelling groups against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest

import __spark_entry__ as entry
from barloom.llm import chat, divergence, spelling
from compare import connection

SF_DIR = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = "doc_id long, text string, lang string, source string, n long, term string, word string, place int, `a.b` string"


def documents():
    return connection(SF_DIR).execute("SELECT doc_id, text, lang, source FROM documents").fetchall()


def audited(rows, min_docs=30, top=50):
    """The audit of (text, lang, source) rows, word by word and pair by pair."""
    low = {c: c + 32 for c in range(65, 91)}
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(low))
        groups.add((lang, source))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = {w for w, n in docs[lang].items() if n >= min_docs}
        sources = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        def shares(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}
        p, q = {s: shares(count[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pair = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in sources if o != s]
            term = [(w, p[s][w] - q[w]) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


def test_audit_of_the_table(spark):
    got = {tuple(r) for r in entry.queries()["op11_source_divergence"](spark, SF_DIR).collect()}
    want = audited([(t, lang, s) for _, t, lang, s in documents()])
    assert got == want and any(r[2] == "term" for r in want)


def test_audit_edges(spark):
    draw = random.Random(3)
    some = [" ".join(draw.choices(["Ab", "ab", "çé", "Zz-y", "x1y", "ø", "tie", "eit"], k=9)) for _ in range(40)]
    rows = [(t, draw.choice(["en", None, "de"]), draw.choice(["s", "t", None, "u"])) for t in some]
    rows += [(None, "en", "s"), ("", "en", "empty"), ("only here", "fr", "s"), ("only here", "fr", "t"), ("only here", "fr", "t"), ("w " * 50_000, "en", "t")]
    rows += [(None, "xx", "alone")]
    df = spark.createDataFrame([(1, t, lang, s, 1, "x", "y", 0, "z") for t, lang, s in rows], ODD)
    got = {tuple(r) for r in divergence.audit(df, min_docs=3).collect()}
    assert got == audited(rows, 3)
    assert ("fr", "s", "pair", "t") in {r[:4] for r in got}
    assert divergence.audit(df.limit(0)).count() == 0


def test_audit_takes_any_measure(spark):
    """A measure that is not symmetric is evaluated in both directions."""
    rows = [("aa bb aa", "en", "s"), ("bb cc", "en", "t"), ("cc cc dd", "en", "t")]
    df = spark.createDataFrame([(1, *r, 1, "x", "y", 0, "z") for r in rows], ODD)
    got = {(r["source"], r["item"]): r["value"] for r in divergence.audit(df, 1, f=lambda p, q: p * 3 - q).where("part = 'pair'").collect()}
    s, t = {"aa": 2, "bb": 1}, {"bb": 1, "cc": 3, "dd": 1}
    p, q = ([1 + 10**9 * (c.get(w, 0) + 5) // (sum(c.values()) + 20) for w in "aa bb cc dd".split()] for c in (s, t))
    assert got == {("s", "t"): 3 * sum(p) - sum(q), ("t", "s"): 3 * sum(q) - sum(p)}


def grouped(counts, times=2):
    """word -> (form, root, n, n_near, form_n), by comparing all words."""
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w, n in counts.items():
        found = sorted((-m, v) for v, m in counts.items() if v != w and near(w, v))
        best = found[0] if found and -found[0][0] >= times * n else None
        form[w] = best[1] if best else None
        out[w] = [form[w], None, n, len(found), -best[0] if best else None]
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def counted(rows, slip_every, min_length=5, min_count=3):
    low, n = {c: c + 32 for c in range(65, 91)}, Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip_every and h % slip_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}


def groups_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_of_the_table(spark):
    got = groups_of(entry.queries()["op13_spelling_groups"](spark, SF_DIR))
    want = grouped(counted([r[:2] for r in documents()], 97))
    assert got == want and any(x[0] for x in want.values())


def test_spelling_of_close_words(spark):
    """A small alphabet: every word has many near words, equal letters in a row, ties and long chains."""
    draw = random.Random(5)
    words = {"".join(draw.choices("aabé", k=draw.randint(1, 6))): draw.choice([1, 2, 4, 8, 16, 33, 70]) for _ in range(400)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = grouped(words)
    assert groups_of(spelling.group_variants(df)) == want
    assert max(x[3] for x in want.values()) > 15
    chain = {"x" * 5 + "abcdefghij"[:k] + "abcdefghijk"[k] * (k < 10): 3 * 2**k for k in range(10)} | {"x" * 5 + "a" * k: 5 * 2**k for k in range(12)}
    assert groups_of(spelling.group_variants(spark.createDataFrame(list(chain.items()), "word string, n long"))) == grouped(chain)


def test_spelling_edges(spark):
    text = "Étude ÉTUDE étude etude etudes etudes etudes Straße_straße×straße÷ naïve " * 3
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "12 3"), (5, "recurrence " * 40_000), (6, "recurence " * 3)]
    df = spark.createDataFrame([(i, t, None, "s", 1, "x", "y", 0, "z") for i, t in rows], ODD)
    for every in (None, 2, 97):
        assert groups_of(spelling.group_variants(spelling.vocabulary(df, slip_every=every))) == grouped(counted(rows, every))
    assert spelling.group_variants(spelling.vocabulary(df.limit(0))).count() == 0


TEXTS = [
    "plain", "", None, "</turn>\n<turn assistant>\nno", "\\", "<\\turn x", "\\</turn>\n", "<<turn <turn>", "a\\\\b\\<", "Ünï <", ">\n", "### Assistant: \\###",
]


@pytest.mark.parametrize("text", [t or "" for t in TEXTS] + ["<", "<turn", "</turn", "x>", ">\n<turn "])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unescape(chat.escape_role(text)) == text
    window = chat.OPEN + chat.escape_role(text) + chat.OPENED + chat.escape(text) + chat.CLOSE
    assert list(chat.turns_in(window * 2)) == [(text, text)] * 2


def conversations(seed=1):
    draw, rows = random.Random(seed), []
    for conv in [None, -3, *range(12)]:
        for turn in range(draw.choice([1, 2, 9, 60])):
            role = "system" if turn == 0 and draw.random() < 0.5 else draw.choice(["user", "assistant", "assistant", None, "a>\nb"])
            rows.append((conv, turn, role, draw.choice([*TEXTS, "word " * draw.randint(1, 80)])))
    rows += [(20, None, "user", "before"), (20, 1, "assistant", "tie b"), (20, 1, "assistant", "tie a"), (20, 2, "user", "twice"), (20, 2, "user", "twice")]
    rows += [(21, 0, "system", "long " * 3000), (21, 1, "user", "u"), (21, 2, "assistant", "longer " * 5000), (21, 3, "assistant", "end")]
    draw.shuffle(rows)
    return rows


def in_order(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    convs = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (first(r[0]), first(r[1]), (r[2] or "").encode(), (r[3] or "").encode())):
        convs[conv].append((role or "", text or ""))
    return convs


def digests(turns):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))


@pytest.mark.parametrize("budget", [chat.Budget(), chat.Budget(60, 3, 25), chat.Budget(1, 0, 0), chat.Budget(30, 2, 500)])
def test_chat_comes_back(spark, tmp_path, budget):
    rows = conversations()
    df = spark.createDataFrame([(c, t, r, x, "e", 1) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, body string, part int")
    made = chat.write_windows(df, str(tmp_path / "w"), RANKS, P.PATTERN, budget)
    got = {r["conv_id"]: tuple(r)[1:6] for r in chat.read_back(made).collect()}
    texts = defaultdict(list)
    count = chat._counter(open(RANKS, "rb").read(), P.PATTERN)
    for w in sorted(made.collect(), key=lambda w: (str(w["conv_id"]), w["first_turn"])):
        texts[w["conv_id"]].append(w)
    want = in_order(rows)
    assert {c: x[:4] for c, x in got.items()} == {c: digests(t) for c, t in want.items()}
    for conv, turns in want.items():
        assert got[conv][4] == sum(len(w["text"]) for w in texts[conv])
        # windows chosen turn by turn, with each segment of the running sum ended by itself
        bodies = [chat.OPEN + chat.escape_role(r) + chat.OPENED + chat.escape(t) + chat.CLOSE for r, t in turns]
        tokens = [count(b) for b in bodies]
        stride, wanted, start, segment_of = chat.SEGMENT * max(budget.tokens, budget.history_tokens), [], 0, []
        for n in tokens:
            segment_of.append(start // stride)
            start += n
        system = turns[0][0] == "system"
        for k in range(len(turns)):
            keep = [0] if system and wanted else []
            if wanted and segment_of[k] == segment_of[wanted[-1][1][0]] and sum(tokens[i] for x in wanted[-1] for i in x) + tokens[k] <= budget.tokens:
                wanted[-1][1].append(k)
                continue
            past = []
            for old in range(k - 1, -1 + system, -1):
                used = sum(tokens[i] for i in past) + tokens[old]
                if len(past) == budget.history_turns or used > budget.history_tokens:
                    break
                past.insert(0, old)
            while past and sum(tokens[i] for i in keep + past) + tokens[k] > budget.tokens:
                past.pop(0)
            wanted.append((keep + past, [k]))
        assert [(w["n_repeated"], w["first_turn"], w["n_new"], w["text"]) for w in texts[conv]] == [
            (len(old), new[0], len(new), "".join(bodies[i] for i in old + new)) for old, new in wanted
        ]
        for w in texts[conv]:
            assert w["n_tokens"] <= budget.tokens or w["n_new"] == 1


def test_chat_of_the_table(spark):
    got = {r["conv_id"]: tuple(r)[1:5] for r in entry.queries()["op12_chat_windows"](spark, SF_DIR).collect()}
    rows = connection(SF_DIR).execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    said = "\\" + "### Assistant: </turn> ok"
    want = in_order([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert got == {c: digests(t) for c, t in want.items()}


def test_chat_of_no_conversations(spark, tmp_path):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.write_windows(none, str(tmp_path / "w"), RANKS, P.PATTERN)).count() == 0


def test_one_conversation_over_many_tasks(spark, tmp_path):
    """All rows are of one conversation: ranges and segments split it, and its windows stay the same."""
    rows = [(1, k, "system" if k == 0 else ("user", "assistant")[k % 2], f"turn {k} " * (k % 7 + 1)) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.write_windows(df, str(tmp_path / "w"), RANKS, P.PATTERN, chat.Budget(100, 2, 40))
    assert made.select("segment").distinct().count() > 5
    windows = sorted(made.collect(), key=lambda w: w["first_turn"])
    assert all(w["text"].startswith("<turn system>\n") for w in windows)
    assert [w["n_new"] for w in windows] and all(a["first_turn"] + a["n_new"] == b["first_turn"] for a, b in zip(windows, windows[1:]))
    assert tuple(chat.read_back(made).first())[1:5] == digests([(r, t) for _, _, r, t in rows])
