"""Source divergence audit: how far the word distributions of a language's sources lie apart.

Tasks count words batch by batch, by (language, source, word), and send one row for each word
that they met; Spark adds these up. For two sources, what matters of a word is its two counts
only. So the words are tallied by (count, count): the words that both sources have come from an
equi-join on the word; the words that one source or neither has are implied by the histograms
of its counts and by the number of kept words, and never become rows. The measure f is then
evaluated once for each combination, times the number of words that have it.

All arithmetic is of integers, in decimals where a product may pass 64 bits.

Null texts, languages and sources count as empty strings. Repeated rows count each. Texts of
any length are taken whole. A source without kept words takes part with counts of zero; a
language without kept words gives its pairs the value 0 and no words. Ties are ordered by the
item's UTF-8 bytes. An empty table gives an empty result. Only the named columns are read, so
that extra columns of any name do no harm.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, ship

#: Each byte of a word as it counts: A-Z in lower case, bytes of other characters than ASCII's
#: as they are; all else is a space.
_word_bytes = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words that a task holds before it sends their counts on, and texts between two looks at that.
HELD_WORDS, LOOK_TEXTS = 400_000, 128


def _sent(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        words = list(n)
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()),
                    pa.array([n[w] for w in part], pa.int64()), pa.array([docs[w] for w in part], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = defaultdict(lambda: (Counter(), Counter()))
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
        for k, (lang, source, text) in enumerate(rows):
            words = text.as_py().translate(_word_bytes).split()
            n, docs = held[lang, source]
            n.update(words)
            docs.update(set(words))
            if k % LOOK_TEXTS == 0 and sum(len(x[0]) for x in held.values()) > HELD_WORDS:
                yield from _sent(held)
                held.clear()
    yield from _sent(held)


def kept_counts(docs: DataFrame, min_docs: int = 30, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n: the occurrences of each word that at least min_docs texts of the
    language have, in each source that has it.

    The tasks' counts are dealt by (lang, term) once; the sums by source and by language both
    stand on that.
    """
    ship(docs.sparkSession)
    named = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    counted = named.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    by_source = (
        counted.withColumn("term", F.col("term").cast("string"))
        .repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    in_lang = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return by_source.withColumn("docs", in_lang).where(F.col("docs") >= min_docs).drop("docs")


def smoothed(count: str, total: str, terms: str, scale: int, extra: int) -> Column:
    """1 + floor(scale * (count + extra) / (total + extra * terms)), exactly."""
    return F.expr(
        f"1 + ((cast({count} as decimal(19,0)) + {extra}) * cast({scale} as decimal(10,0)))"
        f" div (cast({total} as decimal(19,0)) + {extra} * cast({terms} as decimal(12,0)))"
    )


def _joint_counts(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, a, b, ca, cb, times: how many kept words have ca occurrences in source a and cb in
    source b, for every pair a < b; cells with zeros are implied.

    A word of both sources is counted where it stands and taken off its one-sided cells; a word
    of one source is taken off the cell of two zeros, which all kept words start in.
    """
    one, other = cells.alias("x"), cells.alias("y")
    both = (
        one.join(other, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.term") == F.col("y.term")) & (F.col("x.source") < F.col("y.source")))
        .groupBy(F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("ca"), F.col("y.n").alias("cb"))
        .agg(F.count("*").alias("times"))
    )
    zero = F.lit(0).cast("long")
    cell = lambda ca, cb, times: F.struct(ca.alias("ca"), cb.alias("cb"), times.alias("times"))
    of = lambda df, *found: df.select("lang", "a", "b", F.inline(F.array(*found)))
    ca, cb, times = F.col("ca"), F.col("cb"), F.col("times")
    histogram = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    first = pairs.join(histogram.withColumnsRenamed({"source": "a", "n": "ca"}), ["lang", "a"])
    second = pairs.join(histogram.withColumnsRenamed({"source": "b", "n": "cb"}), ["lang", "b"])
    return (
        of(both, cell(ca, cb, times), cell(ca, zero, -times), cell(zero, cb, -times), cell(zero, zero, times))
        .unionAll(of(first, cell(ca, zero, times), cell(zero, zero, -times)))
        .unionAll(of(second, cell(zero, cb, times), cell(zero, zero, -times)))
        .unionAll(pairs.select("lang", "a", "b", zero.alias("ca"), zero.alias("cb"), F.col("terms").alias("times")))
        .groupBy("lang", "a", "b", "ca", "cb")
        .agg(F.sum("times").alias("times"))
        .where("times > 0")
    )


def absolute(p: Column, q: Column) -> Column:
    return F.abs(p - q)


def audit(
    docs: DataFrame,
    min_docs: int = 30,
    top: int = 50,
    f: Callable[[Column, Column], Column] = absolute,
    scale: int = 1_000_000_000,
    extra: int = 5,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part pair: the sum of f over all kept words of the language for each other source, all
    ranks. Part term: the top words that the source has more of than its language, by f.
    f is any expression of two smoothed shares; it need not be symmetric.
    """
    named = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    cells = cut(kept_counts(named, min_docs))
    words = cells.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    langs = words.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(
        named.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
        .distinct()
        .join(langs, "lang", "left")
        .join(totals, ["lang", "source"], "left")
        .na.fill(0, ["terms", "total", "total_lang"])
    )
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source"))).select(
        F.col("a.lang").alias("lang"), F.col("a.source").alias("a"), F.col("b.source").alias("b"),
        F.col("a.terms").alias("terms"), F.col("a.total").alias("total_a"), F.col("b.total").alias("total_b"),
    )
    p, q = smoothed("ca", "total_a", "terms", scale, extra), smoothed("cb", "total_b", "terms", scale, extra)
    apart = (
        _joint_counts(cells, pairs)
        .join(pairs, ["lang", "a", "b"])
        .withColumns({"p": p, "q": q})
        .groupBy("lang", "a", "b")
        .agg(F.sum(f(F.col("p"), F.col("q")) * F.col("times")).alias("ab"), F.sum(f(F.col("q"), F.col("p")) * F.col("times")).alias("ba"))
    )
    # a language without kept words has no combinations
    valued = pairs.select("lang", "a", "b").join(apart, ["lang", "a", "b"], "left").na.fill(0, ["ab", "ba"])
    pair = valued.select(
        "lang",
        F.inline(F.array(
            F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")),
            F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")),
        )),
    ).withColumn("part", F.lit("pair"))
    share, whole = smoothed("n", "total", "terms", scale, extra), smoothed("n_lang", "total_lang", "terms", scale, extra)
    more = (
        cells.join(words, ["lang", "term"])
        .join(groups, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), share.alias("p"), whole.alias("q"))
        .where("p > q")
        .select("lang", "source", "item", f(F.col("p"), F.col("q")).cast("long").alias("value"), F.lit("term").alias("part"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    names = ["lang", "source", "part", "item", "value", "rank"]
    ranked = lambda df: df.withColumn("value", F.col("value").cast("long")).withColumn("rank", F.row_number().over(order)).select(names)
    return ranked(pair).unionAll(ranked(more).where(F.col("rank") <= top))
