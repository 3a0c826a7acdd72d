"""Spelling variant grouping: words one edit apart, without a row for each pair of them.

Every word is written once for each of its code points, as what is left without that code
point (the prefix and the suffix) and the place. Words that share place, prefix and suffix
differ by one replaced code point: such a group gives each member its size less one and the
best other word, which is the group's first word, or its second for the first itself. A word
that equals what is left of a longer word is that word's near word by deletion, and the longer
ones are its near words by insertion: their number and the best of them. All of this is seen
in groups of one remainder, so that one shuffle serves replacements, deletions and
insertions. A group holds at most (length + 1) * (code points in use) words, so that no group
grows with the data.

Null texts have no words. Repeated rows count each; a null id is written as nothing. Ties
between near words go to the smallest in code-point order. Words without near words have no
form and are their own root. Texts of any length are taken whole; an empty table gives an
empty result. Only the named columns are read, so that extra columns of any name do no harm.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, ship

PATTERN = "[A-Za-zÀ-ÿ]+"
_lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words that a task holds before it sends their counts on, and texts between two looks at that.
HELD_WORDS, LOOK_TEXTS = 500_000, 128


def _sent(held: Counter) -> Iterator[pa.RecordBatch]:
    words = list(held)
    for at in range(0, len(words), 50_000):
        part = words[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[w] for w in part], pa.int64())], names=["word", "n"])


def vocabulary(
    docs: DataFrame, pattern: str = PATTERN, min_length: int = 5, min_count: int = 3, slip_every: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """word, n: the runs of the pattern, A-Z in lower case, of at least min_length code points
    and min_count occurrences.

    slip_every plants slips of the pen, to try the grouping on: where it divides the crc32 h of
    "id:run", that run of that document lacks its code point h % length.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, crc32 = re.compile(pattern).findall, Counter(), zlib.crc32
        for batch in batches:
            for k, (row, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                words = find(text.as_py().translate(_lower).decode("utf-8", "replace"))
                if not slip_every:
                    held.update(words)
                else:
                    begun = crc32(f"{row}:".encode())
                    for word, n in Counter(words).items():
                        h = crc32(word.encode(), begun)
                        if h % slip_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        held[word] += n
                if k % LOOK_TEXTS == 0 and len(held) > HELD_WORDS:
                    yield from _sent(held)
                    held.clear()
        yield from _sent(held)

    return (
        docs.where(F.col(text_col).isNotNull())
        .select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("row"), F.col(text_col).cast("string").cast("binary").alias("text"))
        .mapInArrow(run, "word string, n long")
        .where(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= min_count)
    )


def _remainders(words: DataFrame) -> DataFrame:
    """rest, place, word, n, new: each word without each of its code points, and at place 0 the
    word itself. new is false where the place before gives the same remainder."""
    without = F.expr("""
        transform(sequence(0, length(word)), i -> named_struct(
            'rest', if(i = 0, word, concat(substring(word, 1, i - 1), substring(word, i + 1))),
            'place', i,
            'new', i < 2 or substring(word, i, 1) <> substring(word, i - 1, 1)))
    """)
    return words.select("word", "n", F.inline(without))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best_n, best: how many words are near each word (word, n), and the one
    of largest n among them.

    Numbers are negated where the smallest is taken, so that ties go to the smallest word.
    """
    held = _remainders(words).withColumn("less", F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))).repartition("rest")
    ordered = Window.partitionBy("rest", "place").orderBy("less")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one_rest = Window.partitionBy("rest")
    longer = (F.col("place") > 0) & F.col("new")
    seen = (
        held.withColumns({
            "size": F.count("*").over(whole),
            "first": F.first("less").over(whole),
            "second": F.lead("less").over(ordered),
        })
        .withColumns({
            "shorter": F.max(F.when(F.col("place") == 0, F.col("less"))).over(one_rest),
            "n_longer": F.sum(F.when(longer, 1).otherwise(0)).over(one_rest),
            "longest": F.min(F.when(longer, F.col("less"))).over(one_rest),
        })
    )
    replaced = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    deleted = F.when(longer, F.col("shorter"))
    found = seen.select(
        "word", "n", "place",
        F.when(F.col("place") == 0, F.col("n_longer")).otherwise(F.col("size") - 1 + deleted.isNotNull().cast("long")).alias("near"),
        F.when(F.col("place") == 0, F.col("longest")).when(F.col("size") > 1, F.least(replaced, deleted)).otherwise(deleted).alias("best"),
    ).where("near > 0 or place = 0")
    return found.groupBy("word", "n").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")).select(
        "word", "n", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best")
    )


def group_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n: a word's form is its best near word, if that has at
    least times the word's count; its root is where forms end.

    Counts grow from form to form, so that there are no cycles. Roots are found by doubling: in
    each round, a word takes the root that its root has by now. Each round is one equi-join of
    the words that have a form, cut by a checkpoint.
    """
    near = near_words(words)
    has = F.col("best_n") >= times * F.col("n")
    formed = cut(near.select("word", "n", "n_near", F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        stepped = cut(roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        roots = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            break
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n"
    )
