"""Benchmark decontamination: SimHash over item-sized windows of every document.

For each benchmark item of n words, windows of n words slide over a document word by word.
A window's fingerprint is looked up in the items of n words through a multi-index: the 64
bits are cut into blocks, each with an allowance of bits. Two fingerprints that differ by more
than its allowance in every block differ by at least the sum of (allowance + 1); the allowances
make that sum radius + 1, so that the lists of all block values within their allowances hold
every item within the radius. Candidates are verified exactly: the weighted
Jaccard similarity (sum of minima over sum of maxima of the shingle counts) must reach the
threshold.

A window without any shingle of the benchmark has similarity zero with all items, so that
fingerprints are made only around places where a shingle of an item occurs; this screen
loses nothing. A document with fewer words than an item is one window, and is verified
against all items that share a shingle with it.

Words are lower-cased and split at ASCII white space and punctuation; shingles have five
words (all words of an item with fewer). Null and blank texts match nothing, nor do null or blank
items. Items that repeat, or share an id, are reported each. Documents are read whole;
repeated rows are judged each. Empty tables give empty results. Other columns pass through
untouched, whatever their names. A benchmark over the size limit of a broadcast is taken in
blocks, one at a time, and the documents are read once for each block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import BROADCAST_LIMIT, kept, ship, work_path
from barloom.llm.shingles import shingles, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
RADIUS = 24
#: Bits of the blocks that a fingerprint is cut into.
BLOCKS = (11, 11, 11, 11, 10, 10)
SCREEN_BITS = 22
SCREENED_BYTES = 1 << 20
#: Windows times items of a length that are looked up at once.
WINDOWS_BY_ITEMS = 1 << 22


def allowances(radius: int, blocks: tuple[int, ...] = BLOCKS) -> list[int]:
    """The bits by which each block may differ: one more of each makes radius + 1. The first
    blocks get what is over."""
    each, over = divmod(radius + 1, len(blocks))
    return [each + (b < over) - 1 for b in range(len(blocks))]


_table = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normal(text: str | None) -> bytes:
    """Words in lower case with spaces between."""
    return (text or "").lower().encode("utf-8", "replace").translate(_table)


def window_fingerprints(hashes: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint of each run of width shingle hashes, from running bit counts."""
    bits = np.unpackbits(hashes.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
    count = np.zeros((len(hashes) + 1, 64), dtype="i4")
    np.cumsum(bits, axis=0, out=count[1:])
    ones = (count[width:] - count[:-width]) * 2 > width
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()


@dataclass
class Items:
    """Items of one length in words."""

    words: int
    size: int
    ids: list = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)
    prints: list[int] | np.ndarray = field(default_factory=list)
    own: list[np.ndarray] = field(default_factory=list)
    lists: list[np.ndarray] = field(default_factory=list)
    with_shingle: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))

    def index(self) -> None:
        for i, c in enumerate(self.counts):
            for x in c:
                self.with_shingle[x].append(i)
        self.own = [np.array(sorted(c), dtype="u8") for c in self.counts]
        self.prints = np.array(self.prints, dtype="u8")
        # lists[b][v]: a bit for each item whose block b is within the allowance of v
        self.lists = []
        for first, bits, most in self._blocks():
            own = self._block(self.prints, first, bits).astype("u2")
            values = np.arange(1 << bits, dtype="u2").reshape(-1, 128, 1)
            self.lists.append(np.concatenate([np.packbits(np.bitwise_count(v ^ own) <= most, axis=1) for v in values]))

    @staticmethod
    def _blocks() -> list[tuple[int, int, int]]:
        """First bit, bits and allowance of the blocks."""
        return [(sum(BLOCKS[:b]), bits, most) for b, (bits, most) in enumerate(zip(BLOCKS, allowances(RADIUS), strict=True))]

    @staticmethod
    def _block(prints: np.ndarray, first: int, bits: int) -> np.ndarray:
        return (prints >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype("i8")

    def listed(self, prints: np.ndarray) -> np.ndarray:
        """For each fingerprint and item, whether a block of theirs is within its allowance."""
        any_list = np.zeros((len(prints), (len(self.ids) + 7) // 8), dtype="u1")
        for (first, bits, _), lists in zip(self._blocks(), self.lists, strict=True):
            any_list |= lists[self._block(prints, first, bits)]
        return np.unpackbits(any_list, axis=1, count=len(self.ids)).view(bool)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a fingerprint and an item within the radius."""
        k, i = np.nonzero(self.listed(prints))
        ok = np.bitwise_count(prints[k] ^ self.prints[i]) <= RADIUS
        return k[ok], i[ok]


def similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class Matcher:
    """The items of one broadcast block in a worker."""

    def __init__(self, items: list[tuple], threshold: float):
        self.threshold = threshold
        by_words: dict[int, Items] = {}
        for item_id, text in items:
            words, _ = word_hashes(normal(text))
            if not len(words):
                continue
            own = by_words.setdefault(len(words), Items(len(words), min(SHINGLE, len(words))))
            h = shingles(words, own.size)
            own.ids.append(item_id)
            own.counts.append(Counter(h.tolist()))
            own.prints.append(int(window_fingerprints(h, len(h))[0]))
        self.by_size: dict[int, list[Items]] = defaultdict(list)
        for own in by_words.values():
            own.index()
            self.by_size[own.size].append(own)
        self.screens = {}
        for size, group in self.by_size.items():
            known = np.unique(np.array([h for own in group for c in own.counts for h in c], dtype="u8"))
            quick = np.zeros(1 << SCREEN_BITS, dtype=bool)
            quick[known >> np.uint64(64 - SCREEN_BITS)] = True
            self.screens[size] = (quick, known)

    def hits(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes, and the places where one is a shingle of an item."""
        quick, known = self.screens[size]
        h = shingles(words, size)
        at = np.flatnonzero(quick[h >> np.uint64(64 - SCREEN_BITS)])
        return h, at[np.isin(h[at], known)] if len(at) else at

    def find_all(self, texts: list[str | None]) -> list[dict]:
        """find of each text; texts are screened together, about a megabyte at a time."""
        found: list[dict] = [{} for _ in texts]
        data, first, size = [], 0, 0
        for k, text in enumerate(texts):
            data.append(normal(text))
            size += len(data[-1]) + 1
            if size >= SCREENED_BYTES or k + 1 == len(texts):
                words, starts = word_hashes(b" ".join(data))
                ends = np.cumsum([len(x) + 1 for x in data])
                of = np.searchsorted(ends, starts, side="right")
                some = {int(of[p]) for s in self.by_size for p in self.hits(words, s)[1]}
                for d in sorted(some):
                    a, b = np.searchsorted(of, (d, d + 1))
                    found[first + d] = self.find(words[a:b])
                data, first, size = [], k + 1, 0
        return found

    def find(self, words: np.ndarray) -> dict:
        """For each item found, (its id, similarity, first word) of its best window, the
        earliest of equals. Items are told apart by their length and number."""
        best: dict = {}
        for size, group in self.by_size.items():
            h, hits = self.hits(words, size)
            if not len(hits):
                continue
            for own in group:
                width = own.words - size + 1
                if len(h) < width:
                    if len(h) >= self.threshold * width - 1e-9:
                        self._whole(own, h, hits, best)
                    continue
                # starts of windows with a hit, joined to runs
                low, high = np.maximum(hits - width + 1, 0), np.minimum(hits, len(h) - width)
                ok = low <= high
                low, high = low[ok], high[ok]
                at = 0
                while at < len(low):
                    a, b = int(low[at]), int(high[at])
                    while at + 1 < len(low) and low[at + 1] <= b + 1:
                        at += 1
                        b = max(b, int(high[at]))
                    at += 1
                    self._run(own, h, a, b, width, best)
        return best

    def _whole(self, own: Items, h: np.ndarray, hits: np.ndarray, best: dict) -> None:
        """A document with fewer words than the items is one window, compared with every item
        that shares a shingle with it."""
        window = Counter(h.tolist())
        for i in sorted({i for x in h[hits].tolist() for i in own.with_shingle.get(x, ())}):
            self._better(own, i, similarity(window, own.counts[i]), 0, best)

    def _better(self, own: Items, i: int, s: float, at: int, best: dict) -> None:
        if s >= self.threshold and s > best.get((own.words, i), (None, 0))[1]:
            best[own.words, i] = (own.ids[i], s, at)

    def _run(self, own: Items, h: np.ndarray, a: int, b: int, width: int, best: dict) -> None:
        h = h[a : b + width]
        prints, step = window_fingerprints(h, width), max(1, WINDOWS_BY_ITEMS // len(own.ids))
        # windows that share fewer shingles with the item can't reach the threshold
        least = 2 * width * self.threshold / (1 + self.threshold) - 1e-9
        for first in range(0, len(prints), step):
            windows, items = own.near(prints[first : first + step])
            for i in np.unique(items).tolist():
                known = np.concatenate([[0], np.cumsum(np.isin(h, own.own[i]))])
                at = windows[items == i] + first
                for k in at[known[at + width] - known[at] >= least].tolist():
                    self._better(own, i, similarity(Counter(h[k : k + width].tolist()), own.counts[i]), a + k, best)


def _matcher(held, threshold: float) -> Matcher:
    return kept(("decontam", held.value[0], threshold), lambda: Matcher(held.value[1], threshold))


def _blocks(items: DataFrame, item_col: str, text_col: str) -> tuple[int, Iterator]:
    """How many blocks the benchmark needs, and broadcasts of the blocks, each within the size
    limit. A block is read when its turn comes."""
    spark = items.sparkSession
    rows = items.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = 1 + 8 * size // BROADCAST_LIMIT

    def held() -> Iterator:
        for b in range(n):
            part = [(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]
            part.sort(key=lambda x: (str(x[0]), x[1]))
            yield spark.sparkContext.broadcast((xxhash.xxh64_intdigest(repr(part).encode()), part))

    return n, held()


def _written(df: DataFrame, n: int, held) -> DataFrame:
    """df, made with a block's broadcast. Of several blocks each is written before the next one
    is read, and its broadcast is let go."""
    if n == 1:
        return df
    path = work_path(df.sparkSession, "decontamination")
    df.write.parquet(path)
    held.unpersist()
    return df.sparkSession.read.parquet(path)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, item, similarity, first_word of the best window of every document and item."""
    ship(docs.sparkSession)
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, similarity double, first_word long"
    out = None
    n, blocks = _blocks(items, item_col, item_text_col)
    for held in blocks:

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            m = _matcher(held, threshold)
            for batch in batches:
                found = [(k, *x) for k, own in enumerate(m.find_all(batch.column(1).to_pylist())) for x in own.values()]
                rows, ids, sims, at = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(ids, pa.int64() if item_type in ("bigint", "int") else pa.string()).cast(
                            {"int": pa.int32(), "bigint": pa.int64()}.get(item_type, pa.string())
                        ),
                        pa.array(sims, pa.float64()),
                        pa.array(at, pa.int64()),
                    ],
                    names=["id", "item", "similarity", "first_word"],
                )

        part = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
        part = _written(part, n, held)
        out = part if out is None else out.unionAll(part)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "similarity", "first_word")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs in which no item is found, all columns as they are."""
    ship(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_col)
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))
    n, blocks = _blocks(items, item_col, item_text_col)
    for held in blocks:

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            m = _matcher(held, threshold)
            for batch in batches:
                yield batch.filter(pa.array([not x for x in m.find_all(batch.column(at).cast(pa.string()).to_pylist())], pa.bool_()))

        docs = _written(docs.mapInArrow(run, docs.schema), n, held)
    return docs.toDF(*names)
