"""SimHash near-dedup by pivot distance tables.

A fingerprint has one bit for each bit of the shingle hashes: 1 if over half of the hashes
have it. For every fingerprint x, Hamming distances to many reference fingerprints (pivots)
are computed before any pair is looked at. Two facts make them useful:

* |d(x, p) - d(y, p)| <= d(x, y), so that a pair whose largest coordinate difference is over
  the radius is discarded unseen;
* the pivots come in groups, each group inside one block of bits, with one base pivot: the
  distances relative to the base depend on that block alone. Fingerprints that differ in r
  bits thus have equal relative distances in all groups but r, so that pairs need only be
  looked for among fingerprints that agree on some choice of (groups - r) groups.

Survivors are verified by their true Hamming distance. No pair within the radius is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import BROADCAST_LIMIT, cut, release, ship, work_path
from barloom.llm.components import connected_components
from barloom.llm.shingles import shingle_lists

BITS, SEED = 64, 42
#: Fingerprints that share a key and are compared pair by pair; beyond, see near_fingerprints.
PAIRED_GROUP = 48
_ones = np.unpackbits(np.arange(256, dtype="u1").reshape(-1, 1), axis=1, bitorder="little").astype("i8")


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space (bytes.split knows just these)."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words than size: of all of them."""
    if not words:
        return np.empty(0, dtype="<u8")
    joined, size = b" ".join(words), min(size, len(words))
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], dtype="<u8")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from counts of each byte value."""
    lanes = hashes.view("u1").reshape(len(hashes), -1)
    width = lanes.shape[1]
    at = lanes + np.arange(width, dtype="i8") * 256
    return (np.bincount(at.ravel(), minlength=width * 256).reshape(width, 256) @ _ones).ravel()


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id and fp (a long with the 64 bits). Null and blank texts: zero."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(shingle_hashes(words_of(t.as_py()), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["id", "fp"])

    id_type = df.schema[id_col].dataType.simpleString()
    return (
        df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(run, f"id {id_type}, fp long")
        .toDF(id_col, "fp")
    )


def pivots(groups: int) -> list[list[int]]:
    """The reference fingerprints of each group but its base, which is zero: three bits of
    the block each, turned around it, so that the distances tell any two blocks apart."""
    width = BITS // groups
    turn = lambda g, k: sum(1 << (g * width + (k + s) % width) for s in (0, 1, 3))
    return [[turn(g, k) for k in range(width)] for g in range(groups)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot)).cast("long")))


def distance_table(fp: Column, groups: int) -> Column:
    """Distances to the base pivot and to all others, as one array."""
    return F.array(*(_distance(fp, p).cast("byte") for p in [0, *sum(pivots(groups), [])]))


def near_fingerprints(fps: DataFrame, radius: int = 2, paired_group: int = PAIRED_GROUP) -> DataFrame:
    """fps(fp), distinct -> links(a, b): enough of the links within the radius to connect
    all that the links connect.

    Groups that agree on a key and have at most paired_group members are compared pair by
    pair. In a larger group every member instead names the fingerprints up to radius / 2
    away (inside the blocks that the key leaves open) and all that name the same one are
    linked to the least of them: they are within the radius of each other, and any two
    within the radius name a common one. That takes rows in proportion to the group, however
    large, and loses nothing. It needs an even radius.
    """
    if radius not in (0, 2):
        raise ValueError("the radius is 0 or 2")
    groups = radius + 2
    own = pivots(groups)
    base = _distance(F.col("fp"), 0)
    block = [F.xxhash64(F.lit(g), *(_distance(F.col("fp"), p) - base for p in own[g])) for g in range(groups)]
    choices = list(combinations(range(groups), groups - radius))
    width = BITS // groups
    open_bits = [_signed(sum(((1 << width) - 1) << (g * width) for g in range(groups) if g not in c)) for c in choices]
    keyed = (
        fps.select("fp", F.array(*block).alias("block"))
        .select("fp", F.explode(F.array(*(
            F.struct(F.lit(i).alias("choice"), F.xxhash64(F.lit(i), *(F.col("block")[g] for g in c)).alias("key"))
            for i, c in enumerate(choices)
        ))).alias("k"))
        .select("fp", "k.choice", "k.key")
    )
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(keyed.join(shared, "key"))
    tabled = members.where(F.col("n") <= paired_group).select("key", "fp", distance_table(F.col("fp"), groups).alias("d"))
    x, y = tabled.alias("x"), tabled.alias("y")
    largest = F.array_max(F.zip_with("x.d", "y.d", lambda a, b: F.abs(a - b)))
    pairs = (
        x.join(y, "key")
        .where(F.col("x.fp") < F.col("y.fp"))
        .where(largest <= radius)
        .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    flips = [0, *(_signed(1 << b) for b in range(BITS))]
    masks = F.array(*(F.lit(m).cast("long") for m in open_bits))
    named = (
        members.where(F.col("n") > paired_group)
        .select("fp", F.explode(F.array(*(F.lit(m).cast("long") for m in flips))).alias("flip"), masks[F.col("choice")].alias("free"))
        .where("(flip & free) = flip")
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("name"))
        .distinct()
    )
    least = named.groupBy("name").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = named.join(least, "name").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionAll(stars).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest id among the rows whose fingerprints are reachable over
    links of at most radius bits. Rows of equal fingerprints are one class before any pair
    is looked at. Rows without words have fingerprint zero, linked like any other. Null ids
    take part; a class of null ids only has component_id null. Repeated rows come back each.
    An empty table gives an empty result. Only the two named columns are read.
    """
    marked = cut(fingerprints(df, id_col, text_col, shingle))
    classes = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    labels = connected_components(near_fingerprints(classes.select("fp"), radius))
    known = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    named = known.groupBy("label").agg(F.min("least").alias("component_id"))
    return marked.join(known.join(named, "label").select("fp", "component_id"), "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# Near copies by shingle similarity. A prefix of rare shingles gives the candidates, pivot
# distances and fingerprints discard most of them, shingle sets decide.

#: Differing bits up to which a pair of the first pass is verified by its shingles. A
#: similarity of 0.8 gives 10 of 64 on average, with a deviation of 3; unlike texts give 32.
FIRST_RADIUS = 20
#: Orders in which the texts of a shingle choose their leader.
LEADER_ORDERS = 4
#: Slots that order the shingles of prefixes, tasks whose counts are added up at first; texts in
#: a slice of a hot shingle.
ORDER_BITS, ORDER_TASKS, HOT_SLICE = 22, 32, 512
#: Rows of keys that may be broadcast: at most 64 bytes each.
BROADCAST_KEYS = BROADCAST_LIMIT // 64


def _frequencies(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many of all texts have a shingle in each of 2**ORDER_BITS slots. It only sets the
    order of the shingles in prefixes, and any order is exact. A slot's number is a byte: counts
    from 16 on go by their logarithm."""
    chunk = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(1 << ORDER_BITS, dtype="u4")
        for batch in batches:
            for h in shingle_lists(batch.column(1).to_pylist(), shingle):
                total[np.unique(h >> np.uint64(64 - ORDER_BITS))] += 1
        pack, part = zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId() // ORDER_TASKS
        at = [c for c in range(len(total) // chunk) if total[c * chunk : (c + 1) * chunk].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array([part] * len(at), pa.int32()), pa.array([pack(total[c * chunk : (c + 1) * chunk].tobytes()) for c in at], pa.binary())],
            names=["chunk", "part", "counts"],
        )

    def add(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack, unpack = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
            for batch in batches:
                sums = []
                for some in batch.column(1):
                    one = np.zeros(chunk, dtype="u4")
                    for x in some:
                        one += np.frombuffer(unpack(x.as_py()), dtype="u4")
                    if last:
                        sums.append(np.where(one < 16, one, np.minimum(16 + 8 * np.log2(np.maximum(one, 16) / 16), 255)).astype("u1").tobytes())
                    else:
                        sums.append(pack(one.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.binary())], names=["chunk", "counts"])

        return run

    out = np.zeros(1 << ORDER_BITS, dtype="u1")
    rows = texts.select("key", "text").mapInArrow(count, "chunk int, part int, counts binary")
    for last, by in ((False, ["chunk", "part"]), (True, ["chunk"])):
        rows = rows.groupBy(*by).agg(F.collect_list("counts").alias("some")).select("chunk", "some").mapInArrow(add(last), "chunk int, counts binary")
    for r in rows.toLocalIterator():
        out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(r["counts"], dtype="u1")
    return out


def _marks(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """key, size (distinct shingles), fp (their fingerprint) and tokens: the rarest shingles of
    each text in a fixed order, so many that two texts of at least the similarity have one of
    them in common. Texts without words are left out."""
    held = texts.sparkSession.sparkContext.broadcast(_frequencies(texts, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        often = held.value
        for batch in batches:
            sizes, prints, tokens = [], [], []
            for h in shingle_lists(batch.column(1).to_pylist(), shingle):
                h = np.unique(h)
                order = np.lexsort((h, often[h >> np.uint64(64 - ORDER_BITS)]))
                sizes.append(len(h))
                prints.append(fingerprint(h))
                tokens.append(h[order[: prefix_length(len(h), similarity)]].view("i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))],
                names=["key", "size", "fp", "tokens"],
            )

    key_type = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "text").mapInArrow(run, f"key {key_type}, size long, fp long, tokens array<long>").where("size > 0")


def prefix_length(size: int, similarity: float) -> int:
    return size - math.ceil(similarity * size - 1e-9) + 1


def _members(marks: DataFrame) -> DataFrame:
    """key, size, fp, token, pos (the token's place in the prefix) and n (texts that have it)
    of all tokens that several texts have."""
    tokens = marks.select("key", "size", "fp", F.posexplode("tokens").alias("pos", "token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    return tokens.join(shared, "token")


def _led(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: each text with the leaders of its tokens, where pivots and fingerprints let the
    pair pass. A token's leaders are the text with the least share of tokens of its own (in a
    group of near copies, the one that the others are copies of) and the first one in one of
    LEADER_ORDERS orders by hash. There are at most two rows for each token of a text, however
    many texts share it."""
    shared = members.groupBy("key").agg(F.count("*").alias("c"))
    ranked = members.join(shared, "key").withColumn("alone", 1 - F.col("c") / F.col("size"))
    who = [F.col("key"), F.col("size"), F.col("fp")]
    order = F.xxhash64("key", F.pmod("token", F.lit(LEADER_ORDERS)))
    leaders = ranked.groupBy("token").agg(
        F.min(F.struct(F.col("alone").alias("by"), *who)).alias("central"), F.min(F.struct(order.alias("by"), *who)).alias("first")
    )
    table = lambda fp: distance_table(F.col(fp), 4)
    largest = F.array_max(F.zip_with("da", "db", lambda a, b: F.abs(a - b)))
    who = lambda x: [F.col(f"{x}.key").alias("key"), F.col(f"{x}.size").alias("size"), F.col(f"{x}.fp").alias("fp")]
    return (
        members.join(leaders, "token")
        .select("key", "size", "fp", F.explode(F.array(F.struct(*who("central")), F.struct(*who("first")))).alias("to"))
        .where((F.col("key") != F.col("to.key")) & (F.least("size", "to.size") >= similarity * F.greatest("size", "to.size")))
        .select("key", "fp", F.col("to.key").alias("to"), F.col("to.fp").alias("to_fp"))
        .select(F.least("key", "to").alias("a"), F.greatest("key", "to").alias("b"), "fp", "to_fp")
        .dropDuplicates(["a", "b"])
        .withColumns({"da": table("fp"), "db": table("to_fp")})
        .where((largest <= FIRST_RADIUS) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("to_fp"))) <= FIRST_RADIUS))
        .select("a", "b")
    )


def _stars(links: DataFrame) -> DataFrame:
    """key, center, far: each linked text with the one among itself and its links that has most
    links, and its distance (1 - similarity) from it."""
    both = links.select(F.col("a").alias("key"), F.col("b").alias("to"), "similarity").unionAll(links.select(F.col("b").alias("key"), F.col("a").alias("to"), "similarity"))
    degree = both.groupBy("key").agg(F.count("*").alias("links"))
    offered = both.join(degree.withColumnRenamed("key", "to"), "to").select("key", F.struct("links", "to", (1 - F.col("similarity")).alias("far")).alias("x"))
    own = degree.select("key", F.struct("links", F.col("key").alias("to"), F.lit(0.0).alias("far")).alias("x"))
    best = offered.unionAll(own).groupBy("key").agg(F.max("x").alias("x"))
    return best.select("key", F.col("x.to").alias("center"), F.col("x.far").alias("far"))


def _in_slices(rows: DataFrame, key: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of rows with themselves by `by`: a row of the left side meets one
    slice, of the right side it has all, so that a hot key is cut into about HOT_SLICE rows."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / HOT_SLICE).alias("slices"))
    counted = cut(rows.join(counts, [*by]))
    left = counted.withColumn("slice", F.pmod(F.xxhash64(key), F.col("slices")))
    return left.alias("x"), counted.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).alias("y")


def _near_stars(own: DataFrame, similarity: float) -> DataFrame:
    """a, b, least: pairs of centers of different groups whose members share a rare shingle and
    might reach the similarity, and what the centers must reach for that.

    1 - Jaccard similarity is a distance: members within it of each other have centers at most
    that and both radii apart. Members of a group are not compared with each other, and a star
    meets another one once, however many members both have."""
    stars = own.groupBy("token", "label", "center").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max(F.col("size") - F.col("pos")).alias("after"), F.max("radius").alias("radius"))
    mixed = stars.groupBy("token").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q").select("token")
    x, y = _in_slices(stars.join(mixed, "token"), "center", "token")
    wanted = F.ceil((F.col("x.low") + F.col("y.low")) * (similarity / (1 + similarity)) - 1e-6)
    return (
        x.join(
            y,
            (F.col("x.token") == F.col("y.token"))
            & (F.col("x.slice") == F.col("y.slice"))
            & (F.col("x.center") < F.col("y.center"))
            & (F.col("x.label") != F.col("y.label"))
            & (F.col("x.high") >= similarity * F.col("y.low"))
            & (F.col("y.high") >= similarity * F.col("x.low"))
            & (F.least("x.after", "y.after") >= wanted),
        )
        .groupBy(F.col("x.center").alias("a"), F.col("y.center").alias("b"))
        .agg((similarity - F.max("x.radius") - F.max("y.radius")).alias("least"))
    )


def _between(own: DataFrame, stars: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs of members of stars(a, b, similarity), by prefix, size and position, that their
    distances from the centers let be near enough."""
    pairs = stars.select(F.col("a").alias("ca"), F.col("b").alias("cb"), (1 - F.col("similarity")).alias("apart"))
    x = own.join(pairs.withColumnRenamed("ca", "center"), "center").select("token", F.col("center").alias("ca"), "cb", "apart", "key", "size", "pos", "far").alias("x")
    y = own.join(pairs.withColumnRenamed("cb", "center"), "center").select("token", "ca", F.col("center").alias("cb"), "key", "size", "pos", "far").alias("y")
    after = lambda t: F.col(f"{t}.size") - F.col(f"{t}.pos")
    wanted = F.ceil((F.col("x.size") + F.col("y.size")) * (similarity / (1 + similarity)) - 1e-6)
    return (
        x.join(
            y,
            (F.col("x.token") == F.col("y.token"))
            & (F.col("x.ca") == F.col("y.ca"))
            & (F.col("x.cb") == F.col("y.cb"))
            & (F.col("x.far") + F.col("y.far") >= F.col("x.apart") - (1 - similarity) - 1e-9)
            & (F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size"))
            & (F.least(after("x"), after("y")) >= wanted),
        )
        .select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
        .distinct()
    )


def _judged(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs(a, b) whose shingle sets reach the similarity, or their own `least` where they
    have that column, with their similarity. pairs are read twice."""
    key_type = texts.schema["key"].dataType.simpleString()
    pairs = pairs.select("a", "b", F.col("least") if "least" in pairs.columns else F.lit(similarity).alias("least"))
    involved = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    if involved.count() <= BROADCAST_KEYS:
        involved = F.broadcast(involved)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(h).tobytes() for h in shingle_lists(batch.column(1).to_pylist(), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["key", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p, q in zip(batch.column(3), batch.column(4)):
                u, v = np.frombuffer(p.as_py(), dtype="<u8"), np.frombuffer(q.as_py(), dtype="<u8")
                both = len(np.intersect1d(u, v, assume_unique=True))
                found.append(both / max(1, len(u) + len(v) - both))
            ok = pa.array(np.array(found) >= batch.column(2).to_numpy(zero_copy_only=False) - 1e-9, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in (*batch.columns[:2], pa.array(found, pa.float64()))], names=["a", "b", "similarity"])

    hashed = cut(texts.select("key", "text").join(involved, "key", "left_semi").mapInArrow(sets, f"key {key_type}, hashes binary"))
    first, second = hashed.toDF("a", "ha"), hashed.toDF("b", "hb")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "least", "ha", "hb").mapInArrow(run, f"a {key_type}, b {key_type}, similarity double")


def similar_texts(texts: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """texts(key, text), distinct -> links(a, b) of Jaccard similarity of shingle sets at
    least the given one: enough of them to connect all that such links connect.

    Three passes over the rare shingles that texts share. In the first a text meets leaders
    only; pairs whose pivot distances differ by more than FIRST_RADIUS or whose fingerprints
    do are discarded, and the shingle sets decide. The groups so linked are covered by stars:
    a center, and texts linked to it. In the second, centers of different groups meet, and
    are judged by what their radii ask for. In the third, members of those stars that are left
    meet. No link between two groups is lost. Keys of links are ordered. Shingles are compared
    by 64-bit hashes."""
    members = cut(_members(cut(_marks(texts, shingle, similarity))))
    links = cut(_judged(cut(_led(members, similarity)), texts, shingle, similarity))
    groups, stars = connected_components(links), cut(_stars(links))
    radii = stars.groupBy("center").agg(F.max("far").alias("radius"))
    own = cut(
        members.join(groups.withColumnRenamed("node", "key"), "key", "left")
        .join(stars.join(radii, "center"), "key", "left")
        .select(
            "key", "size", "token", "pos", F.coalesce("label", "key").alias("label"), F.coalesce("center", "key").alias("center"),
            F.coalesce("far", F.lit(0.0)).alias("far"), F.coalesce("radius", F.lit(0.0)).alias("radius"),
        )
    )
    close = cut(_judged(cut(_near_stars(own, similarity)), texts, shingle, similarity))
    # stars whose centers are near enough are linked; of the others members must be looked at
    linked = F.col("similarity") >= similarity - 1e-9
    rest = cut(_between(own, close.where(~linked), similarity))
    return links.select("a", "b").unionAll(close.where(linked).select("a", "b")).unionAll(_judged(rest, texts, shingle, similarity).select("a", "b"))


def dedup_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies, the one of the smallest id; all columns stay.

    Texts of the same words are copies; texts linked by similar_texts are near copies; groups
    are closed over both. Texts without words are one group. A null id comes first. Repeated
    rows are copies. An empty table gives an empty result. Other columns pass through
    untouched, whatever their names.
    """
    spark = df.sparkSession
    ship(spark)
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    own_id, own_text = F.col(f"c{df.columns.index(id_col)}"), F.col(f"c{df.columns.index(text_col)}").cast("string")
    spaced = F.translate(F.coalesce(own_text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
    words = F.array_remove(F.split(spaced, " "), "")
    path = work_path(spark, "distinct-texts")
    (
        plain.select(F.unhex(F.md5(F.array_join(words, " ").cast("binary"))).alias("key"), F.struct(own_id.alias("id")).alias("by"), F.struct(*plain.columns).alias("row"))
        .groupBy("key")
        .agg(F.min_by("row", "by").alias("row"))
        .select(F.monotonically_increasing_id().alias("key"), "row.*")
        .write.parquet(path)
    )
    first = spark.read.parquet(path)
    labels = connected_components(cut(similar_texts(first.select("key", own_text.alias("text")), shingle, similarity)))
    named = labels.withColumnRenamed("node", "key").join(first.select("key", own_id.alias("id")), "key")
    keepers = named.groupBy("label").agg(F.min(F.struct("id", "key"))["key"].alias("keeper"))
    losers = named.join(keepers, "label").where("key <> keeper").select("key")
    return first.join(losers, "key", "left_anti").drop("key").toDF(*df.columns)
