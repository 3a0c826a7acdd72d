"""Token-id output as a content-addressed store.

A document's ids are cut into chunks where a rolling hash of the last ids says so, so that
equal passages give equal chunks wherever they stand. A chunk's address is the BLAKE2b
digest of its ids; every chunk is stored once. The store has three parts, all Parquet:

* chunks: a row for each use of a chunk; the first use of an address has the payload (ids
  as little-endian integers, Zstandard);
* recipes: a row for each document in ascending order, with its start (ids of all documents
  before it), the addresses of its chunks and their Merkle root;
* manifest: a row for each part of the recipes with its first document, its ids and the
  Merkle root of its documents' roots.

Reading back checks every chunk against its address, every recipe against its root and
every part against the manifest. A document's crc32 follows from those of its chunks, since
the crc of a concatenation is the xor of the parts' crcs, each moved past the bytes after it.

Null texts count as empty; every document has at least its end id. Rows may repeat and ids
may be null (they come first); rows of equal id follow their roots. Texts of any length are
read whole. Empty tables give an empty store. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.byte_bpe import byte_characters
from barloom.llm.common import cut, file_broadcast, ship

#: Rolling hash: ids in the window, and one cut in 2**CUT_BITS ids; least and most ids of a chunk.
WINDOW, CUT_BITS, LEAST, MOST = 8, 10, 128, 8192
#: Pieces in a generation of a worker's memory; the last generation is kept besides.
CACHE_WORDS = 300_000
#: Texts that are encoded at once.
BATCH_ROWS = 512
#: Leaves of a node's subtree that are hashed together.
FAN = 1024
#: The steps of a tokenizer whose words can be encoded one by one.
WORD_STEPS = [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]
#: White space outside ASCII's: texts that have some are encoded whole.
_odd_space = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Characters that may compose with a neighbour, or have another lower case elsewhere.
_composing = r"[\x{130}\x{180}-\x{10ffff}]"
#: The pattern of WORD_STEPS, for Arrow: its white space is ASCII's, less the vertical tab.
_piece = WORD_STEPS[2].replace(r"\s", r"\t-\r ")


class WordBpe:
    """A tokenizers file in a worker. If it drops white space and works word by word, words
    are encoded one by one and remembered; else whole texts are encoded."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(file.decode("utf-8"))
        said = json.loads(file)
        try:
            steps = [
                [x["type"] for x in said["normalizer"]["normalizers"]],
                [x["type"] for x in said["pre_tokenizer"]["pretokenizers"]],
                said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
            ]
        except (KeyError, TypeError):
            steps = None
        self.by_word = steps == WORD_STEPS
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.model, self.chars = self.tokenizer.model, byte_characters()
        self.forget()

    def forget(self) -> None:
        """Words and their pieces: a generation and the one before it, so that common ones stay."""
        self.words, self.old_words, self.parts, self.old_parts = {}, {}, {}, {}

    def _full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """The ids of one piece in lower case, by the model alone."""
        chars = part if part.isascii() and part.isprintable() else part.encode("utf-8").decode("latin-1").translate(self.chars)
        return array("I", [t.id for t in self.model.tokenize(chars)]).tobytes()

    def _look_up(self, keys: pa.Array, fresh: dict[str, bytes], old: dict[str, bytes], make) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys in a row, and how many each has; made where not remembered."""
        names, found = keys.to_numpy(zero_copy_only=False).tolist(), []
        for x in names:
            ids = fresh.get(x)
            if ids is None:
                fresh[x] = ids = old.get(x) or make(x)
            found.append(ids)
        return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), "i8", len(found)) // 4

    def encode_all(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text. Arrow splits the texts into words and the distinct words into
        pieces; Python sees each distinct piece of the batch once. Ids are put in place by
        number, pieces to words and words to texts. Words that may compose go through all the
        tokenizer's steps one by one, texts with odd white space as they are."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not self.by_word:
            return [np.frombuffer(self._full(t), dtype="<u4") for t in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, _odd_space)
        split = pc.ascii_split_whitespace(pc.if_else(odd, "", texts))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        hard = pc.match_substring_regex(words, _composing)
        pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.if_else(hard, "", words)), _piece, "\\0 "))
        parts = pieces.flatten().dictionary_encode()
        ids, sizes = self._joined(*self._look_up(parts.dictionary, self.parts, self.old_parts, self._part), parts.indices.to_numpy(), pieces.offsets.to_numpy())
        alone = np.flatnonzero(hard.to_numpy(zero_copy_only=False))
        more, more_sizes = self._look_up(words.take(pa.array(alone)), self.words, self.old_words, self._full)
        # the words in the order of their numbers: those encoded alone come last
        order = np.arange(len(words))
        order[alone] = len(words) + np.arange(len(alone))
        ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, more_sizes])
        flat, lengths = self._joined(ids, sizes, order[coded.indices.to_numpy()], split.offsets.to_numpy())
        out = np.split(flat, np.cumsum(lengths)[:-1])
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = np.frombuffer(self._full(texts[k].as_py()), dtype="<u4")
        if len(self.words) > CACHE_WORDS:
            self.old_words, self.words = self.words, {}
        if len(self.parts) > CACHE_WORDS:
            self.old_parts, self.parts = self.parts, {}
        return out

    @staticmethod
    def _joined(ids: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of items made of numbered parts, and how many each item has: part p has the
        next sizes[p] of ids; item i is numbers[offsets[i] : offsets[i + 1]]."""
        n = sizes[numbers]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[numbers] - ends + n, n) + np.arange(int(n.sum()))
        return ids[at], np.diff(np.append(0, ends)[offsets])

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]


_tokenizers: dict[str, WordBpe] = {}


def tokenizer_of(file: bytes) -> WordBpe:
    key = hashlib.sha256(file).hexdigest()
    if key not in _tokenizers:
        _tokenizers[key] = WordBpe(file)
    return _tokenizers[key]


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW ids says that a chunk may end.
    Streams may be joined: a chunk has more than WINDOW ids, so that no cut looks back over
    the start of its own."""
    n, h = len(ids), np.zeros(len(ids), dtype="u8")
    power = 0x9E3779B97F4A7C15
    wide = ids.astype("u8") + np.uint64(1)
    for k in range(min(WINDOW, n)):
        h[k:] += wide[: n - k] * np.uint64(power)
        power = power * 0xC2B2AE3D27D4EB4F % (1 << 64)
    return np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 1


def chunk_ends(n: int, points: list[int]) -> list[int]:
    """Where the chunks of a stream of n ids end, given its cut points."""
    ends, last = [], 0
    for p in points:
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST and p < n:
            ends.append(p)
            last = p
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n] if last < n or not ends else ends


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def _merkle_levels(leaves: list[bytes]) -> list[list[bytes]]:
    levels = [[address(b"\x00" + x) for x in leaves] or [address(b"")]]
    while len(levels[-1]) > 1:
        nodes = levels[-1]
        levels.append([address(b"\x01" + b"".join(nodes[i : i + 2])) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)])
    return levels


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed up to one node; an odd node goes up as it is."""
    return _merkle_levels(leaves)[-1][0]


def merkle_proof(leaves: list[bytes], at: int) -> list[tuple[str, bytes]]:
    """The nodes beside the way from a leaf up to the root, and their sides: all that is
    needed to prove the leaf without the others."""
    proof = []
    for nodes in _merkle_levels(leaves)[:-1]:
        if at ^ 1 < len(nodes):
            proof.append(("left" if at & 1 else "right", nodes[at ^ 1]))
        at //= 2
    return proof


def proven_root(leaf: bytes, proof: list[tuple[str, bytes]]) -> bytes:
    """The root that a leaf and its proof lead to."""
    node = address(b"\x00" + leaf)
    for side, other in proof:
        node = address(b"\x01" + (other + node if side == "left" else node + other))
    return node


def _shift_tables() -> np.ndarray:
    """tables[k][b][v]: the crc32 register with byte b equal to v, after 2**k zero bytes."""
    step = np.arange(256, dtype="u4")
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype("u4")
    one = lambda r: (r >> np.uint32(8)) ^ step[r & np.uint32(255)]
    tables = [np.stack([one(np.arange(256, dtype="u4") << np.uint32(8 * b)) for b in range(4)])]
    for _ in range(47):
        tables.append(_moved(tables[-1], tables[-1]))
    return np.stack(tables)


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def crc_shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each crc32 adds to that of a stream in which n_bytes follow it."""
    tables, crc = _shift_tables(), crc.astype("u4")
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        crc = np.where(n_bytes >> k & 1, _moved(tables[k], crc), crc)
    return crc


def write_store(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes chunks, recipes and manifest under path. Texts are encoded once; what crosses
    the network is each chunk once from each task, then small rows."""
    import zstandard
    from pyspark import TaskContext

    spark = df.sparkSession
    ship(spark)
    held = file_broadcast(spark, tokenizer_path)
    id_type = df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pack = tokenizer_of(held.value), zstandard.ZstdCompressor(level=1).compress
        row, sent = TaskContext.get().partitionId() << 36, set()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part, take, cols = batch.slice(at, BATCH_ROWS), [], [[] for _ in range(7)]
                kind = "<u4" if bpe.wide else "<u2"
                streams = [np.append(ids, np.uint32(end_id)).astype(kind) for ids in bpe.encode_all(part.column(1))]
                points = cut_points(np.concatenate(streams))
                begin = 0
                for k, ids in enumerate(streams):
                    a, b = np.searchsorted(points, (begin, begin + len(ids)), side="right")
                    first = 0
                    for seq, end in enumerate(chunk_ends(len(ids), (points[a:b] - begin).tolist())):
                        raw = ids[first:end].tobytes()
                        key = address(raw)
                        payload = None
                        if key not in sent:
                            sent.add(key)
                            payload = pack(raw)
                        take.append(k)
                        for c, v in zip(cols, (row, seq, len(ids), end - first, len(ids) - end, key, payload)):
                            c.append(v)
                        first = end
                    row += 1
                    begin += len(ids)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))],
                    names=["id", "row", "seq", "total", "n", "after", "address", "payload"],
                )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bpe in _tokenizers.values():
            bpe.forget()  # the worker has other uses for the memory now
        seen = set()
        for batch in batches:
            keys, has = batch.column(6).to_pylist(), batch.column(7).is_valid().to_pylist()
            new = []
            for key, there in zip(keys, has):
                new.append(there and key not in seen)
                if there:
                    seen.add(key)
            payload = pa.array([p if k else None for p, k in zip(batch.column(7).to_pylist(), new)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], payload], names=batch.schema.names)

    schema = f"id {id_type}, row long, seq int, total long, n long, after long, address binary, payload binary"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows with a payload meet by address; mere uses of a chunk may go anywhere
    spread = F.when(F.col("payload").isNull(), F.pmod("row", F.lit(1 << 10)))
    (
        df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(encode, schema)
        .repartition("address", spread)
        .mapInArrow(once, schema)
        .write.parquet(f"{path}/chunks")
    )

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle_root(x) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*batch.schema.names, "root"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, rank = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(starts), pa.array([part] * len(n), pa.int32()), pa.array(np.arange(rank, rank + len(n)))],
                names=[*batch.schema.names, "local_start", "part", "rank"],
            )
            rank += len(n)

    listed = F.sort_array(F.collect_list(F.struct("seq", "address", "n")))
    recipe = f"id {id_type}, total long, row long, addresses array<binary>, lengths array<long>, root binary"
    (
        spark.read.parquet(f"{path}/chunks")
        .groupBy("id", "row", "total")
        .agg(listed.alias("x"))
        .select("id", "total", "row", F.col("x.address").alias("addresses"), F.col("x.n").alias("lengths"))
        .mapInArrow(rooted, recipe)
        .repartitionByRange(parts, "id", "root", "row")
        .sortWithinPartitions("id", "root", "row")
        .mapInArrow(placed, recipe + ", local_start long, part int, rank long")
        .write.parquet(f"{path}/placed")
    )
    parted = spark.read.parquet(f"{path}/placed")
    # one row for each part: its bounds come to the driver, nothing else
    sums = parted.groupBy("part").agg(F.sum("total").alias("ids"), F.count("*").alias("documents")).orderBy("part").collect()
    rows, before = [], 0
    for r in sums:
        rows.append((r["part"], before, r["ids"], r["documents"]))
        before += r["ids"]
    offsets = spark.createDataFrame(rows, "part int, start long, ids long, documents long")
    parted.join(F.broadcast(offsets.select("part", "start")), "part").select(
        F.col("id").alias("doc"), "row", (F.col("start") + F.col("local_start")).alias("start"), F.col("total").alias("n_tokens"), "addresses", "lengths", "root", "part", "rank"
    ).write.parquet(f"{path}/recipes")
    roots = _part_roots(spark.read.parquet(f"{path}/recipes"))
    offsets.join(roots, "part").write.parquet(f"{path}/manifest")


def _part_roots(recipes: DataFrame) -> DataFrame:
    """part and part_root: the Merkle root of each part over its documents' roots, by their
    rank. Each round replaces every FAN neighbours by their root, so that no task holds more
    than these of a part."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle_root([y["root"] for y in x]) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roots, pa.binary())], names=["part", "rank", "root"])

    level = recipes.select("part", "rank", "root")
    while True:
        level = cut(
            level.groupBy("part", F.floor(F.col("rank") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("rank", "root"))).alias("x"))
            .mapInArrow(up, "part int, rank long, root binary")
        )
        if not level.agg(F.max("rank")).first()[0]:
            return level.select("part", F.col("root").alias("part_root"))


def read_chunks(spark: SparkSession, path: str, wide: bool) -> DataFrame:
    """address, crc (of the ids as unsigned 32-bit integers), n and ok (it is what its
    address says) of every stored chunk."""
    import zstandard

    ship(spark)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            crc, n, ok = [], [], []
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = unpack(payload)
                ids = np.frombuffer(raw, dtype="<u4" if wide else "<u2").astype("<u4")
                crc.append(zlib.crc32(ids.tobytes()))
                n.append(len(ids))
                ok.append(address(raw) == key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int64()), pa.array(ok, pa.bool_())], names=["address", "crc", "n", "ok"]
            )

    stored = spark.read.parquet(f"{path}/chunks").where("payload is not null").select("address", "payload")
    return stored.mapInArrow(check, "address binary, crc long, n long, ok boolean")


def read_index(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """doc, start, n_tokens, ids_crc32 and verified of every document, from the files."""

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, after, keys, good = [], [], [], []
            for k, (names, lengths, root) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                left, same = sum(lengths), merkle_root(names) == root
                for name, n in zip(names, lengths):
                    left -= n
                    rows.append(k)
                    after.append(left)
                    keys.append(name)
                    good.append(same)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), batch.column(6).take(at), pa.array(keys, pa.binary()), pa.array(after, pa.int64()), pa.array(good, pa.bool_())],
                names=["row", "start", "n_tokens", "part", "address", "after", "same"],
            )

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = crc_shifted(batch.column(1).to_numpy().astype("u4"), batch.column(2).to_numpy() * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc.astype("i8")), batch.column(3), batch.column(4)], names=["row", "crc", "n", "ok"])

    ship(spark)
    recipes = spark.read.parquet(f"{path}/recipes")
    used = recipes.select("row", "start", "n_tokens", "addresses", "lengths", "root", "part").mapInArrow(
        uses, "row long, start long, n_tokens long, part int, address binary, after long, same boolean"
    )
    chunks = read_chunks(spark, path, wide)
    added = (
        used.join(chunks, "address")
        .select("row", "crc", "after", "n", (F.col("ok") & F.col("same")).alias("ok"))
        .mapInArrow(moved, "row long, crc long, n long, ok boolean")
        .groupBy("row")
        .agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("read"), F.bool_and("ok").alias("ok"))
    )
    good_parts = (
        spark.read.parquet(f"{path}/manifest")
        .join(_part_roots(recipes).withColumnRenamed("part_root", "again"), "part")
        .select("part", (F.col("part_root") == F.col("again")).alias("part_ok"))
    )
    return (
        recipes.select("doc", "row", "start", "n_tokens", "part")
        .join(added, "row")
        .join(good_parts, "part")
        .select("doc", "start", "n_tokens", "ids_crc32", (F.col("ok") & F.col("part_ok") & (F.col("read") == F.col("n_tokens"))).alias("verified"))
    )


def read_documents(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """doc, start and ids of every document, put together from its recipe."""
    import zstandard

    ship(spark)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = [
                np.concatenate([np.frombuffer(unpack(p), dtype="<u4" if wide else "<u2") for p in parts]).astype("i4").tolist()
                for parts in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc", "start", "ids"])

    recipes = spark.read.parquet(f"{path}/recipes")
    stored = spark.read.parquet(f"{path}/chunks").where("payload is not null").select("address", "payload")
    doc_type = recipes.schema["doc"].dataType.simpleString()
    return (
        recipes.select("doc", "start", F.posexplode("addresses").alias("seq", "address"))
        .join(stored, "address")
        .groupBy("doc", "start")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("x"))
        .select("doc", "start", F.col("x.payload").alias("payloads"))
        .mapInArrow(joined, f"doc {doc_type}, start long, ids array<int>")
    )
