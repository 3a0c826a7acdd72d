"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (token bytes and rank a line) becomes a tokenizers BPE model: bytes are mapped
to printable characters as byte-level BPE does, and every way to cut a token into two
tokens of smaller rank becomes a merge, in the order of ranks. Texts are cut by the
pattern; each match is encoded by itself.

Nulls count as empty texts, and empty texts give no ids. Repeated rows are encoded each.
Texts of any length are taken whole. Empty tables give empty results. Only the named
columns are read, so that extra columns of any name do no harm.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import file_broadcast, kept, ship

#: Pieces that a worker remembers, and the longest one it does.
CACHE_PIECES, CACHE_CHARS = 400_000, 48


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it is visible in
    Latin-1, else the next free one from 256 on."""
    visible = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    free = iter(range(256, 512))
    return {b: chr(b if b in visible else next(free)) for b in range(256)}


class ByteBpe:
    """One vocabulary in a worker."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in rank_file.splitlines() if x.strip())}
        self.by_latin1 = byte_characters()
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = t
        self.length_of = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.seen: dict[str, bytes] = {}

    @cached_property
    def model(self):
        """Made when the first text is encoded: a worker that decodes holds the bytes of ids only."""
        from tokenizers import models

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = {t: r for r, t in enumerate(self.bytes_of) if t}
        shown = {t: "".join([self.by_latin1[b] for b in t]) for t in ranks}
        merges = []
        for t, r in ranks.items():
            for i in range(1, len(t)):
                left, right = t[:i], t[i:]
                if ranks.get(left, r) < r and ranks.get(right, r) < r:
                    merges.append((shown[left], shown[right]))
        return models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)

    def _piece(self, piece: str) -> bytes:
        chars = piece.encode("utf-8", "replace").decode("latin-1").translate(self.by_latin1)
        ids = np.array([t.id for t in self.model.tokenize(chars)], dtype="<u4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self.seen) >= CACHE_PIECES:
                self.seen.clear()
            self.seen[piece] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        get, make = self.seen.get, self._piece
        return np.frombuffer(b"".join([get(p) or make(p) for p in self.pattern.findall(text or "")]), dtype="<u4")

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.asarray(ids).tolist()])

    def offsets(self, ids: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character and end character of each token. A token that starts or ends
        inside a character counts that character as its own."""
        ends = np.cumsum(self.length_of[ids])
        starts = ends - self.length_of[ids]
        first = (np.frombuffer(data, dtype="u1") & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(first)])
        inside = np.concatenate([~first, [False]])
        return before[starts] - inside[starts], before[ends]

    def decode_pieces(self, ids) -> list[str]:
        """The text that each id adds; a character cut between ids comes with its last one."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        ids = np.asarray(ids).tolist()
        return [reader.decode(self.bytes_of[i], k + 1 == len(ids)) for k, i in enumerate(ids)]


def model_of(rank_file: bytes, pattern: str) -> ByteBpe:
    return kept(("byte_bpe", hashlib.sha256(rank_file).hexdigest(), pattern), lambda: ByteBpe(rank_file, pattern))


def _lists(made: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, made)], dtype="i4")
    values = np.concatenate(made).astype("i4") if made else np.empty(0, dtype="i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(column) else []


#: Rows that are encoded or decoded at once.
PART_ROWS = 512


def _encoded(model: ByteBpe, texts: list[str]) -> list[pa.Array]:
    """n_tokens, ids, starts and ends of some texts."""
    ids = [model.encode(t) for t in texts]
    spans = [model.offsets(i, t.encode("utf-8", "replace")) for i, t in zip(ids, texts)]
    return [pa.array([len(i) for i in ids], pa.int64()), _lists(ids), _lists([a for a, _ in spans]), _lists([b for _, b in spans])]


def _decoded(model: ByteBpe, ids: pa.Array) -> list[bytes]:
    return [model.decode(x) for x in _arrays(ids)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids, and the character offsets start and end of each id."""
    ship(df.sparkSession)
    held = file_broadcast(df.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(held.value, pattern)
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *_encoded(model, part.column(1).to_pylist())], names=["id", "n_tokens", "ids", "starts", "ends"])

    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_tokens long, ids array<int>, starts array<int>, ends array<int>"
    return _texts(df, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded bytes, decoded text (bytes that are no UTF-8 become U+FFFD) and pieces: the
    text that each id adds. A character that is split between ids comes with its last one."""
    ship(df.sparkSession)
    held = file_broadcast(df.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(held.value, pattern)
        for part in _parts(batches):
            data = _decoded(model, part.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(data, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in data], pa.string()),
                    pa.array([model.decode_pieces(x) for x in _arrays(part.column(1))], pa.list_(pa.string())),
                ],
                names=["id", "data", "text", "pieces"],
            )

    id_type = df.schema[id_col].dataType.simpleString()
    return (
        df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
        .mapInArrow(run, f"id {id_type}, data binary, text string, pieces array<string>")
        .withColumnRenamed("id", id_col)
    )


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encodes with offsets, decodes the ids again, and returns id, n_tokens, the ids as
    little-endian unsigned 32-bit integers (if they are to be kept), both digests, whether the
    text came back and whether the offsets cover it from end to end. Both ways pass in one
    worker, PART_ROWS texts at a time: offsets and ids of more texts are never held."""
    ship(df.sparkSession)
    held = file_broadcast(df.sparkSession, ranks_path)
    names = ["id", "n_tokens", "ids_u32", "ids_sha256", "decoded_sha256", "same_text", "covered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, digest = model_of(held.value, pattern), lambda x: hashlib.sha256(x).hexdigest()
        for part in _parts(batches):
            texts = part.column(1).to_pylist()
            n_tokens, ids, starts, ends = _encoded(model, texts)
            packed, back = [x.astype("<u4").tobytes() for x in _arrays(ids)], _decoded(model, ids)
            covered = [
                len(t) == 0 if not len(a) else a[0] == 0 and b[-1] == len(t) and bool((a[1:] <= b[:-1]).all())
                for t, a, b in zip(texts, _arrays(starts), _arrays(ends))
            ]
            columns = [
                part.column(0), n_tokens, pa.array(packed, pa.binary()), pa.array(map(digest, packed), pa.string()), pa.array(map(digest, back), pa.string()),
                pa.array([x.decode("utf-8", "replace") == t for x, t in zip(back, texts)], pa.bool_()), pa.array(covered, pa.bool_()),
            ]
            keep = [k for k, n in enumerate(names) if keep_ids or n != "ids_u32"]
            yield pa.RecordBatch.from_arrays([columns[k] for k in keep], names=[names[k] for k in keep])

    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_tokens long, " + "ids_u32 binary, " * keep_ids + "ids_sha256 string, decoded_sha256 string, same_text boolean, covered boolean"
    return _texts(df, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
