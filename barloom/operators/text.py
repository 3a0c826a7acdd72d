"""Text chunks and retrieval over them."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ends = re.compile(r"(?<=[.!?])(?=\s|$)")


def sentences(text: str) -> list[str]:
    """Cut after . ! or ? before white space or the end; a blank remainder stays as it is."""
    return [s.strip() for s in _ends.split(text) if s]


def _packed(parts: list[str], most: int, joint: str, room: int) -> list[str]:
    out, now = [], ""
    for p in parts:
        if len(now) + len(p) + room <= most:
            now = f"{now}{joint}{p}" if now else p
        else:
            if now:
                out.append(now.strip())
            now = p
    return [*out, now.strip()] if now else out


def chunk(text: str | None, most: int = 1000, overlap: int = 120) -> list[str]:
    """Paragraphs packed to `most` characters; longer ones by sentences. Every chunk but the
    first starts with the last `overlap` characters of the one before."""
    text = (text or "").strip()
    if not text:
        return []
    if len(text) <= most:
        return [text]
    out, run = [], []
    for p in (q.strip() for q in re.split(r"\r\n\r\n|\n\n", text)):
        if len(p) > most:
            out += _packed(run, most, "\n", 2) + _packed(sentences(p), most, " ", 1)
            run = []
        elif p:
            run.append(p)
    out += _packed(run, most, "\n", 2)
    return [c if not i or not overlap else f"{out[i - 1][-overlap:]} {c}" for i, c in enumerate(out)]


#: Articles that are cut at once: the chunks of more are never held.
PART_ROWS = 256


def chunks(articles: DataFrame, id_col: str = "id", text_col: str = "content", most: int = 1000, overlap: int = 120) -> DataFrame:
    """article_id, chunk_index and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PART_ROWS) for b in batches for at in range(0, b.num_rows, PART_ROWS)):
            made = [chunk(t.as_py(), most, overlap) for t in batch.column(1)]
            rows = [k for k, c in enumerate(made) for _ in c]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([i for c in made for i in range(len(c))], pa.int32()), pa.array([x for c in made for x in c], pa.string())],
                names=["article_id", "chunk_index", "text"],
            )

    kind = articles.schema[id_col].dataType.simpleString()
    return articles.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"article_id {kind}, chunk_index int, text string")


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """A stand-in for a remote model: signed word counts by hash, of length one."""
    v = [0.0] * dim
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def embed(chunks_: DataFrame, model=hashed_embedding, dim: int = 64, text_col: str = "text") -> DataFrame:
    """Adds embedding; null where the model gives none or another length."""

    @F.pandas_udf("array<float>")
    def call(texts):
        made = texts.map(lambda t: model(t) if t else None)
        return made.map(lambda v: np.array(v, dtype="f4") if v is not None and len(v) == dim else None)

    return chunks_.withColumn("embedding", call(F.col(text_col)))


def unembedded(chunks_: DataFrame, articles: DataFrame, most: int = 50) -> DataFrame:
    """The chunks still without an embedding, newest articles first."""
    when = articles.select(F.col("id").alias("article_id"), F.coalesce("published_at", "fetched_at").alias("at"))
    lacking = F.col("embedding").isNull() | (F.size("embedding") == 0)
    return chunks_.where(lacking).join(when, "article_id").orderBy(F.desc("at"), "article_id", "chunk_index").limit(most)


def latest_articles(articles: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """A page of the newest articles; size outside 1..100 is 20."""
    size = size if 1 <= size <= 100 else 20
    at = F.coalesce("published_at", "fetched_at")
    return articles.orderBy(F.desc(at), "id").offset((max(page, 1) - 1) * size).limit(size).select("id", "source", "title", "link")


def context(top: DataFrame, chunks_: DataFrame, articles: DataFrame) -> DataFrame:
    """The context text of the found chunks, best first: one row."""
    a = articles.select(F.col("id").alias("article_id"), "title", "source")
    row = top.join(chunks_, ["article_id", "chunk_index"]).join(a, "article_id")
    line = F.format_string("[%s] %s\n%s", "source", "title", "text")
    return row.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), line.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))
