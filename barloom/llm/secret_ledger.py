"""Secret scans over an incremental blob ledger.

Every version of every file is one row (path, text). A blob is a distinct text, addressed
by its SHA-256. The ledger is a stored table with one row for each pair of blob and rule
version scanned so far, with the findings. update scans only pairs that the ledger lacks,
reads each new blob once however many paths carry it, and appends; findings joins the
ledger back to all paths. A ledger has one writer at a time.

Nulls count as empty texts, and empty texts give no spans. Repeated rows come back each.
Texts of any length are scanned whole. Empty tables add nothing and give an empty result.
Only the named columns are read, so that extra columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import ship

KINDS = ("assign", "access", "hex", "pem", "jwt")
BASE_KINDS = KINDS[:3]
RULE_VERSION = "1"

# The patterns and their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(ACCESS)
#: A run of that many digits starts where the run of HEX starts, so that short runs need not be listed.
_hex = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
_pem = re.compile(r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----")
_jwt = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_words = ("passw", "secret", "token", "apikey", "api_key")
_hex_bytes = bytes(ord("x") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))
_hex_run = b"x" * HEX_LEAST


def find_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then by the order of KINDS. Cheap substring tests come
    before the patterns; they only skip texts in which a pattern can't match."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _words):
        found += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _access.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if _hex_run in text.encode("utf-8", "replace").translate(_hex_bytes):
        found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    if "PRIVATE KEY" in text:
        found += [(m.start(), 3, m.end()) for m in _pem.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), 4, m.end()) for m in _jwt.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [find_spans(t.as_py() or "") for t in batch.column(1)]
        joined = lambda x, kinds: ",".join(f"{k}:{a}:{b}" for a, k, b in x if k in kinds)
        counts = [pa.array([sum(k == kind for _, k, _ in x) for x in spans], pa.int64()) for kind in BASE_KINDS]
        base = pa.array([hashlib.sha256(joined(x, BASE_KINDS).encode()).hexdigest() for x in spans], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, base, pa.array([joined(x, KINDS) for x in spans], pa.string())],
            names=["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


LEDGER = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _blobs(df: DataFrame, path_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(path_col).alias("path"), text.alias("text")).withColumn("blob", F.sha2("text", 256))


def read_ledger(spark: SparkSession, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """What the ledger knows under a rule version."""
    return spark.read.parquet(ledger).where(F.col("rule_version") == rule_version).drop("rule_version")


def update(df: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> None:
    """Scans the blobs of df that the ledger lacks under rule_version and appends them to it.
    A missing ledger is made.

    A text is sent over the network once, to the row that stands for its blob: of rows of the
    same text, that of the smallest path. One key may thus hold any number of copies.
    """
    spark = df.sparkSession
    ship(spark)
    spark.createDataFrame([], LEDGER + ", rule_version string").write.mode("ignore").parquet(ledger)
    blobs = _blobs(df, path_col, text_col)
    first = blobs.groupBy("blob").agg(F.min("path").alias("path")).join(read_ledger(spark, ledger, rule_version).select("blob"), "blob", "left_anti")
    # a blob's row may be there twice (equal path and text), and a path may be null
    unseen = blobs.join(
        first.select(F.col("blob").alias("b"), F.col("path").alias("p")),
        (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")),
        "left_semi",
    )
    new = unseen.select("blob", "text").mapInArrow(_scan, LEDGER).dropDuplicates(["blob"])
    new.withColumn("rule_version", F.lit(rule_version)).write.mode("append").parquet(ledger)


def findings(df: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """The path, n_assign, n_access, n_hex, base_sha256, spans and blob of every row of df whose
    blob the ledger knows."""
    known = read_ledger(df.sparkSession, ledger, rule_version)
    return _blobs(df, path_col, text_col).select("path", "blob").join(known, "blob").select(
        F.col("path").alias(path_col), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob"
    )
