"""The registered queries of the thirteen operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bm25, byte_bpe, chat, decontam, divergence, line_dedup, secret_ledger, simhash, spelling, token_store, toxicity, url_rules, warc_zip
from barloom.llm.common import cut, table, work_path


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep_ids=False)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        F.col("line_dedup_lines").cast("long").alias("n_lines"),
        F.col("line_dedup_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), places AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM docs
), worded AS (
  SELECT doc_id, pos, line,
         list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '') AS w
  FROM places
), marked AS (
  SELECT doc_id, pos, line, w, len(w) AS n, array_to_string(w, ' ') AS k FROM worded
), firsts AS (
  SELECT k, any_value(w) AS w, any_value(n) AS n,
         min(struct_pack(d := doc_id, p := pos)) AS spot
  FROM marked WHERE n > 0 GROUP BY k
), without AS (
  SELECT k, spot, n, j,
         array_to_string(list_concat(w[1:j - 1], w[j + 1:]), ' ') AS rest
  FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM firsts WHERE n >= 8)
), replaced AS (
  SELECT a.k FROM without a
  JOIN (SELECT n, j, rest, min(spot) AS m FROM without GROUP BY n, j, rest) g
    ON a.n = g.n AND a.j = g.j AND a.rest = g.rest
  WHERE g.m < a.spot
), apart AS (
  SELECT a.k AS long_k, a.spot AS long_spot, b.k AS short_k, b.spot AS short_spot
  FROM without a JOIN firsts b ON a.rest = b.k AND b.n >= 8
), near AS (
  SELECT k FROM replaced
  UNION SELECT long_k FROM apart WHERE short_spot < long_spot
  UNION SELECT short_k FROM apart WHERE long_spot < short_spot
), verdict AS (
  SELECT m.doc_id, m.pos, m.line,
         m.n > 0 AND (f.spot < struct_pack(d := m.doc_id, p := m.pos) OR m.k IN (SELECT k FROM near)) AS gone
  FROM marked m LEFT JOIN firsts f ON m.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(gone, false)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM verdict GROUP BY doc_id
"""


OP6_SQL = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), heads AS (
  SELECT digest, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN heads ON p.digest = heads.digest
"""

OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+')) AS term
  FROM documents
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), dls AS (
  SELECT doc_id, sum(tf) AS dl FROM tfs GROUP BY doc_id
), stats AS (
  SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dls) / (SELECT count(*) FROM documents) AS avgdl
), idfs AS (
  SELECT term, greatest(0, ln((n - df + 0.5) / (df + 0.5))) AS idf
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), stats
), scored AS (
  SELECT q.doc_id AS doc_id, t.doc_id AS found_id,
         round(sum(q.tf * idf * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tfs q JOIN idfs USING (term) JOIN tfs t USING (term) JOIN dls ON dls.doc_id = t.doc_id, stats
  WHERE q.doc_id % 100 = 0 AND idf > 0
  GROUP BY q.doc_id, t.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, found_id) AS rank FROM scored WHERE score > 0
)
SELECT doc_id, rank::INTEGER AS rank, found_id, score FROM ranked WHERE rank <= 10
"""


#: The host rules of the contract.
HOST_RULES = [
    url_rules.HostRule("block", "com", "/en/"),
    url_rules.HostRule("allow", "example.com", "/en/7"),
    url_rules.HostRule("allow", "net", "/de/"),
    url_rules.HostRule("block", "example.net", "/de/8"),
    url_rules.HostRule("block", "org", "/es/"),
]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document of the same id: bad if of low quality or toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    return url_rules.judge(pages, pages.select("page_id", "url").join(bad, "page_id"), HOST_RULES)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store goes to a new folder under spark.checkpoint.dir."""
    path = work_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_index(spark, path).withColumnRenamed("doc", "doc_id")


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives go to a new folder under spark.checkpoint.dir."""
    path = work_path(spark, "archives")
    warc_zip.write_archives(table(spark, sf_dir, "pages"), path)
    return warc_zip.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is a new one under spark.checkpoint.dir; the findings are read from it."""
    docs, ledger = table(spark, sf_dir, "documents"), work_path(spark, "ledger")
    secret_ledger.update(docs, ledger)
    return secret_ledger.findings(docs, ledger)


def op8_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_outside_fold(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op9_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of the documents whose id is divisible by 100, against all documents."""
    docs, path = table(spark, sf_dir, "documents"), work_path(spark, "bm25")
    bm25.build_index(docs, path)
    return bm25.search(spark, path, docs.where("doc_id % 100 = 0"), k=10)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "first_word")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, top=50)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5b-\x60\x7b-\x7f]+') AS w
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), cells AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (
  SELECT lang, count(DISTINCT term) AS v, sum(n) AS total FROM cells GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (t.total + 5 * l.v) AS p
  FROM totals t JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN cells c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), whole AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 5) // (any_value(total) + 5 * any_value(v)) AS q
  FROM cells JOIN langs USING (lang) GROUP BY lang, term
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, (p - q)::BIGINT FROM shares s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows go to a new folder under spark.checkpoint.dir; the digests are read from them."""
    marked = "\\### Assistant: </turn> ok"
    convs = chat.with_conversation(table(spark, sf_dir, "conversations"), -7, [("user", marked), ("assistant", marked)])
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    written = chat.write_windows(convs, work_path(spark, "chat-windows"), ranks, public_tokenizers.PATTERN)
    return chat.read_back(written)


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), min_length=5, min_count=3, slip_every=97)
    return spelling.group_variants(cut(words))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_pivots, op2_byte_bpe, op3_line_dedup, op4_url_rules, op5_token_store, op6_warc_zip, op7_secret_ledger, op8_toxicity_nb, op9_bm25_wand, op10_decontamination, op11_source_divergence, op12_chat_windows, op13_spelling_groups)
}
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op6_warc_zip": OP6_SQL, "op9_bm25_wand": OP9_SQL, "op11_source_divergence": OP11_SQL}
