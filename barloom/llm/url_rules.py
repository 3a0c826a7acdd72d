"""URL filters: hand-written host rules first, then association rules mined from labels.

Every URL becomes a set of tokens (host suffixes, path words, query keys).
FP-growth over all labelled URLs, each with one more item for its label, mines token
combinations. Those that imply a label become rules if enough URLs have them (support),
enough of these have the label (confidence), and more of these than of all URLs (lift). A
rule is found through an inverted index: each of its tokens leads to it, and it fits a URL
that has all of them. Of the rules that fit, the one of the largest lift decides, then of
the largest confidence, then one that blocks.

Null URLs and URLs without :// have empty host and path, no tokens, and are allowed, as is
a URL that no rule fits. Repeated rows come back each, and hot URLs are judged once. Empty
tables give empty results; without labels no rule is mined. URLs of any length are taken whole.
Only the named columns are read, so that extra columns of any name do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut

#: Items of the labels in the baskets.
BAD, GOOD = "label=bad", "label=good"
MIN_CONFIDENCE, MIN_LIFT = 0.8, 1.1


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: list[HostRule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; longer hosts win a tie."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens: s=suffix of the host, p=word of the path (p=#n: a number of n digits),
    q=key of the query."""
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda x, i: F.concat(F.lit("s="), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    words = F.filter(F.split(F.lower(path_of(url)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1))), lambda x: x != "")
    mark = lambda a, t: F.transform(a, lambda x: F.concat(F.lit(t), x))
    plain = F.transform(words, lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("#"), F.length(x).cast("string"))).otherwise(x))
    return F.array_distinct(F.concat(suffixes, mark(plain, "p="), mark(keys, "q=")))


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", min_support: float = 0.01, min_confidence: float = MIN_CONFIDENCE, min_count: int = 20, min_lift: float = MIN_LIFT, labels: tuple[str, ...] = (BAD,)) -> DataFrame:
    """rules(rule_id, label, tokens, confidence, lift, support) for the labels, by FP-growth on
    all labelled URLs. A rule holds for a share of min_support of them and for min_count at
    least. Tokens that fewer URLs of each label have can be in no rule and are left out.
    Tokens of the very same URLs are mined as one and stand for each other in the rules, so
    that each such choice is a rule; nothing else is left out. A rule whose tokens include
    those of another rule of its label is not kept."""
    from pyspark.ml.fpm import FPGrowth

    rows = cut(
        labelled.where(F.col(bad_col).isNotNull())
        .select(tokens_of(F.col(url_col).cast("string")).alias("t"), F.col(bad_col).cast("boolean").alias("bad"))
        .withColumn("r", F.monotonically_increasing_id())
    )
    n, n_bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    n, share = max(1, n), {BAD: n_bad / max(1, n), GOOD: 1 - n_bad / max(1, n)}
    # a hair less, so that the count of it does not round up
    min_support = min(1.0, max(min_support, min_count / n)) * (1 - 1e-12)
    spread = rows.select("r", "bad", F.explode("t").alias("token"))
    places = [F.bit_xor(F.xxhash64("r", F.lit(salt))).alias(f"p{salt}") for salt in (0, 1)]
    counted = {BAD: F.count_if("bad"), GOOD: F.count_if(~F.col("bad"))}
    most = F.greatest(*(counted[x] for x in labels), F.lit(0)).alias("b")
    often = spread.groupBy("token").agg(F.count("*").alias("c"), most, *places).where(F.col("b") >= min_support * n)
    classes = cut(often.groupBy("c", "p0", "p1").agg(F.min("token").alias("token"), F.collect_list("token").alias("alike")).select("token", "alike"))
    held = spread.join(classes, "token").groupBy("r").agg(F.collect_list("token").alias("x"))
    none = F.array().cast("array<string>")
    marked = F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD))
    baskets = rows.join(held, "r", "left").select(
        F.concat(F.coalesce("x", none), F.when(marked.isin(*labels), F.array(marked)).otherwise(none)).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = (
        model.associationRules.where((F.size("consequent") == 1) & F.col("consequent")[0].isin(*labels))
        .where(F.size(F.array_intersect("antecedent", F.array(F.lit(BAD), F.lit(GOOD)))) == 0)
        .select(F.col("consequent")[0].alias("label"), F.sort_array("antecedent").alias("tokens"), "confidence", "support")
        .withColumn("lift", F.col("confidence") / F.when(F.col("label") == BAD, share[BAD]).otherwise(share[GOOD]))
        .where((F.col("lift") >= min_lift) | (F.col("confidence") == 1))
    )
    number = F.xxhash64("label", F.array_join("tokens", " ")).alias("rule_id")
    rules = cut(found.select(number, "label", "tokens", "confidence", "lift", "support"))
    short, long = rules.alias("short"), rules.alias("long")
    index = long.select(F.explode("tokens").alias("token"), "rule_id", "label", "tokens")
    first = short.select(F.col("tokens")[0].alias("token"), "label", F.col("tokens").alias("fewer"))
    covered = index.join(first, ["token", "label"]).where(
        (F.size("fewer") < F.size("tokens")) & (F.size(F.array_except("fewer", "tokens")) == 0)
    )
    least = rules.join(covered.select("rule_id").distinct(), "rule_id", "left_anti")
    # every choice of one token out of each class
    choices = F.aggregate(
        F.col("sets"), F.array(none),
        lambda made, alike: F.flatten(F.transform(made, lambda m: F.transform(alike, lambda t: F.concat(m, F.array(t))))),
    )
    own = ["label", "confidence", "lift", "support"]
    return (
        least.select("rule_id", *own, F.explode("tokens").alias("token"))
        .join(classes, "token")
        .groupBy("rule_id", *own)
        .agg(F.collect_list("alike").alias("sets"))
        .select(F.explode(choices).alias("tokens"), *own)
        .select(F.sort_array("tokens").alias("tokens"), *own)
        .select(number, "label", "tokens", "confidence", "lift", "support")
    )


def match(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct URLs that a mined rule fits, with the label, confidence and lift of the rule
    that decides, through the index."""
    own = ["rule_id", "label", "confidence", "lift"]
    index = rules.select(*own, F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    best = F.max(F.struct("lift", "confidence", (F.col("label") == BAD).alias("bad"), "label"))
    return (
        urls.select(F.col(url_col).alias("url"))
        .where("url is not null")
        .distinct()
        .select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
        .join(index, "token")
        .groupBy("url", *own, "size")
        .agg(F.count("*").alias("n"))
        .where("n = size")
        .groupBy("url")
        .agg(best.alias("best"))
        .select(F.col("url").alias(url_col), "best.label", "best.confidence", "best.lift")
    )


def judge(pages: DataFrame, labelled: DataFrame, rules: list[HostRule], id_col: str = "page_id", url_col: str = "url", bad_col: str = "bad", **mining) -> DataFrame:
    """id, host, path, rule, verdict, and the label, confidence and lift of the mined rule that
    decides where no host rule does (null where none fits)."""
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    mined = match(urls, mine(labelled, url_col, bad_col, labels=(BAD, GOOD), **mining), "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    text, verdict = host_rule(F.col("host"), F.col("path"), rules)
    return (
        urls.join(mined, "url", "left")
        .select("id", host.alias("host"), path.alias("path"), "label", "confidence", "lift")
        .select(
            F.col("id").alias(id_col), "host", "path", text.alias("rule"),
            F.coalesce(verdict, F.when(F.col("label") == BAD, "block").otherwise("allow")).alias("verdict"),
            "label", "confidence", "lift",
        )
    )
