"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Two lines are the same if their words are, and near if one edit of a word (put in, taken
out or replaced) turns one into the other. Lines of fewer than near_words words match
whole only. A line is dropped if an earlier line of the corpus is the same or near; earlier
means a smaller id, then a smaller place in the text (a null id comes first; rows of equal
id are ordered by the digest of their text). Blank lines always stay.

How near lines are found:

1. Copies of a line become one row, with the place of the first.
2. One edit leaves the first or the second half of a line as it was. Lines that share no
   half with another line of fitting length can't have a near line and go no further.
3. The rest emit the deletion neighbourhood: a hashed key for each word replaced and for
   each word taken out, and one for the whole line, which a longer line may come to. Lines
   with an equal key are within the bound. The minimum of each key is aggregated, never the
   pairs, so that a key may be shared by any number of lines.
4. The word edit distance between a line and the earliest line found for it is verified.

Nulls count as empty texts. Repeated rows come back each, all with the same lines. Empty
tables give empty results. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, ship

NEAR_WORDS = 8
#: Words whose sums are made in one array.
CHUNK = 128


def _normal(line: Column) -> Column:
    """The words with single spaces between. Most lines are so already."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for x in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(line, F.lit(x))
    return F.when(odd, F.trim(F.regexp_replace(line, r"\s+", " "))).otherwise(line)


def _words(normal: Column) -> Column:
    return F.split(normal, " ")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _n_words(normal: Column) -> Column:
    return (F.octet_length(normal) - F.octet_length(F.replace(normal, F.lit(" "), F.lit(""))) + 1).cast("int")


def _half(normal: Column, n: Column, side: str) -> Column:
    """Hash of a line's first n // 2 words, or of its last n - n // 2 ones, as half of a line
    of n words."""
    m = F.floor(n / 2).cast("int")
    part = F.call_function("substring_index", normal, F.lit(" "), m if side == "head" else m - n)
    return F.xxhash64(n, F.lit(side), part)


#: Two hashes of a word and its place. Their sums (by exclusive or) tell lines apart by 96 bits.
_hashes = {"f": lambda w, j: F.xxhash64(w, j), "g": lambda w, j: F.hash(j, w)}


def _xor(values: Column, zero: Column) -> Column:
    return F.aggregate(values, zero, lambda acc, x: acc.bitwiseXOR(x))


def _running(values: Column, zero: Column) -> Column:
    """The exclusive or of all elements before each one. Chunks are summed apart and then
    moved by the chunks before them, since an array grows by copying."""
    begin = F.struct(zero.alias("s"), F.slice(F.array(zero), F.lit(1), F.lit(0)).alias("a"))
    sums = lambda a: F.aggregate(
        a, begin, lambda acc, x: F.struct(acc["s"].bitwiseXOR(x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a"))
    )
    chunks = F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(CHUNK)), lambda at: sums(F.slice(values, at + 1, CHUNK)))
    return F.aggregate(
        chunks,
        begin,
        lambda acc, c: F.struct(acc["s"].bitwiseXOR(c["s"]).alias("s"), F.concat(acc["a"], F.transform(c["a"], lambda x: x.bitwiseXOR(acc["s"]))).alias("a")),
    )["a"]


def _summed(lines: DataFrame) -> DataFrame:
    """lines with what their variants are made of. all_h: the sum of the words' hashes. h: the
    words' hashes by place. down_h: by the place before, which a word has once an earlier one
    is out; move_h: what changes in the sum if all words before a place stay where they are."""
    zeros = {"f": F.lit(0).cast("long"), "g": F.lit(0).cast("int")}
    down = lambda make: lambda w, j: make(w, j - 1)
    own = lines.withColumns({h: F.transform("words", make) for h, make in _hashes.items()})
    own = own.withColumns({f"all_{h}": _xor(F.col(h), zeros[h]) for h in _hashes} | {
        f"down_{h}": F.when(F.col("flags.longer"), F.transform("words", down(make))) for h, make in _hashes.items()
    })
    return own.withColumns({
        f"move_{h}": F.when(F.col("flags.longer"), _running(F.zip_with(h, f"down_{h}", lambda x, y: x.bitwiseXOR(y)), zeros[h])) for h in _hashes
    } | {f"all_down_{h}": _xor(F.col(f"down_{h}"), zeros[h]) for h in _hashes})


def _variants(lines: DataFrame) -> DataFrame:
    """key, spot, role and the hashed key (vkey, check). Role s: word j replaced; role a: the
    longer line without word j; role b: the shorter line as it is."""
    c = F.col
    row = lambda role, vkey, check: F.struct(F.lit(role).alias("role"), vkey.alias("vkey"), check.alias("check"))
    none = F.array().cast("array<struct<role:string,vkey:bigint,check:int>>")
    places = F.sequence(F.lit(0), c("n") - 1)
    without = lambda h, j: c(f"all_{h}").bitwiseXOR(F.get(c(h), j))
    closed = lambda h, j: c(f"all_down_{h}").bitwiseXOR(F.get(c(f"move_{h}"), j)).bitwiseXOR(F.get(c(f"down_{h}"), j))
    replaced = F.transform(places, lambda j: row("s", F.xxhash64(F.lit("s"), c("n"), j, without("f", j)), without("g", j)))
    taken = F.transform(places, lambda j: row("a", F.xxhash64(F.lit("g"), c("n") - 1, closed("f", j)), closed("g", j)))
    whole = F.array(row("b", F.xxhash64(F.lit("g"), c("n"), c("all_f")), c("all_g")))
    made = F.concat(*(F.when(c(f"flags.{flag}"), x).otherwise(none) for flag, x in (("same", replaced), ("longer", taken), ("shorter", whole))))
    return lines.select("key", "spot", F.explode(made).alias("v")).select("key", "spot", "v.*")


def _within_one_edit(x: Column, y: Column) -> Column:
    """Word edit distance of at most one."""

    def one_more(long: Column, short: Column) -> Column:
        n = F.size(short)
        at = F.array_position(F.zip_with(F.slice(long, F.lit(1), n), short, lambda a, b: a != b), True)
        p = F.when(at > 0, at - 1).otherwise(n).cast("int")
        return F.slice(long, p + 2, F.size(long)) == F.slice(short, p + 1, F.size(long))

    unlike = F.size(F.filter(F.zip_with(x, y, lambda a, b: a != b), lambda t: t))
    return (
        F.when(F.size(x) == F.size(y), unlike <= 1)
        .when(F.size(x) == F.size(y) + 1, one_more(x, y))
        .when(F.size(y) == F.size(x) + 1, one_more(y, x))
        .otherwise(False)
    )


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """All columns of df, text_col without its dropped lines, and at the end
    line_dedup_lines and line_dedup_dropped, how many lines the text has and loses."""
    ship(df.sparkSession)
    names, df = df.columns, df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    id_col, text_col = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ref = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text)
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"), ref.alias("ref"))
    split = (
        docs.select("id", "ref", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .withColumn("normal", _normal(F.col("line")))
        .where("normal <> ''")
        .withColumn("key", F.unhex(F.md5(F.col("normal").cast("binary"))))
    )
    spot = F.struct("id", "pos", "ref")
    places = split.select("key", spot.alias("at"))
    same_text = (F.col("ref") == F.col("r")) & F.col("id").eqNullSafe(F.col("i"))

    # 1. distinct lines
    split = split.withColumn("n", _n_words(F.col("normal")))
    n, normal = F.col("n"), F.col("normal")
    halves = F.when(n >= near_words, F.struct(n, *(_half(normal, k, s).alias(f"{s}{i}") for i, k in enumerate((n, n - 1)) for s in ("head", "tail"))))
    distinct = cut(
        split.select("key", spot.alias("at"), halves.alias("h")).groupBy("key").agg(F.min("at").alias("spot"), F.min("h").alias("h"))
    )

    # 2. lines that share a half with a line of fitting length
    long_enough = distinct.where("h is not null")
    tag = lambda name, own: F.struct(F.col(f"h.{name}").alias("half"), F.lit(own).alias("own"))
    halved = long_enough.select(
        "key", F.explode(F.array(tag("head0", True), tag("tail0", True), tag("head1", False), tag("tail1", False))).alias("x")
    ).select("key", "x.half", "x.own")
    shared = (
        halved.groupBy("half")
        .agg(F.count_if("own").alias("owns"), F.count_if(~F.col("own")).alias("longer"))
        .where("owns > 1 or (owns > 0 and longer > 0)")
    )
    flagged = (
        halved.join(shared, "half")
        .groupBy("key")
        .agg(
            F.bool_or(F.expr("own and owns > 1")).alias("same"),
            F.bool_or(F.expr("own and longer > 0")).alias("shorter"),
            F.bool_or(F.expr("not own and owns > 0")).alias("longer"),
        )
        .where("same or shorter or longer")
    )
    wanted = flagged.join(long_enough, "key").select("key", "spot", F.struct("same", "shorter", "longer").alias("flags"))

    per_text = wanted.groupBy(F.col("spot.ref").alias("r"), F.col("spot.id").alias("i")).agg(F.collect_set(F.struct("spot", "key", "flags")).alias("all"))
    lines = cut(
        docs.join(per_text.hint("shuffle_hash"), same_text)
        .select(_lines(F.col("text")).alias("l"), F.explode("all").alias("x"))
        .select("x.*", _words(_normal(F.col("l")[F.col("x.spot.pos")])).alias("words"))
        .withColumn("n", F.size("words"))
    )
    summed = cut(_summed(lines).drop("words"))

    # 3. the deletion neighbourhood
    variants = _variants(summed)
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("spot"))).alias(role)
    earliest = variants.groupBy("vkey", "check").agg(least("s"), least("a"), least("b"), F.count("*").alias("c")).where("c > 1")
    partner = F.when(F.col("role") == "s", F.col("s")).when(F.col("role") == "a", F.col("b")).otherwise(F.col("a"))
    found = variants.join(earliest, ["vkey", "check"]).withColumn("partner", partner).where("partner < spot").select("key", "partner").distinct()

    # 4. verified
    ours = found.join(lines.select("key", F.col("words").alias("own_words")), "key")
    both = ours.join(lines.select(F.col("spot").alias("partner"), "words"), "partner")
    near = cut(both.where(_within_one_edit(F.col("own_words"), F.col("words"))).select("key").distinct())

    # what goes, and the texts without it
    verdict = distinct.select("key", "spot").join(near.withColumn("near", F.lit(True)), "key", "left")
    marks = (
        places.join(verdict, "key")
        .select("at.ref", "at.id", "at.pos", (F.coalesce("near", F.lit(False)) | (F.col("at") > F.col("spot"))).alias("drop"))
        .where("drop")
        .groupBy(F.col("ref").alias("r"), F.col("id").alias("i"))
        .agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    )
    # a flag for each line, so that the filter looks up its own place only
    runs = F.arrays_zip(
        F.concat(F.array(F.lit(-1)), F.col("drops")).alias("from"), F.concat(F.col("drops"), F.array(F.size("l"))).alias("to")
    )
    flags = F.split(F.array_join(F.transform(runs, lambda x: F.concat(F.repeat(F.lit("0"), x["to"] - x["from"] - 1), F.lit("1"))), ""), "")
    whole = df.select(F.struct(*df.columns).alias("row"), ref.alias("ref"), F.col(id_col).alias("id"))
    marked = (
        whole.join(marks.hint("shuffle_hash"), same_text, "left")
        .withColumn("l", _lines(F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))))
        .withColumn("f", F.when(F.col("drops").isNotNull(), flags))
    )
    out = F.when(F.col("drops").isNull(), F.col("row")[text_col]).otherwise(
        F.array_join(F.filter("l", lambda x, i: F.get(F.col("f"), i) == "0"), "\n")
    )
    return marked.select(
        *(out if c == text_col else F.col("row")[c] for c in df.columns), F.size("l"), F.coalesce(F.size("drops"), F.lit(0))
    ).toDF(*names, "line_dedup_lines", "line_dedup_dropped")
