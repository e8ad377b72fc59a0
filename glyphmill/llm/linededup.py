"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line's symbols are its words; lines without a word are left alone. Lines of near_words words or more are within the
bound if one word is replaced, added or left out; the bound of shorter ones, where a word is a large share, is 0, so
they only match if equal. Every line but the earliest of those within the bound goes.

Deleting one word gives a line's neighbourhood; equal members are joined by 64-bit keys, and the pairs are verified.
The key of a line without its j-th word comes from the line's running hashes, so a line of n words costs n keys, not n
strings. Two lines within the bound share their beginning or their end, so lines that share neither with another line
can't have a partner, and their neighbourhood isn't written out.

Bit tables of at most TABLE_ROWS rows are broadcast to spare rows a shuffle that no join would keep; they never decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.llm.nativetext import words
from glyphmill.session import materialise

#: Words from which a line is compared within one word.
NEAR_WORDS = 8
#: Rows of 64 bits of a bit table, at most.
TABLE_ROWS = 1 << 18
#: A line that holds more than a HOT-th of all rows is joined by broadcast; there are fewer than HOT of them.
HOT = 1000
#: A line from its first word on; lines are cut at \n.
_WORDED = r"[^\x20\x09-\x0D][^\n]*"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, line, n, h1, h2): each line with a word, its words joined by single spaces, their
    number, and two hashes that tell lines apart."""
    loose = F.startswith("line", F.lit(" ")) | F.endswith("line", F.lit(" "))
    for gap in ("  ", "\t", "\x0b", "\x0c", "\r"):
        loose |= F.contains("line", F.lit(gap))
    line = F.when(loose, F.array_join(words(F.col("line")), " ")).otherwise(F.col("line"))  # most lines are such already
    # hashed before the lines are exploded: beside a generator the whole text would be hashed again for each of its lines
    each = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    each = each.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    each = each.withColumn("line", line).where("line != ''")
    count = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return each.select("doc_id", "text_hash", "line_no", "line", count.alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _ends(near_words: int) -> Column:
    """(k, head) for the ends that a line shares with a partner: beginnings and ends of h words, h the same for lines of
    4i to 4i + 3 words, and where the count is 4i those of a line with a word less."""

    def both(h: Column) -> list[Column]:
        head = F.xxhash64(F.lit("head"), h, F.call_function("substring_index", "line", F.lit(" "), h))
        tail = F.xxhash64(F.lit("tail"), h, F.call_function("substring_index", "line", F.lit(" "), -h))
        return [F.struct(head.alias("k"), F.lit(True).alias("head")), F.struct(tail.alias("k"), F.lit(False).alias("head"))]

    n = F.col("n")
    own = both((F.shiftright(n, 2) * 2).cast("int"))
    less = both((F.shiftright(n, 2) * 2 - 2).cast("int"))
    return F.when((n % 4 == 0) & (n > near_words), F.array(*own, *less)).otherwise(F.array(*own))


def _slot(key: str) -> list[Column]:
    """The row and the bit of a key in a bit table."""
    return [F.col(key).bitwiseAND(TABLE_ROWS - 1), F.shiftrightunsigned(key, 20).bitwiseAND(63).cast("int")]


def may_hold(frame: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is among ``keys`` and some others, by a broadcast bit table."""
    row, bit = _slot(key)
    table = keys.groupBy(row.alias("_slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    joined = frame.withColumn("_slot", row).join(F.broadcast(table), "_slot")
    return joined.where(F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(1) == 1).drop("_slot", "_bits")


def _same_but_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are within one replaced, added or left-out word."""
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    longer, shorter = F.when(F.size(a) > F.size(b), a).otherwise(b), F.when(F.size(a) > F.size(b), b).otherwise(a)
    found = F.array_position(F.zip_with(longer, shorter, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    rest = F.slice(longer, found + 1, F.size(longer)) == F.slice(shorter, found, F.size(longer))
    return F.when(F.size(a) == F.size(b), differ <= 1).otherwise((F.abs(F.size(a) - F.size(b)) == 1) & (found > 0) & rest)


def _near(lines: DataFrame, near_words: int) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line within one word of them."""
    long = lines.where(F.col("n") >= near_words)
    ends = long.select("h1", "h2", F.explode(_ends(near_words)).alias("x")).select("h1", "h2", "x.k", "x.head")
    shared = materialise(ends.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo != hi").select("k"), "line-ends")
    able = may_hold(ends, "k", shared).distinct().join(shared, "k", "left_semi")
    able = materialise(able.groupBy("h1", "h2").agg(F.max("head").alias("head"), F.min("head").alias("only")).select("h1", "h2", "head", (~F.col("only")).alias("tail")), "line-able")
    found = may_hold(long, "h1", able).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no", "h1")).alias("at"), F.any_value("line").alias("line"), F.any_value("n").alias("n"))
    texts = materialise(found.join(able, ["h1", "h2"]), "line-candidates")

    # dealt as lines, so that the windows over a line's words need no shuffle of words
    each = texts.repartition("h1", "h2").select("h1", "h2", "n", "head", "tail", F.posexplode(F.split("line", " ")).alias("j", "word"))
    each = each.withColumn("here", F.xxhash64("word", "j")).withColumn("left", F.xxhash64("word", F.col("j") - 1)).drop("word")
    whole = Window.partitionBy("h1", "h2")
    before = whole.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    to_here = whole.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    each = (
        each.withColumn("p", F.coalesce(F.bit_xor("here").over(before), F.lit(0)))
        .withColumn("q", F.bit_xor("left").over(to_here))
        .withColumn("all_here", F.bit_xor("here").over(whole.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("all_left", F.bit_xor("left").over(whole.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    # a shared beginning leaves the edit to what follows it, a shared end to what stands before
    least = F.shiftright(F.col("n") - 1, 2) * 2
    each = each.where((F.col("head") & (F.col("j") >= least)) | (F.col("tail") & (F.col("j") <= F.col("n") - 1 - least)))
    replaced = F.xxhash64(F.lit("replaced"), "n", "j", F.col("all_here").bitwiseXOR(F.col("here")))
    dropped = F.xxhash64(F.lit("dropped"), F.col("n") - 1, F.col("p").bitwiseXOR(F.col("all_left")).bitwiseXOR(F.col("q")))
    itself = F.xxhash64(F.lit("dropped"), "n", "all_here")
    kinds = F.array(
        F.struct(replaced.alias("k"), F.lit(0).alias("kind")),
        F.struct(dropped.alias("k"), F.lit(1).alias("kind")),
        F.when(F.col("j") == F.floor(F.col("n") / 2), F.struct(itself.alias("k"), F.lit(2).alias("kind"))),
    )
    members = materialise(each.select("h1", F.explode(kinds).alias("x")).where("x is not null").select("h1", "x.k", "x.kind"), "line-members")
    met = materialise(members.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo != hi").select("k"), "line-met")
    # met keys are distinct; a semi-join would be moved below the bit table, so that all members were shuffled
    members = materialise(may_hold(members, "k", met).join(met, "k").select("h1", "k", "kind"), "line-meetings")
    # what follows needs only the lines that met another one
    texts = materialise(may_hold(texts.select("h1", "h2", "at", "line"), "h1", members), "line-partners")
    members = materialise(members.join(texts.select("h1", "at"), "h1").select("h1", "at", "k", "kind"), "line-places")
    first = members.groupBy("k").agg(F.min(F.when(F.col("kind") != 2, F.col("at"))).alias("first_less"), F.min(F.when(F.col("kind") == 2, F.col("at"))).alias("first_full"))
    rival = F.when(F.col("kind") == 1, F.col("first_full")).otherwise(F.col("first_less"))
    pairs = members.join(first, "k").withColumn("rival", rival).where("rival < at").select("h1", F.col("rival.h1").alias("g1")).distinct()
    mine = texts.select("h1", "h2", F.split("line", " ").alias("a"))
    theirs = texts.select(F.col("h1").alias("g1"), F.split("line", " ").alias("b"))
    return pairs.join(mine, "h1").join(theirs, "g1").where(_same_but_one(F.col("a"), F.col("b"))).select("h1", "h2").distinct()


def line_decisions(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, text_hash, gone): for each distinct document (doc_id, text) that loses lines their numbers, in order.
    Lines are ordered by doc_id (null first), line number and hash of the line."""
    if near_words < 4:
        raise ValueError("lines under 4 words have no two ends to share")
    lines = materialise(_lines(docs.select("doc_id", "text")), "lines")
    place = F.struct("doc_id", "line_no")
    repeated = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    near = _near(lines, near_words).withColumn("near", F.lit(True))
    judged = materialise(repeated.join(near, ["h1", "h2"], "full").select("h1", "h2", "first", F.coalesce("c", F.lit(1)).alias("c"), F.col("near").isNotNull().alias("near")), "line-keys")
    common = judged.where(F.col("c") * HOT > lines.count()).select("h1", "h2", F.col("first").alias("hot_first"), F.col("near").alias("hot_near"))
    own = lines.select("doc_id", "text_hash", "line_no", "h1", "h2").join(F.broadcast(common), ["h1", "h2"], "left")
    hot = own.where(F.col("hot_near").isNotNull() & (F.col("hot_near") | ~place.eqNullSafe(F.col("hot_first"))))
    rest = may_hold(own.where(F.col("hot_near").isNull()), "h1", judged).join(judged, ["h1", "h2"]).where(F.col("near") | ~place.eqNullSafe(F.col("first")))
    gone = hot.select("doc_id", "text_hash", "line_no").unionByName(rest.select("doc_id", "text_hash", "line_no"))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))


def _with_gone(docs: DataFrame, id_col: str, text_col: str, near_words: int) -> DataFrame:
    """The documents with _gm_gone, the numbers of the lines that go (null for none)."""
    verdict = line_decisions(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), near_words)
    verdict = verdict.select(F.col("doc_id").alias("_gm_id"), F.col("text_hash").alias("_gm_hash"), F.col("gone").alias("_gm_gone"))
    own = docs.withColumn("_gm_own", F.xxhash64(text_col))
    return own.join(verdict, own[id_col].eqNullSafe(F.col("_gm_id")) & (F.col("_gm_own") == F.col("_gm_hash")), "left")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """The documents with duplicate lines left out of their text; a document that had words and keeps none goes.

    A null or empty text stays as it is, lines without a word stay. Of equal or near lines the earliest by doc_id (null
    first) and line number stays; lines under near_words words (4 at least) are only compared for equality. Rows that
    repeat id and text tie and are treated alike. All other columns stay, whatever their names; very long lines are
    compared as a whole. An empty table gives an empty result.
    """
    if not {id_col, text_col} <= set(docs.columns):
        raise ValueError(f"needs columns {id_col} and {text_col}")
    joined = _with_gone(docs, id_col, text_col, near_words)
    changed = F.col("_gm_gone").isNotNull()
    emptied = changed & (F.size("_gm_gone") == F.regexp_count(text_col, F.lit(_WORDED)))
    # a mark for each line up to the last that goes: the gaps between those as zeros
    gaps = F.zip_with("_gm_gone", F.concat(F.array(F.lit(-1)), F.slice("_gm_gone", 1, F.size("_gm_gone") - 1)), lambda at, last: F.concat(F.repeat(F.lit("0"), at - last - 1), F.lit("1")))
    zipped = F.arrays_zip(F.split(F.col(text_col), "\n", -1).alias("line"), F.split(F.array_join(gaps, ""), "").alias("mark"))
    kept = F.array_join(F.transform(F.filter(zipped, lambda x: F.coalesce(x["mark"], F.lit("0")) != "1"), lambda x: x["line"]), "\n")
    out = joined.where(~F.coalesce(emptied, F.lit(False))).withColumn(text_col, F.when(changed, kept).otherwise(F.col(text_col)))
    return out.select(*docs.columns)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """A row for each document: its lines with words, how many of them go, and which (line numbers from 0)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_lines = F.coalesce(F.regexp_count("text", F.lit(_WORDED)), F.lit(0)).cast("long")
    found = _with_gone(docs.withColumn("n_lines", n_lines), "doc_id", "text", NEAR_WORDS).select("doc_id", "n_lines", F.coalesce("_gm_gone", F.array().cast("array<int>")).alias("gone"))
    return found.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed_lines"))


OP4_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
d AS (SELECT w, len(w) AS n, min({'a': doc_id, 'b': line_no}) AS pos FROM w WHERE len(w) >= 1 GROUP BY w),
v AS (SELECT n, pos, w, unnest(range(1, n + 1)) AS j FROM d WHERE n >= 8),
x AS (SELECT n, pos, j, list_concat(w[1:j - 1], w[j + 1:n]) AS k FROM v),
m AS (SELECT n, j, k, min(pos) AS first FROM x GROUP BY n, j, k),
near AS (
  SELECT x.pos FROM x JOIN m ON x.n = m.n AND x.j = m.j AND x.k = m.k WHERE m.first < x.pos
  UNION SELECT greatest(x.pos, d.pos) FROM x JOIN d ON x.k = d.w AND d.n >= 8),
f AS (SELECT w.doc_id, w.line_no, len(w.w) > 0 AS worded,
    coalesce(d.pos IS NOT NULL AND (d.pos <> {'a': w.doc_id, 'b': w.line_no} OR d.pos IN (SELECT pos FROM near)), false) AS gone
  FROM w LEFT JOIN d ON w.w = d.w)
SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (gone), '') AS removed_lines
FROM f GROUP BY doc_id
"""
