"""Line dedup by content-defined chunks of lines, with DataFrame operations only.

A rolling hash over the hashes of three lines decides whether a chunk begins, so equal passages are cut alike wherever
they stand; a line that equals the one before it never begins one. A chunk of several lines that stands again anywhere is
kept where it stands first and removed elsewhere. Chunks miss passages in which no chunk lies whole, so the same holds
for every run of whole lines of over LONG_WORDS words; only lines that stand twice can be in one.

Hashes only nominate. They move, texts do not: one scan leaves the hashes of each text's lines, repeated hashes come
back as a map of bounded size, and only texts with nominated places are fetched, for a comparison of the bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.llm.common import MADE, forget, split_by, written

#: Mean lines per chunk; words above which a run of lines is a passage; words that a chunk must have (counted as blanks and line ends).
MEAN_LINES, LONG_WORDS, LEAST_WORDS = 4, 50, 0
#: The rolling hash: ((x * BASE + y) * BASE + z) modulo PRIME of three line hashes.
PRIME, BASE = 2**31 - 1, 1_000_003
SOLID = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.transform(F.array(value), body)[0]


def split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def starts(lines: Column, hashes: Column) -> Column:
    """Numbers of the lines (from 0) at which the chunks of a text begin; hashes tell equal lines."""
    short = F.transform(lines, lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long") % PRIME)
    at = lambda xs, i: F.coalesce(F.get(xs, i), F.lit(0))
    rolled = lambda xs, i: (at(xs, i - 2) * (BASE * BASE % PRIME) % PRIME + at(xs, i - 1) * BASE % PRIME + F.get(xs, i)) % PRIME
    begins = lambda xs: lambda i: (i == 0) | ((rolled(xs, i) % MEAN_LINES == 0) & (F.get(hashes, i) != F.get(hashes, i - 1)))
    return let(short, lambda xs: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), begins(xs)))


def outlines(docs: DataFrame) -> DataFrame:
    """(id, mark, hs, ws, begin): line hashes, words per line and chunk starts of each distinct (id, mark, text)."""
    words = lambda line: (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("int")
    parts = lambda ls: F.struct(F.transform(ls, lambda x: F.xxhash64(x)).alias("hs"), F.transform(ls, words).alias("ws"), ls.alias("ls"))
    cut = lambda x: F.struct(x["hs"].alias("hs"), x["ws"].alias("ws"), starts(x["ls"], x["hs"]).alias("begin"))
    found = let(split(F.col("text")), lambda ls: let(parts(ls), cut))
    return docs.filter(F.col("text").isNotNull()).select("id", "mark", found.alias("x")).select("id", "mark", "x.*").dropDuplicates(["id", "mark"])


def again(places: DataFrame) -> DataFrame:
    """Rows of places whose `hash` stands at least twice (and a few others), without moving them."""
    repeated = places.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    return split_by(places, F.col("hash"), repeated)[0]


def chunks(found: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, mark, start, size, hash) of the chunks of several lines in outlines."""
    ends = F.concat(F.slice("begin", F.lit(2), F.size("begin")), F.array(F.size("hs")))
    each = found.select("id", "mark", "hs", "ws", F.explode(F.arrays_zip(F.col("begin").alias("a"), ends.alias("b"))).alias("x"))
    size = F.col("x.b") - F.col("x.a")
    part = lambda xs: F.slice(xs, F.col("x.a") + 1, size)
    words = F.aggregate(part("ws"), F.lit(0), lambda a, b: a + b)
    long = each.filter((size > 1) & (words >= least_words)) if least_words else each.filter(size > 1)
    return long.select("id", "mark", F.col("x.a").alias("start"), size.alias("size"), F.xxhash64(part("hs")).alias("hash"))


def passages(found: DataFrame) -> DataFrame:
    """(id, mark, start, size, hash): the least runs of repeated lines of over LONG_WORDS words, from each line and up to each line.

    Every line of a longer run that stands elsewhere too lies in such a run that stands there too.
    """
    each = found.select("id", "mark", F.posexplode(F.arrays_zip("hs", "ws")).alias("i", "x")).select("id", "mark", "i", F.col("x.hs").alias("hash"), F.col("x.ws").cast("long").alias("w"))
    row = Window.partitionBy("id", "mark")
    linked = again(each).withColumn("run", F.col("i") - F.row_number().over(row.orderBy("i")))
    run = Window.partitionBy("id", "mark", "run")
    ends = linked.withColumn("all", F.sum("w").over(run)).filter(F.col("all") > LONG_WORDS)
    ends = ends.withColumn("end", F.sum("w").over(run.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("w"))
    ahead, behind = run.orderBy("begin").rangeBetween(0, LONG_WORDS), run.orderBy("end").rangeBetween(-LONG_WORDS, 0)
    over = ends.select("id", "mark", "i", "w", *[f(c).over(w).alias(n + k) for k, w in (("ahead", ahead), ("behind", behind)) for f, c, n in ((F.collect_list, "hash", "hs_"), (F.sum, "w", "words_"))])
    forward = F.when(F.col("words_ahead") > LONG_WORDS, F.struct(F.col("i").alias("start"), F.size("hs_ahead").alias("size"), F.xxhash64("hs_ahead").alias("hash")))
    # one whose last line is needed is also the least from its first line
    last = (F.col("words_behind") > LONG_WORDS) & (F.col("words_behind") - F.col("w") > LONG_WORDS)
    back = F.when(last, F.struct((F.col("i") - F.size("hs_behind") + 1).alias("start"), F.size("hs_behind").alias("size"), F.xxhash64("hs_behind").alias("hash")))
    return over.select("id", "mark", F.explode(F.array_compact(F.array(forward, back))).alias("x")).select("id", "mark", "x.*")


def same(a: DataFrame, b: DataFrame) -> Column:
    """Rows of a (id, mark) and b (own_id, own_mark) of the same document."""
    return a["id"].eqNullSafe(b["own_id"]) & (a["mark"] == b["own_mark"])


def owned(places: DataFrame, what: Column) -> DataFrame:
    return places.groupBy(F.col("id").alias("own_id"), F.col("mark").alias("own_mark")).agg(what)


def removals(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(own_id, own_mark, lost): the numbers of the lines to remove from rows (id, text)."""
    mark = F.xxhash64("text").alias("mark")
    found = written(outlines(docs.select("id", mark, "text")), "outlines")
    runs = written(passages(found), "passages")
    kinds = [again(x).select("id", "mark", F.struct("start", "size", F.lit(kind).alias("kind")).alias("x")) for kind, x in ((0, chunks(found, least_words)), (1, runs))]
    asked = written(owned(kinds[0].unionByName(kinds[1]), F.collect_set("x").alias("asked")), "asked")
    texts = split_by(docs, F.xxhash64("id"), asked.select(F.xxhash64("own_id")))[0].select("id", mark, "text")
    body = lambda ls, x: F.array_join(F.slice(ls, x["start"] + 1, x["size"]), "\n")
    told = lambda x, text: F.struct(x["start"].alias("start"), x["size"].alias("size"), x["kind"].alias("kind"), F.when(text.rlike(SOLID), F.sha2(text, 256)).alias("digest"))
    digests = lambda ls: F.transform("asked", lambda x: let(body(ls, x), lambda text: told(x, text)))
    joined = texts.join(asked, same(texts, asked))
    places = written(joined.select("id", "mark", F.explode(let(split(F.col("text")), digests)).alias("x")).select("id", "mark", "x.*").filter("digest IS NOT NULL").distinct(), "places")
    first = places.groupBy("kind", "digest").agg(F.min(F.struct("id", "mark", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    both = places.join(written(first, "first"), ["kind", "digest"])
    elsewhere = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")))
    later = both.filter(elsewhere | (F.col("first.start") + F.col("size") <= F.col("start")))
    return owned(later, F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("size") - 1))))).alias("lost"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "lines_removed", length_col: str | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with repeated chunks and passages cut from text_col, and removed_col: the number of lines cut.

    The first place of a chunk or passage is the one of the smallest (id, hash of text, line number), null ids first; a
    passage that overlaps its own first place stays. Rows with equal id and text are one document: what they share only
    with each other stays in all of them. A text all of whose lines stand elsewhere becomes empty; null stays null, with 0
    lines cut; blank lines alone are no chunk. length_col, if given, gets the new length. A column named removed_col is
    replaced; others are kept. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c != removed_col]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = list(MADE)
    cut = written(removals(rows.select("id", "text"), least_words), "lost")
    forget(docs.sparkSession, made, MADE[-1])
    some, rest = split_by(rows, F.xxhash64("id"), cut.select(F.xxhash64("own_id")))
    some = some.withColumn("mark", F.xxhash64("text"))
    stay = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "lost"), lambda i: F.get(ls, i))
    new = F.when(F.col("lost").isNotNull(), F.array_join(let(split(F.col("text")), stay), "\n")).otherwise(F.col("text"))
    changed = some.join(cut, same(some, cut), "left").select("row", new.alias("text"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("lost"))
    both = changed.unionByName(rest.select("row", "text", F.lit(0).cast("long").alias("lost")))
    fields = [F.col("text").alias(c) if c == text_col else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col("row")[c].alias(c) for c in kept]
    return both.select(*fields, F.col("lost").alias(removed_col))


#: The same in DuckDB SQL, for tables whose ids do not repeat.
SQL = r"""
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM x),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) % 2147483647 AS h, length(line) - length(replace(line, ' ', '')) + 1 AS w FROM l),
o AS (SELECT *, lag(line) OVER d AS before, coalesce(lag(h, 2) OVER d, 0) AS h2, coalesce(lag(h, 1) OVER d, 0) AS h1, sum(w) OVER d AS e
      FROM h WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, e - w AS s, i = 0 OR (line <> before AND (h2 * 1426104154 % 2147483647 + h1 * 1000003 % 2147483647 + h) % 2147483647 % 4 = 0) AS begins FROM o),
n AS (SELECT *, count(*) FILTER (WHERE begins) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM b),
c AS (SELECT doc_id, 0 AS kind, min(i) AS start, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS body FROM n GROUP BY doc_id, part HAVING count(*) > 1),
f AS (SELECT doc_id, 1 AS kind, i AS start, count(*) OVER a AS size, string_agg(line, chr(10)) OVER a AS body, sum(w) OVER a AS words
      FROM b WINDOW a AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 50 FOLLOWING)),
g AS (SELECT doc_id, 1 AS kind, i - count(*) OVER a + 1 AS start, count(*) OVER a AS size, string_agg(line, chr(10)) OVER a AS body, sum(w) OVER a AS words
      FROM b WINDOW a AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 50 PRECEDING AND CURRENT ROW)),
p AS (SELECT * FROM c UNION SELECT * EXCLUDE (words) FROM f WHERE words > 50 UNION SELECT * EXCLUDE (words) FROM g WHERE words > 50),
q AS (SELECT * FROM p WHERE regexp_matches(body, '[^\x20\x09-\x0D]')),
r AS (SELECT *, min((doc_id, start)) OVER (PARTITION BY kind, body) AS first FROM q),
u AS (SELECT DISTINCT doc_id, unnest(range(start, start + size)) AS i FROM r WHERE doc_id <> first[1] OR first[2] + size <= start),
t AS (SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE u.i IS NULL), '') AS text, count(u.i) AS lines_removed
      FROM l LEFT JOIN u ON l.doc_id = u.doc_id AND l.i = u.i GROUP BY l.doc_id)
SELECT o.doc_id, t.text, CAST(coalesce(t.lines_removed, 0) AS BIGINT) AS lines_removed FROM documents o LEFT JOIN t USING (doc_id)
"""
