"""Line dedup by a deletion-neighbourhood join over words. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, join_small, stage, table

#: Fewest words of a line of which an edit of one word leaves 0.8 alike; shorter ones must be equal.
LEAST_WORDS = 5
#: Most lines with a likely partner that are broadcast, of about 60 bytes each.
BROADCAST_LINES = 500_000


def _word_hashes(line: Column) -> Column:
    return F.transform(F.filter(F.split(line, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def _half_keys(h: str) -> Column:
    """Four hashes, of which lines within one word edit share at least one.

    If the shorter of two such lines has m words, their first m div 2 words are the same or
    their last m - m div 2 are. A line is the shorter one or has one word more.
    """
    n = F.size(h)

    def key(m: Column, tag: int) -> Column:
        p = F.floor(m / 2).cast("int")
        part = F.slice(h, F.lit(1), p) if tag == 0 else F.slice(h, n - (m - p) + 1, m - p)
        return F.xxhash64(F.lit(tag), m, part)

    return F.array(*[key(n - d, tag) for tag in (0, 1) for d in (0, 1)])


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, line_no, line, line_hash) of lines that hold a word."""
    lines = docs.where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(WORD)).withColumn("line_hash", F.xxhash64("line"))


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Lines of documents (doc_id, text) that repeat an earlier one, equal or with one word inserted, deleted or replaced.

    Lines are compared as words between ASCII white space, and go in the order of doc_id (null
    first), a hash of doc_id and text, and line number. A line repeats if any earlier one is within
    the bound, whether that one repeats itself or not. Lines of fewer than least_words words must be equal.

    Equal lines are one. Hashes of halves (see _half_keys) find the lines that may have a partner
    within an edit; those alone emit their deletion variants, on the side of the edit. Two
    lines are a replacement apart if they share a variant with the same place deleted, and a
    deletion apart if a variant of one is the other. So the earliest line per key suffices, and a
    frequent key makes no pairs. The word edit distance to that line is verified on the words.

    Null texts and lines without words are left out. Rows that repeat doc_id and text are compared
    line by line as any others. A very long text is split into lines; the variants of one line
    with a likely partner take the square of its words. An empty table gives an empty result.
    Returns doc_id, doc_key, line_no, n_words, distance (0 or 1), first_doc_id, first_line_no.
    """
    lines = _lines(docs)
    hashed = lines.withColumn("h", _word_hashes(F.col("line")))
    keyed = hashed.withColumn("n_words", F.size("h")).select("doc_id", "doc_key", "line_no", "line_hash", "n_words", F.xxhash64("n_words", "h").alias("full"), F.when(F.size("h") >= least_words, _half_keys("h")).alias("keys"))
    keyed = stage(keyed, "lines")
    at = F.struct("doc_id", "doc_key", "line_no")
    distinct = stage(keyed.groupBy("full").agg(F.min(at).alias("at"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys"), F.min_by("line_hash", at).alias("line_hash"), F.count("*").alias("times")), "distinct-lines")
    halves = distinct.where("keys is not null").select("full", F.posexplode("keys").alias("i", "key"))
    shared = halves.groupBy("key").agg(F.min("full").alias("a"), F.max("full").alias("b")).where("a <> b").select("key")
    # keys 0 and 1 are first halves: the edit lies behind; keys 2 and 3 are last halves: it lies before
    sides = halves.join(shared, "key", "left_semi").groupBy("full").agg(F.bool_or(F.col("i") < 2).alias("behind"), F.bool_or(F.col("i") >= 2).alias("before"))
    near = stage(distinct.join(sides, "full").select("full", "at", "n_words", "line_hash", "behind", "before"), "near-lines")
    wanted = near.select("line_hash", "full", "at", "behind", "before")
    texts = lines.select("doc_id", "doc_key", "line_no", "line_hash", "line")
    small = wanted.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    texts = texts.join(F.broadcast(wanted) if small else wanted, "line_hash").where((F.col("line_no") == F.col("at.line_no")) & (F.col("doc_key") == F.col("at.doc_key"))).dropDuplicates(["full"])
    texts = stage(texts.select("full", "at", "behind", "before", _word_hashes(F.col("line")).alias("h")), "near-words")
    n, mid = F.size("h"), F.floor((F.size("h") - 1) / 2).cast("int") + 1
    low, high = F.when(F.col("before"), F.lit(1)).otherwise(mid), F.when(F.col("behind"), n).otherwise(mid)
    without = lambda i: F.concat(F.slice("h", F.lit(1), i - 1), F.slice("h", i + 1, F.greatest(n - i, F.lit(0))))
    variants = F.transform(F.sequence(low, high), lambda i: F.struct(i.alias("i"), F.xxhash64(n - 1, without(i)).alias("v")))
    dels = stage(texts.select("full", "at", F.explode(variants).alias("x")).select("full", "at", "x.i", "x.v"), "deletion-variants")
    first = F.min(F.struct("at", "full"))
    replaced = dels.groupBy("v", "i").agg(first.alias("e"), F.count("*").alias("c")).where("c > 1").select("v", "i", "e")
    by_replacement = dels.join(replaced, ["v", "i"]).where("e.at < at").select("full", "at", "e")
    known = texts.select(F.col("full").alias("v"), F.struct("at", "full").alias("y"))
    pairs = dels.select("v", F.struct("at", "full").alias("x")).join(known, "v").groupBy("x", "y").count()
    by_deletion = pairs.select(F.greatest("x", "y").alias("late"), F.least("x", "y").alias("e")).select("late.full", "late.at", "e")
    earliest = by_replacement.union(by_deletion).groupBy("full", "at").agg(F.min("e").alias("e"))
    words = texts.select("full", "h")
    checked = earliest.join(words, "full").join(words.select(F.col("full").alias("other"), F.col("h").alias("g")), F.col("e.full") == F.col("other"))
    checked = checked.where(_within_one("h", "g")).select("full", F.col("e.at").alias("near_at"))
    # what stands once and has no partner is not joined again
    firsts = distinct.select("full", "at", "times").join(checked, "full", "left").where("times > 1 or near_at is not null")
    firsts = stage(firsts.select("full", "at", F.least("at", "near_at").alias("to")), "first-lines")
    out = join_small(keyed.drop("keys", "line_hash"), firsts, ["full"]).where(F.struct("doc_id", "doc_key", "line_no") > F.col("to"))
    return out.select("doc_id", "doc_key", "line_no", "n_words", (F.col("to") < F.col("at")).cast("int").alias("distance"), F.col("to.doc_id").alias("first_doc_id"), F.col("to.line_no").alias("first_line_no"))


def _within_one(a: str, b: str) -> Column:
    """Whether arrays are one insertion, deletion or replacement of an element apart, or equal."""
    na, nb = F.size(a), F.size(b)
    longest, shortest = F.greatest(na, nb), F.least(na, nb)
    run = lambda x, y: F.coalesce(F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(shortest, F.lit(1))), lambda i: F.get(x, i - 1).eqNullSafe(F.get(y, i - 1))), F.lit(False)), F.lit(0))
    prefix = F.when(run(F.col(a), F.col(b)) == 0, shortest).otherwise(run(F.col(a), F.col(b)) - 1)
    ra, rb = F.reverse(a), F.reverse(b)
    suffix = F.when(run(ra, rb) == 0, shortest).otherwise(run(ra, rb) - 1)
    return (longest - shortest <= 1) & (prefix + suffix >= longest - 1)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("doc_key")


OP7_SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l)))::INT AS line_no FROM s),
w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
k AS (SELECT doc_id, line_no, len(w)::INT AS n, array_to_string(w, ' ') AS k, w FROM w),
d AS (SELECT k, any_value(w) AS w, any_value(n) AS n, min({'d': doc_id, 'l': line_no}) AS fst FROM k GROUP BY k),
v AS (SELECT k, fst, unnest(range(1, n + 1)) AS i, w, n FROM d WHERE n >= 5),
u AS (SELECT k, fst, i, array_to_string(list_concat(w[1:i-1], w[i+1:n]), ' ') AS v, n FROM v),
r AS (SELECT v, i, min(fst) AS e FROM u GROUP BY v, i HAVING count(*) > 1),
near AS (SELECT u.k, r.e FROM u JOIN r USING (v, i) WHERE r.e < u.fst
  UNION ALL SELECT CASE WHEN u.fst > d.fst THEN u.k ELSE d.k END, least(u.fst, d.fst) FROM u JOIN d ON d.k = u.v AND d.n = u.n - 1 WHERE d.n >= 5),
e AS (SELECT k, min(e) AS e FROM near GROUP BY k)
SELECT k.doc_id, k.line_no, k.n AS n_words, (coalesce(e.e, d.fst) < d.fst)::INT AS distance,
  least(d.fst, coalesce(e.e, d.fst)).d AS first_doc_id, least(d.fst, coalesce(e.e, d.fst)).l AS first_line_no
FROM k JOIN d USING (k) LEFT JOIN e USING (k) WHERE {'d': k.doc_id, 'l': k.line_no} > least(d.fst, coalesce(e.e, d.fst))
"""

QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE = {"op7_line_dedup": OP7_SQL}
