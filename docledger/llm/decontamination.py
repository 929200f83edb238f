"""Benchmark decontamination by spaced-seed hashing. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, packed, stage, table, unpacked, words

#: Words of a window that is compared, and how many of them must agree (0.8 of it, rounded up).
WINDOW, AGREE = 13, 11
#: Seeds by the least number of an item's words. 1 compares a word, 0 ignores it. The first finds every
#: window of 13 words with 2 substitutions, the second every item of 5 to 12 words with one in five substituted
#: (a test tries all placements). Shorter items must stand there word by word.
MASKS = {13: ("11001011",), 5: ("1101", "1011"), 4: ("1111",), 3: ("111",), 2: ("11",), 1: ("1",)}
#: Most seeds that are broadcast, of 20 bytes each.
BROADCAST_SEEDS = 1_000_000


def _hashes(text: Column) -> Column:
    return F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w))


def _seeds(mask: str, k: int, hashes: str) -> Column:
    """(k, pos, seed) of every place where the mask fits; k tells masks apart."""
    care = [i for i, c in enumerate(mask) if c == "1"]
    n = F.size(hashes) - len(mask)
    at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda p: F.struct(p.alias("pos"), F.xxhash64(F.lit(k), *[F.get(hashes, p + i) for i in care]).alias("seed")))


def _best_window(agree: Column, n: Column) -> Column:
    """Most agreements in any window of WINDOW words of an array of 0 and 1; of the whole if it is shorter."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    starts = F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1)))
    return F.array_max(F.transform(starts, lambda i: total(F.slice(agree, i, WINDOW))))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Substitution-tolerant overlaps of documents (doc_id, text) with benchmark items (item_id, text).

    Words are compared with A-Z lower-cased. An item of 13 words or more overlaps a document
    where, at some alignment, 11 of 13 consecutive words agree; one of 5 to 12 words where 0.8 of
    its words do, so all words of a shorter one; items without words and null texts are left out. Every seed position of every
    document is looked up among the items' seeds, so no overlap of that kind is missed, and each
    hit's alignment is verified over the whole item.

    Items' seeds are broadcast if they are BROADCAST_SEEDS at most. Else positions and seeds are
    joined by shuffle, where a frequent seed's partition can be split, and hits come back to
    their documents by key.

    Null and empty texts overlap nothing. A very long text is searched as a whole, in one row. Rows that repeat a doc_id are searched each for itself;
    doc_key identifies row contents, and doc_id may be null. Empty tables give an empty result.
    Returns doc_key, doc_id, item_id, doc_start (of the item's first word, negative if cut off),
    n_words (of the item), n_agree (in the best window), window (its words), one row per alignment.
    """
    items = benchmark.where("text is not null").select("item_id", _hashes(F.col("text")).alias("item")).withColumn("n", F.size("item")).where(F.col("n") >= min(MASKS)).distinct()
    items = stage(items, "bench-items")
    longest = items.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    masks, low = [], None
    for least in sorted(MASKS, reverse=True):
        if longest["most"] is not None and longest["most"] >= least and (low is None or longest["least"] < low):
            masks += [(len(masks) + i, m, least, low) for i, m in enumerate(MASKS[least])]
        low = least
    per_item = [F.when((F.col("n") >= least) & (F.col("n") < (high or 2**31 - 1)), _seeds(m, k, "item")).otherwise(F.array().cast("array<struct<pos:int,seed:bigint>>")) for k, m, least, high in masks]
    if not per_item:
        return docs.select(F.xxhash64("doc_id", "text").alias("doc_key"), "doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("doc_start", "int"), ("n_words", "int"), ("n_agree", "int"), ("window", "int"))]).where("false")
    seeds = items.select("item_id", F.explode(F.concat(*per_item)).alias("x")).select(F.col("x.seed").alias("seed"), "item_id", F.col("x.pos").alias("item_pos"))
    seeds = stage(seeds, "bench-seeds")
    rows = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("doc_key"), "doc_id", _hashes(F.col("text")).alias("words"))
    found = F.explode(F.concat(*[_seeds(m, k, "words") for k, m, _, _ in masks])).alias("x")
    start = (F.col("pos") - F.col("item_pos")).alias("doc_start")
    if seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        hits = rows.select("doc_key", "doc_id", "words", found).select("doc_key", "doc_id", "words", "x.pos", "x.seed").join(F.broadcast(seeds), "seed")
        hits = hits.select("doc_key", "doc_id", "words", "item_id", start).join(F.broadcast(items), "item_id")
    else:
        hits = rows.select("doc_key", "doc_id", found).select("doc_key", "doc_id", "x.pos", "x.seed").join(seeds, "seed")
        hits = hits.select("doc_key", "item_id", start).distinct().join(rows.dropDuplicates(["doc_key"]), "doc_key").join(items, "item_id")
    agree = F.transform("item", lambda x, i: F.coalesce(F.get("words", F.col("doc_start") + i) == x, F.lit(False)).cast("int"))
    hits = hits.select("doc_key", "doc_id", "item_id", "doc_start", F.col("n").alias("n_words"), agree.alias("agree")).distinct()
    hits = hits.select("doc_key", "doc_id", "item_id", "doc_start", "n_words", _best_window(F.col("agree"), F.col("n_words")).alias("n_agree"), F.least("n_words", F.lit(WINDOW)).alias("window"))
    return hits.where(F.when(F.col("n_words") >= WINDOW, F.col("n_agree") >= AGREE).otherwise(F.col("n_agree") * 5 >= F.col("n_words") * 4))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text and more) without the rows that overlap a benchmark item.

    The keys of contaminated rows are few beside the corpus but grow with it: an ordinary join
    lets the optimizer choose.
    """
    bad = stage(overlaps(docs.select("doc_id", "text"), benchmark).select("doc_key").distinct(), "contaminated")
    return unpacked(packed(docs, F.xxhash64("doc_id", "text").alias("doc_key")).join(bad, "doc_key", "left_anti"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the items they hold: the best agreement of each pair."""
    found = overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    best = F.max(F.struct("n_agree", -F.col("doc_start"), "doc_start")).alias("b")
    return found.groupBy("doc_id", "item_id", "n_words", "window").agg(best).select("doc_id", "item_id", "n_words", "window", "b.n_agree", "b.doc_start")


OP10_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item_id, len(w)::INT AS n, unnest(w) AS word, unnest(range(len(w))) AS ip FROM b WHERE len(w) >= 1),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS dp FROM d),
m AS (SELECT DISTINCT doc_id, item_id, n, dp - ip AS doc_start, ip FROM dw JOIN bw USING (word)),
k AS (SELECT doc_id, item_id, n, doc_start FROM m GROUP BY ALL HAVING count(*) * 5 >= least(n, 13) * 4),
c AS (SELECT doc_id, item_id, n, doc_start, count(*) OVER (PARTITION BY doc_id, item_id, doc_start ORDER BY ip RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS a FROM m SEMI JOIN k USING (doc_id, item_id, doc_start)),
v AS (SELECT doc_id, item_id, n, doc_start, max(a)::INT AS n_agree FROM c GROUP BY ALL)
SELECT doc_id, item_id, n AS n_words, least(n, 13) AS "window", max(n_agree) AS n_agree, arg_max(doc_start, n_agree::BIGINT * 1000000000 - doc_start)::INT AS doc_start
FROM v WHERE CASE WHEN n >= 13 THEN n_agree >= 11 ELSE n_agree * 5 >= n * 4 END GROUP BY doc_id, item_id, n
"""

QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE = {"op10_decontamination": OP10_SQL}
