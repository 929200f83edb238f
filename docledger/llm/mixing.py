"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, packed, stage, table, unpacked, word_count

#: Key ranges per source whose sizes are summed before any row is sorted.
BUCKETS = 4096


def source_targets(sizes: DataFrame, source_weights: Sequence[float], budget: float, most_epochs: float) -> DataFrame:
    """Word targets from (source, source_size): one row per source.

    Sources in code point order, null last, take source_weights in turn and share budget times
    all sizes by weight. A target above most_epochs times its source's size stops there and the
    excess is shared again by weight among the others until none is above. That fixed point is
    the water level at which, ordered by capacity per weight, the first source is not full.
    The table has one row per source, so ordering all of it is a sort of the dimension, not of
    documents.
    """
    turn = F.array(*[F.lit(float(w)) for w in source_weights])
    ranked = sizes.withColumn("weight", F.get(turn, (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(source_weights)))
    capped = ranked.withColumn("cap", most_epochs * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (budget * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = capped.withColumn("level", level).withColumn("at", F.row_number().over(order))
    is_open = F.col("level") * F.col("weight") <= F.col("cap")
    first = levels.withColumn("found", F.min(F.when(is_open, F.struct("at", "level"))).over(whole))
    return first.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("found.level")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, source_weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, most_epochs: float = 2.0, seed: str = "mix", buckets: int = BUCKETS) -> DataFrame:
    """Mix documents (doc_id, source, size, weight, tie, and more) to the targets of their sources.

    Each source first gives its complete epochs, target // source_size copies of every row. The
    rest of the target is filled by an Efraimidis-Spirakis sample without replacement: a row
    draws u from its doc_id and seed, its key is -ln(u) / weight, rows go in key order, and one
    is taken while the middle of its words lies inside the remaining budget. A source thus
    misses its target by half a document at most. Rows are whole or absent, never cut.

    No source is sorted whole. Keys fall into ranges, range sizes are summed with map-side
    combining, and only the one range in which a source's budget ends is sorted by row. That
    gives a last key per source, by which every row decides for itself: wide columns of
    docs are never shuffled.

    Null doc_id draws as the empty string; null weight counts as 1 and a weight of 0 or less as
    the smallest one; null source is a source of its own; size 0 takes nothing. Rows that repeat a
    doc_id share its key and are ordered by tie; those that share tie as well share a decision.
    An empty table gives an empty one.

    Returns the columns of docs and source_size, target, epochs, copies, taken.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long") + 1).cast("double") / float(2**48 + 1)
    key = -F.log(u) / F.greatest(F.coalesce(F.col("weight"), F.lit(1.0)), F.lit(1e-9))
    at = F.least(F.floor((1 - F.exp(-F.col("es_key"))) * buckets), F.lit(buckets - 1)).cast("int")
    skey = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    keyed = docs.withColumn("es_key", key).withColumn("es_bucket", at).withColumn("skey", skey)
    rows = stage(keyed.select("skey", "source", "es_key", "es_bucket", "doc_id", "tie", "size"), "mix-rows")
    sums = stage(rows.groupBy("skey", "es_bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size")), "mix-sums")
    sizes = sums.groupBy("skey").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), source_weights, budget, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("skey", skey).withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    run = Window.partitionBy("skey").orderBy("es_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.select("skey", "es_bucket", "bucket_size", F.sum("bucket_size").over(run).alias("upto"))
    ends = ends.join(targets.select("skey", "rest"), "skey").where(F.col("upto") >= F.col("rest")).groupBy("skey").agg(F.min(F.struct("es_bucket", (F.col("upto") - F.col("bucket_size")).alias("base"))).alias("end"))
    plan = targets.join(ends, "skey", "left").select("skey", "source_size", "target", "epochs", "rest", F.coalesce("end.es_bucket", F.lit(buckets)).alias("end_bucket"), F.coalesce("end.base", F.lit(0)).alias("base"))
    plan = stage(plan, "mix-plan")
    edge = join_small(rows, plan.select("skey", "rest", "base", F.col("end_bucket").alias("es_bucket")), ["skey", "es_bucket"])
    place = ("es_key", "doc_id", "tie")
    upto = F.col("base") + F.sum("size").over(Window.partitionBy("skey").orderBy(*place))
    middle = upto - F.sum("size").over(Window.partitionBy("skey", *place)) / 2
    last = edge.withColumn("middle", middle).where(F.col("middle") < F.col("rest")).groupBy("skey").agg(F.max(F.struct(*place)).alias("last"))
    plan = stage(plan.join(last, "skey", "left").drop("rest", "base"), "mix-last")
    part = (F.col("es_bucket") < F.col("end_bucket")) | ((F.col("es_bucket") == F.col("end_bucket")) & F.coalesce(F.struct(*place) <= F.col("last"), F.lit(False)))
    out = join_small(keyed, plan, ["skey"]).withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + part.cast("int")).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*docs.columns, "source_size", "target", "epochs", "copies", "taken")


def weighted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with size, weight and tie: labelled quality 1 weighs 2, quality 0 weighs 0.5, unlabelled 1."""
    quality = labels.select("doc_id", "quality").groupBy("doc_id").agg(F.avg("quality").alias("mean_quality"))
    sized = docs.withColumn("size", word_count(F.col("text"))).withColumn("tie", F.xxhash64("text"))
    weighed = join_small(sized, quality, ["doc_id"], "left")
    return weighed.withColumn("weight", F.coalesce(0.5 + 1.5 * F.col("mean_quality"), F.lit(1.0))).drop("mean_quality")


def mixed_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mix itself: every document as many times as it is taken, in the columns of docs."""
    taken = mix(weighted_documents(packed(docs, "doc_id", "source", "text"), labels))
    return unpacked(taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    narrow = weighted_documents(docs, table(spark, sf_dir, "labels")).drop("text")
    return mix(narrow).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP1_SQL = r"""
WITH q AS (SELECT doc_id, avg(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  -ln((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710657.0)
    / coalesce(0.5::DOUBLE + 1.5::DOUBLE * q.quality, 1.0::DOUBLE) AS k
  FROM documents d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS ord,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)),
t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, ord) FROM l WHERE level * weight <= cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2 AS middle
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies
FROM (SELECT *, CASE WHEN size > 0 THEN epochs + (middle < rest)::BIGINT ELSE 0 END AS copies FROM r)
"""

QUERIES = {"op1_mixing": op1_mixing}
ORACLE = {"op1_mixing": OP1_SQL}
