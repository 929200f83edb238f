"""Ownership, staleness and the worklist of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.operators.graph import cut

DEFAULT_SLA = 90


def age_days(now: Column, reviewed: Column) -> Column:
    """Whole elapsed days (24 hours, not midnights), 0 at least."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(reviewed.cast("timestamp"))
    return F.when(micros.isNotNull(), F.greatest(F.lit(0), F.floor(micros / 86_400_000_000))).cast("int")


def staleness(docs: DataFrame, now: str, include_fresh: bool = False) -> DataFrame:
    """Documents (doc_id, reviewed, sla_days) that are stale (older than their SLA) or never reviewed."""
    age = age_days(F.lit(now), F.col("reviewed"))
    status = F.when(F.col("reviewed").isNull(), "never_reviewed").when(age > F.col("sla_days"), "stale").otherwise("fresh")
    out = docs.withColumn("age_days", age).withColumn("status", status)
    return out if include_fresh else out.where("status <> 'fresh'")


def filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def effective_owners(docs: DataFrame) -> DataFrame:
    """accountable: dri, owner, team, inherited; durable: team, owner, inherited. Empty strings fall through."""
    inherited = filled("inherited")
    return docs.withColumn("accountable", F.coalesce(filled("dri"), filled("owner"), filled("team"), inherited)).withColumn("durable", F.coalesce(filled("team"), filled("owner"), inherited))


def ownership(owners: DataFrame, roster: DataFrame, include_ok: bool = False) -> DataFrame:
    """Documents whose accountable identity is missing, departed or unknown.

    A name counts by its first row in the roster. The roster is an ordinary join side: it is as
    large as the organisation, and the optimizer decides by its size.
    """
    names = roster.groupBy("name").agg(F.min_by("active", "ord").alias("active"))
    a = names.select(F.col("name").alias("accountable"), F.col("active").alias("accountable_active"))
    d = names.select(F.col("name").alias("durable"), F.col("active").alias("durable_active"))
    out = owners.join(a, "accountable", "left").join(d, "durable", "left")
    soft = F.col("durable").isNotNull() & (F.col("durable") != F.col("accountable")) & F.coalesce("durable_active", F.lit(False))
    status = F.when(F.col("accountable").isNull(), "unowned").when(F.coalesce("accountable_active", F.lit(False)), "ok").when(soft, "orphan_dri_vacant").otherwise("orphan_owner_departed")
    out = out.withColumn("status", status).drop("accountable_active", "durable_active")
    return out if include_ok else out.where("status <> 'ok'")


#: Severity by status (fixed values); other statuses are medium.
SEVERITY = {
    "orphan_owner_departed": "high", "orphan_dri_vacant": "medium", "unowned": "medium",
    "never_reviewed": "high", "stale": "medium",
    "suspect": "high", "missing_upstream": "high", "unstamped": "low", "suspect_transitive": "low",
}
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}
REASON_RANK = {"orphan": 0, "stale": 1, "suspect": 2}


def _lookup(c: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def worklist_items(owners: DataFrame, orphans: DataFrame, stale: DataFrame, suspects: DataFrame | None = None, owner: str | None = None) -> DataFrame:
    """One row per reason that a document needs attention, with its live assignee.

    Work goes to the accountable identity. All work of an orphan goes to its durable owner if
    only the responsible person left, to nobody if no active owner remains: a null that overrides.
    """
    row = lambda df, reason, upstream: df.select("doc_id", F.lit(reason).alias("reason"), "status", upstream.cast("long").alias("upstream_id"))
    items = row(orphans, "orphan", F.lit(None)).unionByName(row(stale, "stale", F.lit(None)))
    if suspects is not None:
        items = items.unionByName(row(suspects, "suspect", F.col("upstream_id")))
    moved = orphans.where("status in ('orphan_dri_vacant', 'orphan_owner_departed')").select("doc_id", F.lit(True).alias("moved"), F.when(F.col("status") == "orphan_dri_vacant", F.col("durable")).alias("to"))
    items = items.join(owners.select("doc_id", "accountable"), "doc_id", "left").join(moved, "doc_id", "left")
    items = items.withColumn("assignee", F.when(F.coalesce("moved", F.lit(False)), F.col("to")).otherwise(F.col("accountable")))
    if owner is not None:
        items = items.where(F.col("assignee") == owner)
    return items.select("assignee", "doc_id", "reason", "status", _lookup(F.col("status"), SEVERITY, "medium").alias("severity"), "upstream_id")


def ranked(items: DataFrame) -> DataFrame:
    """worklist_items with the rank of each in its assignee's queue: by severity, reason, document and upstream.

    One queue, such as the unowned one, may hold most rows. So rows are dealt by ranges of doc_id,
    each range numbers its own rows of a queue, severity and reason, and starts where those
    before it end. The ranges are checkpointed, since both passes must see the same.
    """
    rows = cut(items.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()))
    slice_ = ["assignee", "severity", "reason", "range"]
    run = Window.partitionBy("assignee").orderBy(_lookup(F.col("severity"), SEVERITY_RANK, 1), _lookup(F.col("reason"), REASON_RANK, 9), "range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*slice_).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(run), F.lit(0)))
    starts = starts.select(F.struct(*slice_).alias("slice"), "start")
    own = F.struct(*slice_)
    order = Window.partitionBy(own).orderBy("doc_id", F.col("upstream_id").asc_nulls_first())
    placed = rows.withColumn("slice", own).withColumn("place", F.row_number().over(order))
    return placed.join(starts, "slice").select("assignee", (F.col("start") + F.col("place")).alias("rank"), "doc_id", "reason", "status", "severity", "upstream_id")


def worklist_queues(items: DataFrame) -> DataFrame:
    """Items and distinct documents of each assignee; null is the unowned queue."""
    by_doc = items.groupBy("assignee", "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "high").alias("high"))
    return by_doc.groupBy("assignee").agg(F.sum("n").alias("item_count"), F.count("*").alias("doc_count"), F.sum("high").alias("high_count"))


def repo_worklist(owners: DataFrame, reviewed: DataFrame, now: str, roster: DataFrame | None = None, suspects: DataFrame | None = None) -> DataFrame:
    """Worklist items of a repository: without a roster nobody has left, so there are no orphans; a hub has no suspect links."""
    found = ownership(owners, roster) if roster is not None else ownership(owners, owners.select(F.lit(0).cast("long").alias("ord"), F.lit("").alias("name"), F.lit(True).alias("active")).limit(0)).where("false")
    return worklist_items(owners, found, staleness(reviewed, now), suspects)
