"""Dependencies between documents: suspect links, inferred edges, impact."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_status(edges: DataFrame, hashes: DataFrame, stamps: DataFrame, include_ok: bool = False) -> DataFrame:
    """Status of each edge whose document exists: missing_upstream, unstamped, suspect or ok, tested in that order."""
    present = hashes.select("doc_id")
    current = hashes.select(F.col("doc_id").alias("upstream_id"), F.col("body_hash").alias("current"))
    rows = edges.join(present, "doc_id", "left_semi").join(current, "upstream_id", "left").join(stamps, ["doc_id", "upstream_id"], "left")
    status = F.when(F.col("current").isNull(), "missing_upstream").when(F.col("stamp").isNull(), "unstamped").when(F.col("stamp") != F.col("current"), "suspect").otherwise("ok")
    out = rows.withColumn("status", status)
    return out if include_ok else out.where("status <> 'ok'")


def restamp(edges: DataFrame, hashes: DataFrame, stamps: DataFrame) -> DataFrame:
    """Stamps after a review: the upstream's current hash where it differs; missing upstreams keep theirs. changed tells which moved."""
    rows = edge_status(edges, hashes, stamps, include_ok=True)
    changed = F.col("current").isNotNull() & ~F.col("stamp").eqNullSafe(F.col("current"))
    return rows.select("doc_id", "upstream_id", F.coalesce("current", "stamp").alias("stamp"), changed.alias("changed"))


def normalized_path(base: Column, link: Column) -> Column:
    """A link relative to the directory of base, with . and .. resolved; one that leaves the root keeps its .."""
    parts = F.filter(F.split(F.concat(F.regexp_replace(base, "[^/]*$", ""), link), "/"), lambda x: (x != "") & (x != "."))
    last = lambda acc: F.element_at(acc, -1)
    up = lambda acc, x: (x == "..") & (F.size(acc) > 0) & (last(F.concat(F.array(F.lit("..")), acc)) != "..")
    step = lambda acc, x: F.when(up(acc, x), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def inferred_edges(links: DataFrame, docs: DataFrame, declared: DataFrame) -> DataFrame:
    """Edges that links between managed documents suggest: not external, not to itself, not declared; the first link of a pair stays.

    links: (doc_id, path, pos, link) of the linking documents; a link that begins with / starts at the root, others
    at the document's folder. docs: (doc_id, path), the last document of a path counts.
    """
    link = F.trim(F.split(F.col("link"), "#")[0])
    own = links.where(~link.contains("://") & ~link.startswith("mailto:") & (link != "")).withColumn("path", normalized_path(F.when(link.startswith("/"), F.lit("")).otherwise(F.col("path")), link))
    by_path = docs.groupBy("path").agg(F.max("doc_id").alias("upstream_id"))
    found = own.where("path <> ''").join(by_path, "path").where("doc_id <> upstream_id").join(declared.select("doc_id", "upstream_id"), ["doc_id", "upstream_id"], "left_anti")
    return found.groupBy("doc_id", "upstream_id").agg(F.min_by("link", "pos").alias("via"))


def dependents(edges: DataFrame, origins: DataFrame, transitive: bool = True) -> DataFrame:
    """Documents that depend on an origin, directly or over any number of edges; origins themselves are left out.

    A frontier moves against the edges until it adds nothing; each round writes its frontier to
    the shared folder and reads those of all rounds before as one table, so nothing is written
    twice and a lost executor costs one round. Only whether rows are left
    reaches the driver. Cycles end because documents seen are never visited again. An unknown origin has no dependents.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/reached/{uuid.uuid4().hex}"
    seen = lambda n: spark.read.schema(kind).parquet(*[f"{folder}/{i}" for i in range(n)])

    def add(n: int, rows: DataFrame) -> bool:
        rows.write.parquet(f"{folder}/{n}")
        return not spark.read.schema(kind).parquet(f"{folder}/{n}").isEmpty()

    steps = cut(edges.select("doc_id", "upstream_id").distinct())
    start = origins.select(F.col("doc_id").cast(steps.schema["doc_id"].dataType)).distinct()
    kind = start.schema
    add(0, start)
    n, more = 1, True
    while more and (transitive or n == 1):
        last = spark.read.schema(kind).parquet(f"{folder}/{n - 1}").withColumnRenamed("doc_id", "upstream_id")
        near = steps.join(last, "upstream_id", "left_semi").select("doc_id").distinct()
        more = add(n, near.join(seen(n), "doc_id", "left_anti"))
        n += 1
    return spark.read.schema(kind).parquet(*[f"{folder}/{i}" for i in range(1, n)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one is set for local sessions only."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="docledger-")
        context.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written to the shared folder, which outlives executors and is read with column pruning."""
    path = f"{shared_dir(df.sparkSession)}/cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def transitive_suspects(edges: DataFrame, status: DataFrame) -> DataFrame:
    """Edges to documents that are or will become pending: reachable from suspect or missing-upstream ones.

    Edges that the direct report has are left out, edge by edge.
    """
    flagged = cut(status.where("status in ('suspect', 'missing_upstream')").select("doc_id").distinct())
    pending = cut(flagged.union(dependents(edges, flagged)).distinct())
    rows = edges.join(pending, "doc_id", "left_semi").join(pending.withColumnRenamed("doc_id", "upstream_id"), "upstream_id", "left_semi")
    return rows.join(status.where("status <> 'ok'").select("doc_id", "upstream_id"), ["doc_id", "upstream_id"], "left_anti").select("doc_id", "upstream_id").distinct()
