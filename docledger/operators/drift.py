"""Drift of documented surfaces: anchor differences, severity, layout lint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import severity, short_hash


def fingerprints(symbols: DataFrame) -> DataFrame:
    """Per document (doc_id, name, signature, docstring, body_hash): sorted anchors, signature by anchor and a digest per tier.

    The last definition of a name counts (by lineno, then by signature, docstring and body). Digests are order-free: of the sorted,
    escaped rows. A surface is one document's symbols and no larger.
    """
    last = symbols.groupBy("doc_id", "name").agg(F.max(F.struct("lineno", "signature", "docstring", "body_hash")).alias("s"))
    part = lambda c: F.array_sort(F.collect_list(F.concat_ws("\0", F.col("name"), F.coalesce(c, F.lit("\1")))))
    tier = lambda c: short_hash(F.array_join(part(F.col(f"s.{c}")), "\n"))
    anchors = F.array_sort(F.collect_list("name"))
    sigs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", short_hash(F.col("s.signature")).alias("sig")))))
    tiers = [tier("signature").alias("signature"), tier("docstring").alias("docstring"), tier("body_hash").alias("body")]
    return last.groupBy("doc_id").agg(anchors.alias("anchors"), sigs.alias("sigs"), *tiers)


def compare(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Differences of fingerprints: added, removed and changed anchors, moved tiers, kind and severity.

    A stored document without a current surface is MISSING_DOC; equal ones are left out.
    """
    names = ("anchors", "sigs", "signature", "docstring", "body")
    s = stored.select("doc_id", *[F.col(n).alias(f"s_{n}") for n in names])
    c = current.select("doc_id", *[F.col(n).alias(f"c_{n}") for n in names], F.lit(True).alias("present"))
    rows = s.join(c, "doc_id", "left")
    empty = F.array().cast("array<string>")
    added, removed = F.coalesce(F.array_except("c_anchors", "s_anchors"), empty), F.coalesce(F.array_except("s_anchors", "c_anchors"), empty)
    changed = F.coalesce(F.filter(F.array_intersect("s_anchors", "c_anchors"), lambda a: ~F.col("s_sigs")[a].eqNullSafe(F.col("c_sigs")[a])), empty)
    tiers = F.filter(F.array(*[F.when(~F.col(f"s_{t}").eqNullSafe(F.col(f"c_{t}")), F.lit(t)) for t in ("signature", "docstring", "body")]), lambda t: t.isNotNull())
    rows = rows.withColumns({"added": added, "removed": removed, "changed": changed, "tiers": tiers})
    kind = F.when(F.col("present").isNull(), "MISSING_DOC").otherwise("HASH")
    rows = rows.where(F.col("present").isNull() | (F.size("tiers") > 0))
    return rows.select("doc_id", kind.alias("kind"), "added", "removed", "changed", "tiers", severity(F.col("tiers"), F.col("added"), F.col("removed"), F.col("changed")).alias("severity"))


def unlinked(index: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents (doc_id, audience, path) whose path no index (audience, text) of their audience links."""
    linked = index.select("audience", F.explode(F.regexp_extract_all("text", F.lit(r"\]\(([^)#\s]+)"), F.lit(1))).alias("path")).distinct()
    return docs.join(linked, ["audience", "path"], "left_anti")


def anchor_changes(stamped: DataFrame, current: DataFrame) -> DataFrame:
    """Per document with stamped regions (doc_id, region_id, anchors): anchors added and removed against the union of all its stamps.

    current: (doc_id, anchor). A region whose anchors are null is not stamped; a document without any has no row.
    """
    known = stamped.where("anchors is not null").select("doc_id", F.explode_outer("anchors").alias("anchor")).distinct()
    docs = known.select("doc_id").distinct()
    both = known.where("anchor is not null").withColumn("was", F.lit(True)).join(current.join(docs, "doc_id", "left_semi").distinct().withColumn("now", F.lit(True)), ["doc_id", "anchor"], "full")
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("anchor"))))
    found = both.groupBy("doc_id").agg(listed(F.col("was").isNull()).alias("added"), listed(F.col("now").isNull()).alias("removed"))
    empty = F.array().cast("array<string>")
    return docs.join(found, "doc_id", "left").select("doc_id", F.coalesce("added", empty).alias("added"), F.coalesce("removed", empty).alias("removed"))
