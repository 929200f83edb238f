"""A monitor run: detect drift, decide, record, apply, and detect again until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import body_hash
from docledger.operators import layout, trace
from docledger.operators.documents import offline_verdict
from docledger.operators.graph import cut

RECORD = ("doc_id", "kind", "subject", "healable", "verdict", "source", "applied")


def _with_bodies(docs: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions with the body that they have in their document; those that are not there have none."""
    bodies = trace.regions(docs.where("text is not null").select("doc_id", "text")).where("problem is null and stop is not null").select("doc_id", "region_id", "body")
    return regions.join(bodies, ["doc_id", "region_id"], "left")


def corrected(docs: DataFrame, regions: DataFrame, fingerprint: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text, stored, current and more) and regions after the engine has written what it may.

    regions: doc_id, region_id, mode, stored_hash, expected (null where nothing is rendered), known, declared. A region that the
    engine authors gets its expected body and that body's hash as its stamp, a human one the hash of the body it has, a locked one keeps both; with
    fingerprint the document's stamp becomes the current one. All else stays byte for byte, and a second run changes nothing.
    """
    states = layout.region_states(_with_bodies(docs, regions.where("declared")))
    own = F.col("known") & F.col("expected").isNotNull() & ~F.col("advisory") & F.col("body").isNotNull()
    stamp = F.when(own, body_hash(F.col("expected"))).when((F.col("mode") == "human") & F.col("body").isNotNull() & F.lit(fingerprint), body_hash(F.col("body"))).otherwise(F.col("stored_hash"))
    written = layout.replaced_regions(docs.where("text is not null").select("doc_id", "text"), states.where(own).select("doc_id", "region_id", F.col("expected").alias("body")))
    after = docs.join(written.select("doc_id", F.col("text").alias("new_text")), "doc_id", "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")
    after = after.withColumn("stored", F.when(F.col("text").isNotNull(), F.col("current")).otherwise(F.col("stored"))) if fingerprint else after
    stamped = states.select("doc_id", "region_id", stamp.alias("stamp"), F.lit(True).alias("seen"))
    stamps = regions.join(stamped, ["doc_id", "region_id"], "left").withColumn("stored_hash", F.when(F.col("seen"), F.col("stamp")).otherwise(F.col("stored_hash")))
    return after.select(docs.columns), stamps.select(regions.columns)


def detected(docs: DataFrame, regions: DataFrame, suspects: DataFrame) -> DataFrame:
    """Drift findings of documents (a null text is a missing one) with their regions as they are."""
    present = docs.select("doc_id", F.col("text").isNotNull().alias("present"), "stored", "current")
    return layout.drift_findings(present, _with_bodies(docs, regions).where("body is not null"), suspects)


def decided(drifts: DataFrame, docs: DataFrame, regions: DataFrame, rules: DataFrame) -> DataFrame:
    """Drifts with verdict and source: the rule of a document's kind and audience (doc_id, kind, audience, verdict), else the offline verdict.

    A rule carries no fix, so nothing of it is applied; neither is a fix of what the engine may not write.
    """
    rows = drifts.join(docs.select("doc_id", "audience", "detail"), "doc_id", "left").join(rules.withColumnRenamed("verdict", "ruled"), ["doc_id", "kind", "audience"], "left")
    renders = regions.select("doc_id", F.col("region_id").alias("subject"), (F.col("known") & F.col("expected").isNotNull()).alias("renders"), "mode")
    rows = rows.join(renders, ["doc_id", "subject"], "left")
    offline = offline_verdict(F.col("kind"), F.col("audience"), F.coalesce("detail", F.lit("")), F.coalesce("renders", F.lit(False)), F.coalesce("mode", F.lit("")))
    rows = rows.withColumns({"verdict": F.coalesce("ruled", offline), "source": F.when(F.col("ruled").isNotNull(), "rule").otherwise("backend")})
    return rows.withColumn("applied", (F.col("verdict") == "FIX") & F.col("healable") & (F.col("source") == "backend") & F.col("kind").isin("HASH", "REGION")).select(*RECORD)


def run(docs: DataFrame, regions: DataFrame, suspects: DataFrame, rules: DataFrame, bound: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, regions, records (RECORD and round) and what remains, after at most bound rounds.

    docs: doc_id, text, stored, current, audience, detail. The first round detects all drift, a later one that of the documents which the
    round before has touched, since all else has drifted as before; what has no record yet is decided and recorded;
    fixes are applied, of a moved surface to the whole document, of a region to that one. It ends with the first round that applies
    nothing. Each round writes its documents, regions and records to the shared folder, so a lost executor repeats one round at most,
    and a run that is started again on its own result records only what is left.
    """
    records = standing = touched = None

    def seen(standing: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Drift of what was touched last, and with it all drift that stands."""
        own = [docs, regions, suspects] if standing is None else [x.join(touched, "doc_id", "left_semi") for x in (docs, regions, suspects)]
        found = cut(detected(*own))
        return found, found if standing is None else standing.join(touched, "doc_id", "left_anti").unionByName(found)

    for n in range(bound):
        found, standing = seen(standing)
        same = lambda a, b: F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))
        new = found if records is None else found.alias("a").join(records.alias("b"), same("doc_id", "doc_id") & same("kind", "kind") & same("subject", "subject"), "left_anti")
        told = cut(decided(new, docs, regions, rules).withColumn("round", F.lit(n)))
        records = told if records is None else records.unionByName(told)
        fixes = told.where("applied")
        if fixes.isEmpty():
            break
        whole = fixes.where("kind = 'HASH'").select("doc_id").distinct()
        parts = fixes.where("kind = 'REGION'").select("doc_id", F.col("subject").alias("region_id")).join(whole, "doc_id", "left_anti").distinct()
        some = parts.select("doc_id").distinct()
        a_docs, a_regions = corrected(docs.join(whole, "doc_id", "left_semi"), regions.join(whole, "doc_id", "left_semi"))
        b_docs, b_regions = corrected(docs.join(some, "doc_id", "left_semi"), regions.join(parts, ["doc_id", "region_id"], "left_semi"), fingerprint=False)
        touched = whole.union(some)
        docs_after = cut(docs.join(touched, "doc_id", "left_anti").unionByName(a_docs).unionByName(b_docs))
        others = regions.join(whole, "doc_id", "left_anti").join(parts, ["doc_id", "region_id"], "left_anti").select(regions.columns)
        regions = cut(others.unionByName(a_regions).unionByName(b_regions))
        docs = docs_after
    else:
        _, standing = seen(standing)
    return docs, regions, records, standing
