"""Entity tables of documentation governance, derived from the raw tables of a folder.

Each function takes (spark, sf_dir) and returns one entity table. Timestamps
are zone-less; sessions run in UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "1998-08-01"
SLA_DAYS = {"AUTOMOBILE": 60, "BUILDING": 120, "MACHINERY": 30}
DEFAULT_SLA = 90


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review records from events."""
    e = raw(spark, sf_dir, "events")
    kinds = F.array(*[F.lit(k) for k in ("HASH", "REGION", "MISSING_DOC", "UNHEALABLE", "SUSPECT_LINK")])
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("repo-"), F.col("user_id") % 8).alias("repo_id"),
        F.col("event_id").cast("string").alias("record_id"),
        F.concat(F.lit("doc-"), F.col("user_id")).alias("doc_id"),
        F.when(F.col("user_id") % 2 == 0, "user-guide").otherwise("eng-guide").alias("audience"),
        F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("drift_kind"),
        F.when(F.col("event_type") == "error", "ESCALATE").when(F.col("event_type") == "signup", "INVALIDATE").otherwise("FIX").alias("verdict"),
        F.substring(F.sha2("props", 256), 1, 16).alias("surface_hash"),
        F.col("ts").alias("detected_at"),
    )


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human resolutions of records: one for two thirds of them, a second for some."""
    e = raw(spark, sf_dir, "events").where("event_id % 3 <> 0")
    outcomes = F.array(*[F.lit(x) for x in ("accepted", "rejected", "invalidated", "overridden")])
    outcome = F.when(F.col("event_id") % 11 == 0, "overridden").otherwise(F.get(outcomes, ((F.col("user_id") + F.col("event_id") % 5) % 4).cast("int")))
    first = e.select((2 * F.col("event_id")).alias("seq"), F.col("event_id").cast("string").alias("record_id"), outcome.alias("resolution"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("resolved_at"))
    second = e.where("event_id % 21 = 1").select((2 * F.col("event_id") + 1).alias("seq"), F.col("event_id").cast("string").alias("record_id"), F.lit("rejected").alias("resolution"), (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("resolved_at"))
    return first.unionByName(second)


def reviewed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the day of their last review; SLA days of their audience."""
    c, o = raw(spark, sf_dir, "customer"), raw(spark, sf_dir, "orders")
    last = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("reviewed"))
    sla = F.coalesce(*[F.when(F.col("c_mktsegment") == a, F.lit(d)) for a, d in SLA_DAYS.items()], F.lit(DEFAULT_SLA))
    return c.join(last, c.c_custkey == last.o_custkey, "left").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("audience"), "reviewed", sla.alias("sla_days"))


def doc_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared owners; empty strings count as undeclared."""
    c, n = raw(spark, sf_dir, "customer"), raw(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(  # nation has 25 rows by definition
        k.alias("doc_id"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("owner-"), k % 50)).alias("owner"),
        F.when(k % 4 == 0, F.col("n_name")).alias("team"),
        F.when(F.col("c_acctbal") >= 5000, F.col("c_name")).alias("dri"),
        F.lit(None).cast("string").alias("inherited"),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities by name, in order; a duplicate name counts by its first row."""
    n, c = raw(spark, sf_dir, "nation"), raw(spark, sf_dir, "customer")
    teams = n.select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 != 0).alias("active"))
    owners = spark.range(40).select((F.col("id") + 100).alias("ord"), F.concat(F.lit("owner-"), F.col("id")).alias("name"), (F.col("id") % 5 != 0).alias("active"))
    people = c.select((F.col("c_custkey") + 1000).alias("ord"), F.col("c_name").alias("name"), (F.col("c_custkey") % 2 == 0).alias("active"))
    return teams.unionByName(owners).unionByName(people)


def doc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges document -> upstream: a binary tree with one cycle."""
    c = raw(spark, sf_dir, "customer").where("c_custkey > 1").select(F.col("c_custkey").alias("doc_id"), F.floor(F.col("c_custkey") / 2).cast("long").alias("upstream_id"))
    cycle = spark.createDataFrame([(5, 40)], "doc_id long, upstream_id long")
    return c.unionByName(cycle).withColumn("type", F.lit("derives"))


def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current hash of every third document's upstream body; others' files are missing where the key ends in 7."""
    c = raw(spark, sf_dir, "customer").where("c_custkey % 10 <> 7")
    return c.select(F.col("c_custkey").alias("doc_id"), F.substring(F.sha2(F.col("c_name"), 256), 1, 16).alias("body_hash"))


def edge_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored stamps of edges: absent for every fifth document, outdated for every seventh."""
    e = doc_edges(spark, sf_dir).where("doc_id % 5 <> 0")
    c = raw(spark, sf_dir, "customer").select(F.col("c_custkey").alias("upstream_id"), "c_name")
    name = F.when(F.col("doc_id") % 7 == 0, F.concat("c_name", F.lit(" old"))).otherwise(F.col("c_name"))
    return e.join(c, "upstream_id").select("doc_id", "upstream_id", F.substring(F.sha2(name, 256), 1, 16).alias("stamp"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files: one per part, under the directory of its type's words."""
    p = raw(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lower(F.regexp_replace("p_type", " ", "/")), F.lit("/part_"), F.col("p_partkey"), F.when(F.col("p_partkey") % 4 == 0, ".txt").otherwise(".py")).alias("path"),
        F.col("p_partkey").alias("file_id"), F.col("p_type").alias("unit"), F.col("p_brand").alias("brand"),
    )


def code_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References document -> file: suppliers with returned lines of large quantity."""
    lines = raw(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select("l_partkey", "l_suppkey")
    return lines.join(files(spark, sf_dir), F.col("l_partkey") == F.col("file_id")).select(F.concat(F.lit("doc-"), F.col("l_suppkey")).alias("doc_id"), "path").distinct()


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols: one per order line of quantity 40 or more, in the file of its part; every fifth is private."""
    lines = raw(spark, sf_dir, "lineitem").where("l_quantity >= 40")
    f = files(spark, sf_dir).select("path", "file_id")
    name = F.concat(F.when(F.col("l_orderkey") % 5 == 0, "_").otherwise(""), F.lit("C"), F.col("l_suppkey") % 7, F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(".m"), F.col("l_linenumber"))).otherwise(""))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "method").when(F.col("l_linenumber") % 3 == 0, "variable").otherwise("class")
    lineno = F.col("l_orderkey").cast("int")
    return lines.join(f, F.col("l_partkey") == F.col("file_id")).select("path", name.alias("name"), kind.alias("kind"), lineno.alias("lineno"), (lineno + F.col("l_linenumber")).alias("end_lineno"), F.array(F.lower("l_returnflag"), F.lower("l_linestatus")).alias("arg_names"))


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with selectors: by class, by variable name, by lines, or the whole file."""
    refs = code_refs(spark, sf_dir)
    n = F.substring("doc_id", 5, 20).cast("long")
    return refs.select(
        "doc_id", "path", F.when(n % 2 == 0, "user-guide").otherwise("eng-guide").alias("audience"),
        F.when(n % 4 == 0, F.array(F.concat(F.lit("C"), n % 7))).otherwise(F.array().cast("array<string>")).alias("symbols"),
        F.when(n % 4 == 1, F.array(F.concat(F.lit("C"), n % 7), F.lit("C0"))).otherwise(F.array().cast("array<string>")).alias("names"),
        F.when(n % 4 == 2, F.array(F.struct(F.lit(1).alias("s"), F.lit(2000).alias("e")))).otherwise(F.array().cast("array<struct<s:int,e:int>>")).alias("lines"),
        F.when(n % 8 == 4, F.array(F.lit("r"), F.lit("f"))).cast("array<string>").alias("arg_signature"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Managed documents: pages by the path of their address."""
    return raw(spark, sf_dir, "pages").select("page_id", F.expr("regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)").alias("path"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in page bodies, in order."""
    p = raw(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)")).alias("pos", "link"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").select("doc_id", "text")
