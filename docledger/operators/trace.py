"""Text scans of bodies (regions, tags), traceability and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Marker lines of regions, with or without a prefix; an indented one is text.
BEGIN, END = r"^<!-- (?:[A-Z]+:)?BEGIN (\S+) -->\s*$", r"^<!-- (?:[A-Z]+:)?END (\S+) -->\s*$"


def regions(docs: DataFrame, begin: str = BEGIN, end: str = END) -> DataFrame:
    """Managed regions of bodies (doc_id, text): id, first and last line, body; problem tells what is wrong with a marker.

    Lines of one document are looked at in order; the window is one document, as long as its body. Bodies without a marker
    are left out before they are split.
    """
    lines = docs.where(F.col("text").contains("<!-- ")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("begin_id", F.nullif(F.regexp_extract("line", begin, 1), F.lit(""))).withColumn("end_id", F.nullif(F.regexp_extract("line", end, 1), F.lit("")))
    past = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marker = F.when(F.col("begin_id").isNotNull() | F.col("end_id").isNotNull(), F.struct("begin_id", "end_id", "pos"))
    lines = lines.withColumn("before", F.last(marker, ignorenulls=True).over(past))
    opened = F.col("before.begin_id")
    problem = (
        F.when(F.col("begin_id").isNotNull() & opened.isNotNull(), "nested").when(F.col("end_id").isNotNull() & opened.isNull(), "unopened")
        .when(F.col("end_id").isNotNull() & (F.col("end_id") != opened), "mismatched")
    )
    lines = lines.withColumn("problem", problem).withColumn("region", opened)
    inside = lines.where("region is not null and begin_id is null and end_id is null").groupBy("doc_id", "region", F.col("before.pos").alias("start")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    closed = lines.where("end_id is not null").select("doc_id", F.col("end_id").alias("region_id"), F.col("before.pos").alias("start"), F.col("pos").alias("stop"), "problem")
    last = lines.groupBy("doc_id").agg(F.max_by(F.struct("begin_id", "pos"), F.when(marker.isNotNull(), F.col("pos"))).alias("m")).where("m.begin_id is not null")
    left_open = last.select("doc_id", F.col("m.begin_id").alias("region_id"), F.col("m.pos").alias("start"), F.lit(None).cast("int").alias("stop"), F.lit("unterminated").alias("problem"))
    nested = lines.where("problem = 'nested'").select("doc_id", F.col("begin_id").alias("region_id"), F.col("pos").alias("start"), F.lit(None).cast("int").alias("stop"), "problem")
    found = closed.unionByName(left_open).unionByName(nested)
    return found.join(inside.drop("region"), ["doc_id", "start"], "left").withColumn("body", F.coalesce("body", F.lit("")))


#: A feature's id, alone and within a text, and the marker with the run of ids behind it.
FEATURE_ID = r"^FEAT-[A-Z][A-Z0-9]*-\d{3}$"
FEATURE_IN_TEXT = r"\bFEAT-[A-Z][A-Z0-9]*-\d{3}\b"
FEATURE_TAG = r"(?i)\bFeatures?:\s*(FEAT-[A-Z0-9 ,\-]+)"
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def tags(docs: DataFrame, marker: str = FEATURE_TAG, id_pattern: str = FEATURE_IN_TEXT) -> DataFrame:
    """Ids after a marker in bodies (doc_id, text), by line from 1, one row each; ids in plain prose do not count.

    Lines without the marker are dropped before anything is extracted.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", LINE_END)).alias("pos", "line")).where(F.col("line").rlike(marker))
    runs = lines.select("doc_id", (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all("line", F.lit(marker), F.lit(1))).alias("run"))
    return runs.select("doc_id", "line", F.explode(F.regexp_extract_all("run", F.lit(id_pattern), F.lit(0))).alias("feature_id"))


def trace_matrix(features: DataFrame, refs: DataFrame) -> DataFrame:
    """Features (feature_id) by evidence (feature_id, kind, path): has_test, has_demo; ids without a feature are `unknown`."""
    found = refs.groupBy("feature_id").agg(F.bool_or(F.col("kind") == "test").alias("has_test"), F.bool_or(F.col("kind") == "demo").alias("has_demo"), F.count_distinct("path").alias("n_paths"))
    rows = features.select("feature_id", F.lit(True).alias("known")).join(found, "feature_id", "full")
    tested, shown = F.coalesce("has_test", F.lit(False)), F.coalesce("has_demo", F.lit(False))
    status = F.when(F.col("known").isNull(), "unknown").when(~tested, "no_test").when(~shown, "no_demo").otherwise("complete")
    return rows.select("feature_id", tested.alias("has_test"), shown.alias("has_demo"), F.coalesce("n_paths", F.lit(0)).alias("n_paths"), status.alias("status"))


def source_index(symbols: DataFrame, features: DataFrame) -> DataFrame:
    """Modules (first directory) with their first path, distinct public top-level names and features that name them.

    features: (feature_id, modules). Modules without features and features' unknown modules stay visible.
    """
    from docledger.functions.text import is_public

    module = F.split("path", "/")[0]
    top = symbols.where(is_public(F.col("name")) & ~F.col("name").contains(".")).select(module.alias("module"), "path", "name")
    index = top.groupBy("module").agg(F.min("path").alias("first_path"), F.count_distinct("name").alias("n_symbols"))
    named = features.select("feature_id", F.explode("modules").alias("module")).groupBy("module").agg(F.count_distinct("feature_id").alias("n_features"))
    return index.join(named, "module", "full").select("module", "first_path", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"), F.coalesce("n_features", F.lit(0)).alias("n_features"))


def module_index(files: DataFrame, symbols: DataFrame, features: DataFrame) -> DataFrame:
    """Modules of a package with their first path, public top-level names and the features that name them, each sorted.

    A file (path) belongs to the directory below the root that it is in, at the root to its own stem; the root's __init__ only
    re-exports and has no module. symbols: (path, name); features: (feature_id, modules). A module without public names is listed.
    """
    from docledger.functions.text import is_public

    parts = F.split("path", "/")
    stem = F.regexp_replace(F.get(parts, 0), r"(?<=.)\.[^.]*\z", "")
    module = F.when(F.size(parts) > 1, F.get(parts, 0)).when(stem != "__init__", stem)
    own = files.select("path", module.alias("module")).where("module is not null")
    public = symbols.where(is_public(F.col("name")) & ~F.col("name").contains(".")).select("path", "name")
    index = own.join(public, "path", "left").groupBy("module").agg(F.min("path").alias("path"), F.array_sort(F.collect_set("name")).alias("symbols"))
    named = features.select("feature_id", F.explode("modules").alias("module")).groupBy("module").agg(F.array_sort(F.collect_list("feature_id")).alias("features"))
    return index.join(named, "module", "left").withColumn("features", F.coalesce("features", F.array().cast("array<string>")))


def features_without_module(features: DataFrame, index: DataFrame) -> DataFrame:
    """Features (feature_id, modules) none of whose modules the index has."""
    there = features.select("feature_id", F.explode("modules").alias("module")).join(index.select("module"), "module", "left_semi").select("feature_id")
    return features.select("feature_id").distinct().join(there, "feature_id", "left_anti")
