"""Documentation coverage of files and symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import directories, glob_regex, is_public, proposed_doc_id


def selects(ref: str = "ref") -> Column:
    """Whether a reference selects a symbol: by name or class, as a named variable, by lines; without selectors all."""
    r = F.col(ref)
    whole = (F.size(r["symbols"]) == 0) & (F.size(r["names"]) == 0) & (F.size(r["lines"]) == 0)
    by_name = F.array_contains(r["symbols"], F.col("name")) | F.array_contains(r["symbols"], F.split("name", r"\.")[0])
    by_variable = (F.col("kind") == "variable") & F.array_contains(r["names"], F.col("name"))
    by_lines = F.exists(r["lines"], lambda x: (F.col("lineno") <= x["e"]) & (F.col("end_lineno") >= x["s"]))
    return whole | by_name | by_variable | by_lines


def selected_symbols(symbols: DataFrame, refs: DataFrame, surface: bool = False) -> DataFrame:
    """Symbols with the documents that select them. A surface also keeps to audience and exact arguments; ownership does not."""
    packed = refs.select("path", F.struct(*[c for c in refs.columns if c != "path"]).alias("ref"))
    rows = symbols.join(packed, "path").where(selects())
    if surface:
        callable_ = F.col("kind").isin("function", "method")
        rows = rows.where((F.col("ref.audience") != "user-guide") | is_public(F.col("name")))
        rows = rows.where(F.col("ref.arg_signature").isNull() | (callable_ & (F.col("arg_names") == F.col("ref.arg_signature"))))
    return rows.select(F.col("ref.doc_id").alias("doc_id"), *symbols.columns).distinct()


def waiver_reason(waivers: list[tuple[str, str | None, str]], path: Column, symbol: Column | None = None) -> Column:
    """Reason of the first waiver (glob, symbol, reason) that applies; waivers are a few lines of configuration."""
    out = F.lit(None).cast("string")
    for glob, name, reason in reversed(waivers):
        hit = path.rlike(glob_regex(glob))
        if name is not None:
            hit = hit & (symbol == name) if symbol is not None else F.lit(False)
        out = F.when(hit, F.lit(reason)).otherwise(out)
    return out


def file_coverage(files: DataFrame, refs: DataFrame, waivers: list) -> DataFrame:
    """Files with their owners, sorted, and status documented, waived or undocumented. Documented wins over waived."""
    owners = refs.groupBy("path").agg(F.array_sort(F.collect_set("doc_id")).alias("owners"))
    out = files.join(owners, "path", "left").withColumn("owners", F.coalesce("owners", F.array().cast("array<string>")))
    reason = F.when(F.size("owners") == 0, waiver_reason(waivers, F.col("path")))
    return out.withColumn("waived_reason", reason).withColumn("status", F.when(F.size("owners") > 0, "documented").when(F.col("waived_reason").isNotNull(), "waived").otherwise("undocumented"))


def symbol_coverage(symbols: DataFrame, refs: DataFrame, waivers: list) -> DataFrame:
    """Symbols with owners and status; private ones are tracked as `private` unless documented."""
    keys = ["path", "name", "kind", "lineno"]
    owners = selected_symbols(symbols, refs).groupBy(*keys).agg(F.min("doc_id").alias("owner"), F.count_distinct("doc_id").alias("n_owners"))
    out = symbols.join(owners, keys, "left").withColumn("public", is_public(F.col("name")))
    reason = F.when(F.col("owner").isNull() & F.col("public"), waiver_reason(waivers, F.col("path"), F.col("name")))
    status = F.when(F.col("owner").isNotNull(), "documented").when(~F.col("public"), "private").when(F.col("waived_reason").isNotNull(), "waived").otherwise("undocumented")
    return out.withColumn("waived_reason", reason).withColumn("status", status)


def percent(documented: Column, universe: Column, waived: Column) -> Column:
    """Documented share of what is not waived; 100 for an empty universe."""
    return F.when(universe - waived == 0, 100.0).otherwise(documented / (universe - waived) * 100)


def report_percent(documented: Column, universe: Column, waived: Column) -> Column:
    """As percent, to two places from whole numbers, half up; null for an empty universe."""
    base = universe - waived
    return F.when(base > 0, F.floor((documented * 20000 + base) / (2 * base)) / 100)


def summary(rows: DataFrame, *by: str) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("documented", "undocumented", "waived")]
    return rows.groupBy(*by).agg(F.count("*").alias("universe"), *counts)


def owning_unit(files: DataFrame, unit_dirs: DataFrame) -> DataFrame:
    """Files with the unit of the deepest covered directory above them; ties go to the first unit.

    unit_dirs: (ord, unit, dir), a configuration table. A file's directories are joined by
    equality, so no pair of file and directory is tried in vain.
    """
    above = files.select("path", F.explode(directories(F.col("path"))).alias("dir"))
    deepest = F.struct(F.size(F.split("dir", "/")).alias("depth"), (-F.col("ord")).alias("o"))
    best = above.join(unit_dirs, "dir").groupBy("path").agg(F.max_by("unit", deepest).alias("owning_unit"))
    return files.join(best, "path", "left")


def by_unit(units: DataFrame, files: DataFrame) -> DataFrame:
    """Coverage per unit (of files with owning_unit and status); units without files are listed with no percentage."""
    found = summary(files.where("owning_unit is not null"), "owning_unit").withColumnRenamed("owning_unit", "unit")
    out = units.join(found, "unit", "left").fillna(0, ["universe", "documented", "undocumented", "waived"])
    return out.withColumn("percent", report_percent(F.col("documented"), F.col("universe"), F.col("waived")))


def suggest_owners(symbols: DataFrame) -> DataFrame:
    """For each undocumented public symbol the smallest document of its file, else a new one named after the path."""
    sibling = symbols.where("owner is not null").groupBy("path").agg(F.min("owner").alias("sibling"))
    gaps = symbols.where("status = 'undocumented'").join(sibling, "path", "left")
    reason = F.coalesce(F.concat(F.lit("sibling symbols already in "), "sibling"), F.concat(F.lit("no doc references "), "path"))
    return gaps.select("path", "name", "lineno", F.coalesce("sibling", proposed_doc_id(F.col("path"))).alias("suggested_doc_id"), F.col("sibling").isNull().alias("is_new_doc"), reason.alias("reason"))


def directory_rollup(rows: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Counts by status of all that lies below each directory. Rows are first counted by their own directory."""
    own = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
    near = rows.withColumn("own", own).where("own is not null").groupBy("own").agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    above = near.withColumn("dir", F.explode(directories(F.concat("own", F.lit("/x")))))
    return above.groupBy("dir").agg(*[F.sum(s).alias(s) for s in statuses]).withColumn("depth", F.size(F.split("dir", "/")))


def effective_scope(rows: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Paths that an include glob matches and no exclude glob does."""
    p = F.col("path")
    hit = lambda globs: reduce(lambda a, b: a | b, [p.rlike(glob_regex(g)) for g in globs], F.lit(False))
    return rows.where(hit(include) & ~hit(exclude))


def scoped_files(files: DataFrame, units: DataFrame) -> DataFrame:
    """Files (path) in scope: the unit whose directory is the deepest above a file takes its extension.

    units: (dir, unit, formats). A parent's formats do not reach into a child's directory. Directories
    above a path join units by equality.
    """
    above = files.select("path", F.explode(directories(F.col("path"))).alias("dir"))
    owner = above.join(units, "dir").groupBy("path").agg(F.max_by(F.struct("unit", "formats"), F.char_length("dir")).alias("u"))
    inside = F.exists("u.formats", lambda f: F.col("path").endswith(f))
    return owner.where(inside).select("path", F.col("u.unit").alias("unit"))
