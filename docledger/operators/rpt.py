"""Coverage reports as text, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.text import normalized

VERSION, VERSION_KEY, GENERATOR = "1.0.0", "report-version", "docledger"
SUMMARY = ("scanned_files", "documented_files", "waived_files", "ignored_files", "uncovered_files", "percent")


def scalar(c: Column) -> Column:
    """A text on one line as YAML reads it back: in quotes where a plain one would mean something else."""
    odd = c.rlike(r"""[\[\]{},]|: |:$| #|^[\s\-?:!&*|>%@`"'#]|\s$|^(~|null|true|false|yes|no|on|off|[-+.0-9]*)$""")
    return F.when(odd, F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(c)


def _unquoted(c: Column) -> Column:
    return F.when(c.rlike("^'.*'$"), F.replace(F.expr("substring(v, 2, char_length(v) - 2)"), F.lit("''"), F.lit("'"))).otherwise(c)


def _percent(c: str) -> Column:
    return F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.2f", F.col(c)))


def render(summaries: DataFrame, units: DataFrame, gaps: DataFrame) -> DataFrame:
    """Reports as text, one per repo: head, summary, units and undocumented files, always in the same order.

    summaries: repo, ref and SUMMARY; units: repo, ord, unit, file, scanned, documented, percent, uncovered (paths); gaps: repo, path,
    suggested_unit, reason. Percentages have two decimals, n/a where there is none. A report is one row, as it is one file.
    """
    line = lambda text, c: F.concat(F.lit(text), c)
    listed = F.when(F.size("uncovered") == 0, F.array(F.lit("    uncovered: []"))).otherwise(F.concat(F.array(F.lit("    uncovered:")), F.transform(F.array_sort("uncovered"), lambda p: line("      - ", p))))
    own = F.concat(F.array(line("  - unit: ", F.col("unit")), line("    file: ", F.col("file")), line("    scanned: ", F.col("scanned")), line("    documented: ", F.col("documented")), line("    percent: ", _percent("percent"))), listed)
    unit_lines = units.select("repo", F.struct("ord", own.alias("lines")).alias("x")).groupBy("repo").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["lines"])).alias("units"))
    gap = F.array(line("  - path: ", F.col("path")), line("    suggested_unit: ", F.coalesce("suggested_unit", F.lit("null"))), line("    reason: ", scalar(F.col("reason"))))
    gap_lines = gaps.select("repo", F.struct("path", gap.alias("lines")).alias("x")).groupBy("repo").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["lines"])).alias("gaps"))
    head = F.array(F.lit("---"), F.lit(f"{VERSION_KEY}: {VERSION}"), F.lit("kind: coverage"), line("repo: ", F.col("repo")), line("ref: ", F.coalesce("ref", F.lit("null"))), F.lit(f"generated-by: {GENERATOR}"), F.lit("---"), F.lit("summary:"))
    numbers = F.array(*[line(f"  {n}: ", _percent(n) if n == "percent" else F.col(n)) for n in SUMMARY])
    part = lambda name, c: F.coalesce(F.concat(F.array(F.lit(f"{name}:")), c), F.array(F.lit(f"{name}: []")))
    rows = summaries.join(unit_lines, "repo", "left").join(gap_lines, "repo", "left")
    lines = F.concat(head, numbers, part("units", F.col("units")), part("undocumented", F.col("gaps")), F.array(F.lit("")))
    return rows.select("repo", F.array_join(lines, "\n").alias("text"))


def parse(files: DataFrame) -> DataFrame:
    """Reports (file, text) as rows (file, part, pos, fields, uncovered): head, summary, units and undocumented, in order of pos.

    fields are texts by name, n/a and null are null; uncovered are a unit's paths. A file without a fence, with one that never closes,
    or of another version has one row with part problem and its text in fields. Lines of a file are looked at in order, in one window per file.
    """
    text = normalized(F.col("text"))
    closed = F.locate("\n---\n", text, 4)
    version = F.regexp_extract(F.substring(text, F.lit(1), closed), rf"(?m)^{VERSION_KEY}: *(\S+)$", 1)
    problem = F.when(~F.coalesce(text.startswith("---\n"), F.lit(False)), "missing fence").when(closed == 0, "unterminated fence").when(version != VERSION, F.concat(F.lit("version "), version))
    rows = files.select("file", text.alias("text"), problem.alias("problem"))
    bad = rows.where("problem is not null").select("file", F.lit("problem").alias("part"), F.lit(0).alias("pos"), F.create_map(F.lit("problem"), F.col("problem")).alias("fields"), F.array().cast("array<string>").alias("uncovered"))
    lines = rows.where("problem is null").select("file", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> '' and line <> '---'")
    past = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    section = F.when(F.col("line").rlike(r"^(summary|units|undocumented):"), F.regexp_extract("line", r"^(\w+):", 1))
    start = F.when(F.col("line").startswith("  - ") | section.isNotNull() | (F.col("pos") == 1), F.col("pos"))
    lines = lines.withColumns({"part": F.coalesce(F.last(section, ignorenulls=True).over(past), F.lit("head")), "item": F.last(start, ignorenulls=True).over(past)})
    key, v = F.regexp_extract("line", r"^[\s-]*([\w-]+):", 1), F.regexp_extract("line", r"^[\s-]*[\w-]+: ?(.*)$", 1)
    lines = lines.withColumns({"k": F.when(~F.col("line").startswith("      - "), key), "v": v}).withColumn("v", _unquoted(F.col("v")))
    value = F.when(~F.col("v").isin("n/a", "null"), F.col("v"))
    pair = F.when((F.col("k") != F.col("part")) & (F.col("k") != "uncovered"), F.struct(F.col("k").alias("key"), value.alias("value")))
    paths = F.transform(F.array_sort(F.collect_list(F.when(F.col("line").startswith("      - "), F.struct("pos", F.substring("line", 9, 1 << 30).alias("p"))))), lambda x: x["p"])
    items = lines.groupBy("file", "part", F.col("item").alias("pos")).agg(F.map_from_entries(F.collect_list(pair)).alias("fields"), paths.alias("uncovered"))
    return bad.unionByName(items.where(F.size("fields") > 0))
