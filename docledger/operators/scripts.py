"""Shell scripts as text: functions with their comments, and switches. Nothing is run or sourced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.sources.extractors import SHELL_GETOPTS, SHELL_LABEL
from docledger.sources.logs import spread

#: A function's header: name() { or function name {, up to the brace.
_HEADER = r"^\s*(?:function\s+([A-Za-z_]\w*)\s*(?:\(\s*\))?|([A-Za-z_]\w*)\s*\(\s*\))\s*\{"
_GETOPTS, _CASE = SHELL_GETOPTS, SHELL_LABEL


def _lines_to_close(rest: Column) -> Column:
    """Lines that a text goes on until the braces that it closes outnumber those it opens by one; 0 if they never do."""
    pieces = F.regexp_extract_all(rest, F.lit(r"(?s)[^{}]*[{}]"), F.lit(0))
    zero = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("line"), F.lit(-1).alias("end"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x.endswith("{"), 1).otherwise(-1)
        line = s["line"] + F.char_length(x) - F.char_length(F.replace(x, F.lit("\n"), F.lit("")))
        return F.struct(depth.alias("depth"), line.alias("line"), F.when((depth == 0) & (s["end"] < 0), line).otherwise(s["end"]).alias("end"))

    return F.greatest(F.aggregate(pieces, zero, step)["end"], F.lit(0))


def _comment_above(lines: Column, index: Column) -> Column:
    """The comment lines right above a line, without their marks; null without any. A shebang is none."""
    above = F.reverse(F.slice(lines, F.lit(1), index))
    is_comment = lambda x: F.ltrim(x).startswith("#") & ~F.ltrim(x).startswith("#!")
    first_other = F.array_position(F.transform(above, is_comment), F.lit(False))
    run = F.reverse(F.slice(above, F.lit(1), F.when(first_other > 0, first_other - 1).otherwise(F.size(above)).cast("int")))
    return F.when(F.size(run) > 0, F.array_join(F.transform(run, lambda x: F.rtrim(F.regexp_replace(F.ltrim(x), "^# ?", ""))), "\n"))


def shell_functions(files: DataFrame) -> DataFrame:
    """Functions of shell scripts (path, text): path, name, signature, lineno, end_lineno, docstring.

    Braces in quotes count as any others; a block that never closes ends at its header.
    """
    lines = F.split("text", r"\r?\n")
    rows = spread(files.select("path", "text")).select("path", lines.alias("lines"), F.posexplode(lines).alias("i", "line")).where(F.col("line").rlike(_HEADER))
    name = F.coalesce(F.nullif(F.regexp_extract("line", _HEADER, 1), F.lit("")), F.regexp_extract("line", _HEADER, 2))
    rest = F.array_join(F.concat(F.array(F.regexp_replace("line", _HEADER, "")), F.slice("lines", F.col("i") + 2, F.size("lines"))), "\n")
    return rows.select("path", name.alias("name"), F.concat(name, F.lit("()")).alias("signature"), (F.col("i") + 1).alias("lineno"), (F.col("i") + 1 + _lines_to_close(rest)).alias("end_lineno"), _comment_above(F.col("lines"), F.col("i")).alias("docstring"))


def shell_switches(files: DataFrame) -> DataFrame:
    """Switches (path, switch) of shell scripts: letters of getopts where it is used, else labels of case branches."""
    letters = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all("text", F.lit(_GETOPTS), F.lit(1)), lambda o: F.split(F.replace(o, F.lit(":"), F.lit("")), ""))))
    options = F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.concat(F.lit("-"), c))
    labels = F.array_distinct(F.regexp_extract_all("text", F.lit(_CASE), F.lit(1)))
    found = F.when(F.col("text").rlike(_GETOPTS), options).otherwise(labels)
    return files.select("path", F.explode(found).alias("switch"))
