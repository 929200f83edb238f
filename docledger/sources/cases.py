"""Test cases of Python test files, read from their syntax trees: node ids, boundaries, feature tags."""

from __future__ import annotations

import ast
import inspect
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.operators.trace import FEATURE_IN_TEXT, FEATURE_TAG
from docledger.sources.logs import spread

#: Directories that name a boundary, in the order of a report (fixed values).
BOUNDARIES = ("unit", "integration", "system", "smoke", "regression")
CASE = "nodeid string, name string, pos int, summary string, features array<string>, module_features array<string>"


class UnparseableTestError(ValueError):
    """A test file that is no Python."""


def boundary(path: Column) -> Column:
    """The first directory of a path, or its file's name, that names a boundary; unknown without one."""
    known = F.filter(F.split(path, "/"), lambda part: part.isin(*BOUNDARIES))
    return F.coalesce(F.get(known, 0), F.lit("unknown"))


def _tagged(doc: str | None) -> set[str]:
    """Feature ids behind a marker in a docstring; ids in its prose do not count."""
    return {i for run in re.findall(FEATURE_TAG, doc or "") for i in re.findall(FEATURE_IN_TEXT, run)}


def _tests(tree: ast.Module) -> Iterator[tuple[str, ast.FunctionDef | ast.AsyncFunctionDef]]:
    """Test functions with their qualifier, of the module and of its classes, in the order of the source."""
    for node in tree.body:
        for qualifier, inner in [(f"{node.name}::", x) for x in node.body] if isinstance(node, ast.ClassDef) else [("", node)]:
            if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef)) and inner.name.startswith("test_"):
                yield qualifier, inner


def cases_of(path: str, text: str) -> Iterator[tuple]:
    """Rows of CASE: a case has its own tags and those of its module."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        raise UnparseableTestError(f"{path}: cannot parse: {e}") from e
    inherited = _tagged(ast.get_docstring(tree))
    for pos, (qualifier, node) in enumerate(_tests(tree)):
        doc = inspect.cleandoc(ast.get_docstring(node) or "")
        first = next((line.strip() for line in doc.splitlines() if line.strip()), "")
        yield f"{path}::{qualifier}{node.name}", node.name, pos, first, sorted(inherited | _tagged(doc)), sorted(inherited)


class _Collect:
    def eval(self, path: str, text: str) -> Iterator[tuple]:
        yield from cases_of(path, text or "")


def collected(files: DataFrame) -> DataFrame:
    """Test cases of the files (path, text) named test_*.py: path, boundary and CASE, by a table function over one file at a time.

    pos is the place in the file. A file that does not parse fails the query; one without cases has no rows. Nothing is imported or run.
    """
    own = files.where(F.element_at(F.split("path", "/"), -1).rlike(r"^test_.*\.py\z")).select("path", "text")
    rows = spread(own).lateralJoin(F.udtf(_Collect, returnType=CASE)(F.col("path").outer(), F.col("text").outer())).drop("text")
    return rows.withColumn("boundary", boundary(F.col("path")))


def case_lines(cases: DataFrame) -> DataFrame:
    """A line of the index per case: (boundary_order, path, pos, line), which sort the lines of a report."""
    tags = F.when(F.size("features") == 0, "—").otherwise(F.array_join(F.transform("features", lambda f: F.concat(F.lit("`"), f, F.lit("`"))), ", "))
    summary = F.when(F.col("summary") == "", "(no docstring)").otherwise(F.col("summary"))
    line = F.concat(F.lit("- `"), "nodeid", F.lit("` — "), summary, F.lit(" ["), tags, F.lit("]"))
    order = F.array_position(F.array(*[F.lit(b) for b in BOUNDARIES]), F.col("boundary"))
    return cases.select(F.when(order == 0, len(BOUNDARIES) + 1).otherwise(order).cast("int").alias("boundary_order"), "path", "pos", line.alias("line"))


def by_module(features: DataFrame, cases: DataFrame) -> DataFrame:
    """Modules (of features: feature_id, modules) with the cases that test one of their features, per boundary: (module, boundary, cases).

    Cases with the same features are counted before modules meet them, so that no case is repeated for each of its modules.
    """
    named = features.select("feature_id", F.explode("modules").alias("module")).distinct()
    own = cases.where("nodeid is not null").groupBy("nodeid", "boundary").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("features")))).alias("features"))
    alike = own.groupBy("boundary", "features").agg(F.count("*").alias("cases"))
    tested = alike.select("boundary", "features", "cases", F.explode("features").alias("feature_id"))
    return named.join(tested, "feature_id").groupBy("module", "boundary", "features").agg(F.first("cases").alias("cases")).groupBy("module", "boundary").agg(F.sum("cases").alias("cases"))
