"""Readers: JSON-line logs with strict schemas, source files, Python symbols."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.functions.text import language

SYMBOL = "name string, kind string, signature string, lineno int, end_lineno int, docstring string, arg_names array<string>, body_hash string"
#: Most characters of a variable's value in its signature.
MOST_VALUE = 48
#: Tasks for each core, at least, over which source files are dealt.
TASKS_PER_CORE = 4


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A log of JSON lines. Blank lines are skipped; a corrupt one fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    text = schema if isinstance(schema, str) else schema.simpleString()
    return lines.select(F.from_json("value", text, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def unknown_keys(lines: DataFrame, allowed: list[str]) -> DataFrame:
    """Keys of JSON lines (value) that the schema does not have: an error for the caller, never a silent drop."""
    keys = lines.select(F.explode(F.json_object_keys("value")).alias("key"))
    return keys.where(~F.col("key").isin(allowed)).distinct()


def read_sources(spark: SparkSession, root: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Files below root by relative path (path, text) that include globs match and exclude globs do not."""
    from docledger.operators.coverage import effective_scope

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    path = F.expr(f"substring(path, locate('{base}', path) + {len(base)})")
    return effective_scope(rows.select(path.alias("path"), F.decode("content", "UTF-8").alias("text")), include, exclude)


def spread(rows: DataFrame, key: str = "path") -> DataFrame:
    """Rows dealt by a key over the cluster: reading a source takes far longer than its bytes let on, and a small table is one task."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, key)


def _parameters(a: ast.arguments) -> str:
    """Parameters as they are written, with spaces around the default of an annotated one."""

    def show(x: ast.arg, default: ast.expr | None = None, star: str = "") -> str:
        note = f": {ast.unparse(x.annotation)}" if x.annotation else ""
        return f"{star}{x.arg}{note}" + ("" if default is None else f"{' = ' if note else '='}{ast.unparse(default)}")

    plain = [*a.posonlyargs, *a.args]
    out = [show(x, d) for x, d in zip(plain, [None] * (len(plain) - len(a.defaults)) + a.defaults, strict=True)]
    if a.posonlyargs:
        out.insert(len(a.posonlyargs), "/")
    if a.vararg or a.kwonlyargs:
        out.append(show(a.vararg, star="*") if a.vararg else "*")
    out += [show(x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    return ", ".join([*out, show(a.kwarg, star="**")] if a.kwarg else out)


def _symbol(node: ast.stmt, name: str, kind: str, signature: str, **more) -> dict:
    own = {"docstring": None, "arg_names": [], "body_hash": None} | more
    return {"name": name, "kind": kind, "signature": signature, "lineno": node.lineno, "end_lineno": node.end_lineno, **own}


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str = "") -> dict:
    """A function or method; its body's hash leaves out the docstring, comments and layout."""
    doc = ast.get_docstring(node, clean=False)
    body = "\0".join(ast.dump(s) for s in node.body[doc is not None :])
    how = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    signature = f"{how} {node.name}({_parameters(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
    names = [x.arg for x in (*node.args.posonlyargs, *node.args.args)]
    digest = hashlib.sha256(body.encode()).hexdigest()[:16]
    return _symbol(node, f"{owner}{node.name}", "method" if owner else "function", signature, docstring=ast.get_docstring(node), arg_names=names, body_hash=digest)


def _assigned(node: ast.Assign | ast.AnnAssign, name: str) -> str:
    """Name, annotation and value of a variable; a value that is long or has several lines is elided."""
    head = f"{name}: {ast.unparse(node.annotation)}" if isinstance(node, ast.AnnAssign) else name
    if node.value is None:
        return head
    value = ast.unparse(node.value)
    return f"{head} = {'...' if len(value) > MOST_VALUE or chr(10) in value else value}"


def _of(node: ast.stmt) -> Iterator[dict]:
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    if isinstance(node, functions):
        yield _function(node)
    elif isinstance(node, ast.ClassDef):
        bases = [*map(ast.unparse, node.bases), *(f"{k.arg}={ast.unparse(k.value)}" for k in node.keywords if k.arg)]
        yield _symbol(node, node.name, "class", f"class {node.name}" + (f"({', '.join(bases)})" if bases else ""), docstring=ast.get_docstring(node))
        yield from (_function(m, f"{node.name}.") for m in node.body if isinstance(m, functions))
    elif isinstance(node, (ast.Assign, ast.AnnAssign)):
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        yield from (_symbol(node, t.id, "variable", _assigned(node, t.id)) for t in targets if isinstance(t, ast.Name))


def symbols_of(source: str) -> list[dict]:
    """Functions, classes with their methods, and module variables of a Python source; only functions and methods have a body hash."""
    return [row for node in ast.parse(source).body for row in _of(node)]


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python files (path, text); a file that does not parse fails the query."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [{"path": p, **s} for p, t in zip(pdf["path"], pdf["text"], strict=True) for s in symbols_of(t or "")]
            yield pd.DataFrame(rows, columns=["path", *[c.split()[0] for c in SYMBOL.split(", ")]])

    return spread(files.select("path", "text")).mapInPandas(run, f"path string, {SYMBOL}")


def symbol_inventory(files: DataFrame) -> DataFrame:
    """Files (path, text) with the names of their Python symbols in order of line; none for files without any and of other kinds."""
    names = python_symbols(files.where(language(F.col("path")) == "python")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("lineno", "name"))).alias("s"))
    found = F.transform("s", lambda x: x["name"])
    return files.select("path").join(names, "path", "left").select("path", F.coalesce(found, F.array().cast("array<string>")).alias("symbols"))


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, nulls kept and ASCII escapes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


@F.pandas_udf(T.StringType())
def canonical_hash(rows: pd.Series) -> pd.Series:
    """First 16 hexadecimal digits of the SHA-256 of canonical JSON."""
    return rows.map(lambda x: None if x is None else hashlib.sha256(canonical(json.loads(x)).encode()).hexdigest()[:16])
