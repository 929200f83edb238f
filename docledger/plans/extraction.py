"""Registered queries over source files: facts by language, switches, options, JSON records, test cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.operators import replies
from docledger.plans.registry import query
from docledger.sources import adapters as A
from docledger.sources import cases, extractors


def _parts(spark: SparkSession, d: str, path: Column, text: Column) -> DataFrame:
    return A.raw(spark, d, "part").select(path.alias("path"), text.alias("text"))


def _filled(template: str, **columns: Column) -> Column:
    """A text with {names} replaced by columns."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), c.cast("string"))
    return out


_PYTHON = "class P{n}:\n    def price(self, qty: int = 3):\n        'Price.'\n        return qty * {size}\nSIZE = {size}\n"
_SHELL = "#!/bin/sh\n# Size {size}.\n#  of {n}\nsize_{n}() {\n  if [ $1 ]; then { echo {n}; }; fi\n}\nfunction open { :; }\nbad-{n}() {\n}\n"
_JSON = '{"title": "[no list]", "rows": [{"name": "{name}", "b": "[x", "a": {size}, "z": null, "t": true}, 7, "x", {"c": [1, {"k": "v"}]}, null]}'


@query(r"""WITH p AS (SELECT p_partkey AS n, p_size AS k, p_name, p_partkey % 4 AS m FROM part)
  SELECT 'f' || n || '.py' AS path, 'P' || n AS name, 'class' AS kind, 'class P' || n AS signature, 1 AS lineno, 4 AS end_lineno, NULL AS docstring, NULL AS fields, NULL AS problem FROM p WHERE m = 0
  UNION ALL SELECT 'f' || n || '.py', 'P' || n || '.price', 'method', 'def price(self, qty: int = 3)', 2, 4, 'Price.', NULL, NULL FROM p WHERE m = 0
  UNION ALL SELECT 'f' || n || '.py', 'SIZE', 'variable', 'SIZE = ' || k, 5, 5, NULL, NULL, NULL FROM p WHERE m = 0
  UNION ALL SELECT 'f' || n || '.sh', 'size_' || n, 'function', 'size_' || n || '()', 4, 6, 'Size ' || k || '.' || chr(10) || ' of ' || n, NULL, NULL FROM p WHERE m = 1
  UNION ALL SELECT 'f' || n || '.sh', 'open', 'function', 'open()', 7, 7, NULL, NULL, NULL FROM p WHERE m = 1
  UNION ALL SELECT 'f' || n || '.json', p_name, 'record', NULL, NULL, NULL, NULL, 'a=' || k || ',b=[x,t=True,z=None', NULL FROM p WHERE m = 2
  UNION ALL SELECT 'f' || n || '.json', '?', 'record', NULL, NULL, NULL, NULL, 'c=[1, {''k'': ''v''}]', NULL FROM p WHERE m = 2
  UNION ALL SELECT 'f' || n || '.rs', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no extractor for language ''auto'' of f' || n || '.rs' FROM p WHERE m = 3""")
def extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of Python, shell and JSON files, and of files whose language nobody has registered."""
    n, k = F.col("p_partkey"), F.col("p_partkey") % 4
    suffix = F.when(k == 0, ".py").when(k == 1, ".sh").when(k == 2, ".json").otherwise(".rs")
    text = F.when(k == 0, _filled(_PYTHON, n=n, size=F.col("p_size"))).when(k == 1, _filled(_SHELL, n=n, size=F.col("p_size"))).when(k == 2, _filled(_JSON, name=F.col("p_name"), size=F.col("p_size"))).otherwise("fn main() {}")
    out = extractors.extracted(_parts(spark, d, F.concat(F.lit("f"), n, suffix), text), extractors.SYMBOLS, problems=True)
    pairs = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.withColumn("fields", F.array_join(pairs, ","))


@query(r"""WITH p AS (SELECT p_partkey AS n, p_size AS k, p_name FROM part)
  SELECT 'f' || n || '.json' AS path, NULL AS problem, p_name AS name, 'a=' || k || ',b=[x,t=True,z=None' AS fields FROM p WHERE n % 3 > 0 UNION ALL SELECT 'f' || n || '.json', NULL, '?', 'c=[1, {''k'': ''v''}]' FROM p WHERE n % 3 > 0
  UNION ALL SELECT 'f' || n || '.json', 'no object at top level', NULL, NULL FROM p WHERE n % 3 = 0""")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the list in each JSON file, and files that hold no object."""
    n = F.col("p_partkey")
    text = F.when(n % 3 == 0, "[1]").otherwise(_filled(_JSON, name=F.col("p_name"), size=F.col("p_size")))
    out = extractors.extracted(_parts(spark, d, F.concat(F.lit("f"), n, F.lit(".json")), text), extractors.SYMBOLS, problems=True)
    pairs = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select("path", "problem", "name", F.array_join(pairs, ",").alias("fields"))


_OPTIONS = """import argparse, sys
p = argparse.ArgumentParser()
p.add_argument("-s{n}", "--size-{n}", action="store_true", help="how   large,\\n at most {size}")
p.add_argument("path", help="no option")
p.add_argument("-q", default={size} * 2)
p.add_argument("--size-{n}", default="{size}")
for arg in sys.argv[1:]:
    if arg == "-v" or arg in ("-h", "--help"):
        pass
if "--raw" in sys.argv or mode in ("-x", "-y") or mode == "-z" or mode in ("-k", 3):
    pass
"""


@query("""WITH p AS (SELECT p_partkey AS n, p_size AS k FROM part)
  SELECT 'f' || n || '.py' AS path, '--size-' || n AS name, '' AS action, k::VARCHAR AS "default", '' AS help FROM p UNION ALL SELECT 'f' || n || '.py', '-q', '', k || ' * 2', '' FROM p""")
def argparse_options(spark: SparkSession, d: str) -> DataFrame:
    """Options of command lines; of two definitions of a name the last counts."""
    n = F.col("p_partkey")
    files = _parts(spark, d, F.concat(F.lit("f"), n, F.lit(".py")), _filled(_OPTIONS, n=n, size=F.col("p_size")))
    return extractors.extracted(files, extractors.OPTIONS).select("path", "name", *[F.col("fields")[c].alias(c) for c in ("action", "default", "help")])


_TCL = "proc main {} {\n  foreach arg $argv {\n    switch -regexp -- $arg {\n      ^-size{n} { }\n      ^--quiet { }\n    }\n  }\n}\nif {[regexp {^\\-[ab]} $x]} { }\n"
_SHELL_TOOL = 'while getopts ":ab:" o; do :; done\ncase $x in --long) ;; esac\n'


@query("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'f' || p_partkey || '.py' WHEN 1 THEN 'f' || p_partkey || '.tcl' ELSE 'f' || p_partkey END AS path, unnest(CASE p_partkey % 3
    WHEN 0 THEN ['-s' || p_partkey, '--size-' || p_partkey, '-q', '-v', '-h', '--help', '--raw', '-x', '-y'] WHEN 1 THEN ['-size' || p_partkey, '-a', '-b'] ELSE ['-a', '-b'] END) AS switch FROM part""")
def tool_switches(spark: SparkSession, d: str) -> DataFrame:
    """Switches of Python, Tcl and shell tools; a file without a known suffix counts as shell."""
    n, k = F.col("p_partkey"), F.col("p_partkey") % 3
    text = F.when(k == 0, _filled(_OPTIONS, n=n, size=F.col("p_size"))).when(k == 1, _filled(_TCL, n=n)).otherwise(_SHELL_TOOL)
    path = F.concat(F.lit("f"), n, F.when(k == 0, ".py").when(k == 1, ".tcl").otherwise(""))
    return extractors.extracted(_parts(spark, d, path, text), extractors.SWITCHES).select("path", F.col("name").alias("switch"))


_TESTS = '"""Tests of {n}.\n\nFeatures: FEAT-MOD-{id}\n"""\nimport os\n\ndef test_plain():\n    pass\n\ndef helper():\n    pass\n\nclass TestSize:\n    async def test_inner(self):\n        """\n        Size {size}.\n\n        feature: FEAT-SIZE-001, FEAT-MOD-{id}. As in FEAT-PROSE-001.\n        """\n    def other(self):\n        pass\n'


def _cases(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("p_partkey"), F.col("p_partkey") % 5
    folder = F.when(k == 0, "unit/").when(k == 1, "a/system/unit/").when(k == 2, "regression/").otherwise("x/")
    path = F.concat(folder, F.when(k == 4, "case_").otherwise("test_"), n, F.lit(".py"))
    return cases.collected(_parts(spark, d, path, _filled(_TESTS, n=n, size=F.col("p_size"), id=F.format_string("%03d", n % 20))))


_CASES = """p AS (SELECT p_partkey AS n, p_size AS k, CASE p_partkey % 5 WHEN 0 THEN 'unit/' WHEN 1 THEN 'a/system/unit/' WHEN 2 THEN 'regression/' ELSE 'x/' END || 'test_' || p_partkey || '.py' AS path,
    CASE p_partkey % 5 WHEN 0 THEN 'unit' WHEN 1 THEN 'system' WHEN 2 THEN 'regression' ELSE 'unknown' END AS boundary, printf('FEAT-MOD-%03d', p_partkey % 20) AS f FROM part WHERE p_partkey % 5 < 4),
  c AS (SELECT n, path, boundary, path || '::test_plain' AS nodeid, 'test_plain' AS name, 0 AS pos, '' AS summary, [f] AS features FROM p
    UNION ALL SELECT n, path, boundary, path || '::TestSize::test_inner', 'test_inner', 1, 'Size ' || k || '.', [f, 'FEAT-SIZE-001'] FROM p)"""


@query(f"WITH {_CASES} SELECT path, boundary, nodeid, name, pos, summary, array_to_string(features, ',') AS features FROM c")
def collected_tests(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("path", "boundary", "nodeid", "name", "pos", "summary", F.array_join("features", ",").alias("features"))


@query(f"""WITH {_CASES} SELECT CASE boundary WHEN 'unit' THEN 1 WHEN 'system' THEN 3 WHEN 'regression' THEN 5 ELSE 6 END AS boundary_order, path, pos,
  '- `' || nodeid || '` — ' || CASE WHEN summary = '' THEN '(no docstring)' ELSE summary END || ' [`' || array_to_string(features, '`, `') || '`]' AS line FROM c""")
def test_index_lines(spark: SparkSession, d: str) -> DataFrame:
    return cases.case_lines(_cases(spark, d))


@query(f"""WITH {_CASES}, f AS (SELECT DISTINCT printf('FEAT-MOD-%03d', p_partkey % 20) AS feature_id, p_brand AS module FROM part), t AS (SELECT nodeid, boundary, unnest(features) AS feature_id FROM c)
  SELECT module, boundary, count(DISTINCT nodeid) AS cases FROM f JOIN t USING (feature_id) GROUP BY 1, 2""")
def tests_by_module(spark: SparkSession, d: str) -> DataFrame:
    features = A.raw(spark, d, "part").groupBy(F.format_string("FEAT-MOD-%03d", F.col("p_partkey") % 20).alias("feature_id")).agg(F.collect_set("p_brand").alias("modules"))
    return cases.by_module(features, _cases(spark, d))


_REPLIES = (
    '{"verdict": "FIX", "cause": "c {n}", "fix": {"rationale": "r", "new_doc_text": "a\\"}b", "region_id": null}}', '{"verdict": "INVALIDATE", "cause": "docs", "fix": null, "more": [1]}', "no object {n}", '{"verdict": "FIX"',
    '{"verdict": "FIX", }', '{"verdict": "FIX", "cause": "c", "fix": "[text]"}', '{"verdict": "FIX", "cause": "c", "fix": {"region_id": "r"}}', '{"verdict": "FIX", "cause": "c", "fix": {"rationale": "r", "what": 1}}',
    '{"verdict": "FIX", "cause": "c", "fix": {"rationale": "r", "region_id": ["r"]}}', '{"cause": "c"}', '{"verdict": "MAYBE", "cause": "c"}', '{"verdict": "ESCALATE", "cause": 3}', '\\{"verdict": "ESCALATE", "cause": "[no list]"} {',
)


@query("""WITH d AS (SELECT doc_id AS reply_id, doc_id % 13 AS k FROM documents)
  SELECT reply_id, CASE k WHEN 2 THEN 'no_object' WHEN 3 THEN 'unbalanced' WHEN 4 THEN 'invalid_json' WHEN 5 THEN 'fix_no_object' WHEN 9 THEN 'missing_key' WHEN 10 THEN 'invalid' WHEN 11 THEN 'invalid' ELSE CASE WHEN k IN (6, 7, 8) THEN 'fix_malformed' END END AS problem,
    CASE k WHEN 0 THEN 'FIX' WHEN 1 THEN 'INVALIDATE' WHEN 12 THEN 'ESCALATE' END AS verdict, CASE k WHEN 0 THEN 'c ' || reply_id WHEN 1 THEN 'docs' WHEN 12 THEN '[no list]' END AS cause, CASE WHEN k IN (0, 1, 12) THEN k = 0 END AS has_fix,
    NULL::VARCHAR AS region_id, NULL::VARCHAR AS new_region_body, CASE WHEN k = 0 THEN 'a"}b' END AS new_doc_text, CASE WHEN k = 0 THEN 'r' END AS rationale FROM d""")
def typed_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies of whole texts around objects that are sound, broken or of a wrong kind in every way."""
    n = F.col("doc_id")
    found = F.get(F.array(*[_filled(r, n=n) for r in _REPLIES]), (n % len(_REPLIES)).cast("int"))
    prose = F.coalesce(F.regexp_replace("text", r'[{}"\\]', ""), F.lit(""))
    return replies.results(A.bodies(spark, d).select(n.alias("reply_id"), F.concat(prose, F.lit("\n```json\n"), found, F.lit("\n```")).alias("reply")))
