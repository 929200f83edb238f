"""Facts of source files, switches, options and test cases, with exact values."""

import pytest
from pyspark.sql import functions as F

from docledger.operators import reports, scripts, trace
from docledger.sources import cases, extractors, logs


def facts(spark, registry, *files, **how):
    return extractors.extracted(spark.createDataFrame(list(files), "path string, text string"), registry, **how).collect()


def test_languages_by_suffix_and_a_new_one(spark):
    own = extractors.Registry().register("python", extractors.python_facts, ".py").register("rust", lambda text: [{"name": text, "kind": "function"}], ".rs")
    got = facts(spark, own, ("a.py", "def f(): pass"), ("b.rs", "main"), ("c.py", None))
    assert sorted((r["path"], r["name"]) for r in got) == [("a.py", "f"), ("b.rs", "main")]
    assert facts(spark, own, ("x.txt", "z"), language="rust")[0]["name"] == "z"


def test_unknown_languages_and_broken_sources_are_loud(spark):
    for path, text, what in (("a.zz", "", "no extractor"), ("a.py", "def (", "cannot parse"), ("a.json", "[]", "no object"), ("b.json", '{"a": 1}', "0 lists"), ("c.json", '{"a": [], "b": []}', "2 lists")):
        with pytest.raises(Exception, match=what):
            facts(spark, extractors.SYMBOLS, (path, text))
        assert what in facts(spark, extractors.SYMBOLS, (path, text), problems=True)[0]["problem"]


def test_json_rows_that_are_no_objects_are_left_out():
    rows = list(extractors.json_facts('{"rows": [1, {"name": "b", "x": null, "y": "[z"}, "s", {"name": "a", "n": 1.5, "t": true}], "s": "[1]"}'))
    assert [(r["name"], r["fields"]) for r in rows] == [("a", {"n": "1.5", "t": "True"}), ("b", {"x": "None", "y": "[z"})]
    assert [r["name"] for r in extractors.json_facts('{"a": [{"id": 3}, {}], "b": []}', "a", "id")] == ["3", "?"]


def test_python_switches():
    source = 'p.add_argument("-x", "--xx", help="-no")\nfor a in sys.argv[1:]:\n    if a in ("-h", "--help") or a[0] == "-q": pass\nif mode == "-z" or mode in ("-k", 3): pass\nif mode in ["-m"]: pass\n"--raw" in sys.argv\n'
    assert extractors.python_switches(source) == {"-x", "--xx", "-h", "--help", "-q", "-m", "--raw"}


def test_options_skip_positionals_and_the_last_counts():
    source = 'p.add_argument("f")\np.add_argument("-o", "--out", default="a", help="to\\n  where")\np.add_argument("--out", action="store", default=f(1))\np.add_argument("-v", default="' + "x" * 90 + '")\n'
    got = {r["name"]: r["fields"] for r in extractors.argparse_options(source)}
    assert got["--out"] == {"action": "store", "default": "f(1)", "help": ""} and len(got) == 2
    assert got["-v"]["default"] == "x" * 77 + "..."


def test_shell_functions_have_plain_names():
    got = [(r["name"], r["lineno"], r["end_lineno"], r["docstring"]) for r in extractors.shell_facts("#!/bin/sh\n# Does.\nf() {\n { x; }\n}\na-b() {\n}\nfunction g {\n")]
    assert got == [("f", 3, 5, "Does."), ("g", 8, 8, None)]
    assert extractors.shell_switches('getopts "ab:" o\ncase x in --no) ;;') == {"-a", "-b"}


TEST = '"""Doc.\n\nFeatures: FEAT-A-001\n"""\ndef test_a(): pass\nclass C:\n    def test_b(self):\n        """\n        First.\n\n        Feature: FEAT-B-002 and FEAT-C-003\n        See FEAT-D-004.\n        """\n    class D:\n        def test_no(self): pass\ndef no(): pass\n'


def test_collected_cases(spark):
    files = spark.createDataFrame([("unit/test_x.py", TEST), ("unit/x.py", TEST), ("a/test_y.py", "x = 1"), ("smoke/test_z.py", "async def test_c(): 'One.'")], "path string, text string")
    got = sorted(tuple(r) for r in cases.collected(files).select("nodeid", "boundary", "summary", "features").collect())
    assert got == [
        ("smoke/test_z.py::test_c", "smoke", "One.", []), ("unit/test_x.py::C::test_b", "unit", "First.", ["FEAT-A-001", "FEAT-B-002", "FEAT-C-003"]), ("unit/test_x.py::test_a", "unit", "", ["FEAT-A-001"]),
    ]
    with pytest.raises(Exception, match="cannot parse"):
        cases.collected(spark.createDataFrame([("test_q.py", "def (")], "path string, text string")).collect()


def test_tags(spark):
    text = "see FEAT-A-001\nfeatures: FEAT-EXTRACT-001, FEAT-CONFIGV2-002\r\nFeature:FEAT-B-12, FEAT-C-003"
    got = trace.tags(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [("d", 2, "FEAT-CONFIGV2-002"), ("d", 2, "FEAT-EXTRACT-001")]


def test_catalog_ids(spark):
    rows = [("FEAT-CONFIGV2-001", ["m"]), ("F-1", ["m"]), ("FEAT-X-0001", ["m"]), ("FEAT-1X-001", ["m"])]
    got = reports.catalog_problems(spark.createDataFrame(rows, "feature_id string, modules array<string>"), spark.createDataFrame([("m",)], "module string"))
    assert sorted(tuple(r) for r in got.collect()) == [("F-1", "bad_id"), ("FEAT-1X-001", "bad_id"), ("FEAT-X-0001", "bad_id")]


def test_inventory_of_stubs_and_capitals(spark):
    got = logs.symbol_inventory(spark.createDataFrame([("a.pyi", "x = 1"), ("B.PY", "def f(): pass"), ("c.txt", "y")], "path string, text string"))
    assert sorted((r["path"], r["symbols"]) for r in got.collect()) == [("B.PY", ["f"]), ("a.pyi", ["x"]), ("c.txt", [])]


@pytest.mark.parametrize("read", [lambda f: extractors.extracted(f, extractors.OPTIONS), lambda f: extractors.extracted(f, extractors.SWITCHES), cases.collected, scripts.shell_functions, logs.python_symbols])
def test_files_of_one_partition_are_read_by_many_tasks(spark, read):
    files = spark.range(64).select(F.format_string("test_%d.py", "id").alias("path"), F.lit("x = 1\nf() {\n").alias("text")).coalesce(1)
    if read is not scripts.shell_functions:
        files = files.withColumn("text", F.lit("x = 1\n"))
    assert read(files).rdd.getNumPartitions() >= 8


def test_cases_count_once_for_a_module_however_many_features_lead_there(spark):
    features = spark.createDataFrame([("F-1", ["m", "n"]), ("F-2", ["m"]), ("F-2", ["m", "o"])], "feature_id string, modules array<string>")
    rows = [("a", "unit", ["F-1", "F-2"]), ("a", "unit", ["F-2"]), ("b", "unit", ["F-2", "F-1", "F-2"]), ("c", "unit", ["F-3"]), ("c", "smoke", ["F-1"]), ("d", "unit", [])]
    out = cases.by_module(features, spark.createDataFrame(rows, "nodeid string, boundary string, features array<string>"))
    assert sorted(map(tuple, out.collect())) == [("m", "smoke", 1), ("m", "unit", 2), ("n", "smoke", 1), ("n", "unit", 2), ("o", "unit", 2)]
    assert "count(distinct" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
