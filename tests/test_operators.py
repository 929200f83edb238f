"""Exact values of small cases: boundaries, tie-breaks, nulls, cycles."""

import random

import pytest
from pyspark.sql import functions as F

from docledger.functions import text as X
from docledger.operators import coverage, documents, drift, governance, graph, layout, records, reports, store, trace
from docledger.sources import logs


def rows(df, *order):
    return sorted(tuple(r) for r in df.select(*order).collect()) if order else sorted(tuple(r) for r in df.collect())


def col(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def refs(spark, *values):
    return spark.createDataFrame([(d, p, s, n, l) for d, p, s, n, l in values], "doc_id string, path string, symbols array<string>, names array<string>, lines array<struct<s:int,e:int>>")


SYMBOLS = [("a", "foo", "function", 1, 2), ("a", "bar", "function", 3, 4), ("b", "Cls", "class", 1, 9), ("b", "Cls.m", "method", 2, 3), ("b", "bar", "function", 10, 11), ("b", "_p", "function", 12, 13), ("c", "orphan", "function", 1, 2)]


@pytest.fixture
def symbols(spark):
    return spark.createDataFrame(SYMBOLS, "path string, name string, kind string, lineno int, end_lineno int")


def test_coverage_baskets(spark, symbols):
    r = refs(spark, ("d1", "a", [], [], []), ("d2", "b", ["Cls"], [], []))
    files = symbols.select("path").distinct()
    assert rows(coverage.file_coverage(files, r, []), "path", "status") == [("a", "documented"), ("b", "documented"), ("c", "undocumented")]
    sym = coverage.symbol_coverage(symbols, r, [])
    s = coverage.summary(sym.where("public")).first()
    assert (s["documented"], s["universe"]) == (4, 6)
    assert rows(sym.where("status = 'undocumented'"), "path", "name") == [("b", "bar"), ("c", "orphan")]
    assert rows(sym.where("status = 'private'"), "name") == [("_p",)]
    assert rows(coverage.suggest_owners(sym), "path", "suggested_doc_id", "is_new_doc") == [("b", "d2", False), ("c", "c", True)]


def test_waivers_excuse_gaps_only_and_first_wins(spark, symbols):
    r = refs(spark, ("d1", "a", [], [], []))
    w = [("**/c", "orphan", "one"), ("c", None, "two"), ("a", None, "inert")]
    assert rows(coverage.file_coverage(symbols.select("path").distinct(), r, w), "path", "waived_reason")[2] == ("c", "two")
    assert rows(coverage.symbol_coverage(symbols, r, w).where("waived_reason is not null"), "name", "waived_reason") == [("orphan", "one")]


def test_selectors_are_a_union(spark, symbols):
    r = refs(spark, ("x", "b", ["bar"], [], [(2, 2)]), ("y", "b", [], ["bar"], []))
    assert rows(coverage.selected_symbols(symbols, r), "doc_id", "name") == [("x", "Cls"), ("x", "Cls.m"), ("x", "bar")]


def test_percent_of_nothing(spark):
    one = spark.range(1)
    got = one.select(coverage.percent(F.lit(0), F.lit(0), F.lit(0)), coverage.report_percent(F.lit(0), F.lit(2), F.lit(2)), coverage.report_percent(F.lit(1), F.lit(3), F.lit(0))).first()
    assert tuple(got) == (100.0, None, 33.33)


def test_deepest_directory_owns(spark):
    files = spark.createDataFrame([("a/b/x.py",), ("a/bc/y.py",), ("z.py",)], "path string")
    dirs = spark.createDataFrame([(0, "u0", "a"), (1, "u1", "a/b"), (2, "u2", "a/b")], "ord int, unit string, dir string")
    got = coverage.owning_unit(files, dirs)
    assert sorted(map(tuple, got.collect()), key=str) == [("a/b/x.py", "u1"), ("a/bc/y.py", "u0"), ("z.py", None)]


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/.venv/**", ".venv/x", True), ("*.py", "a/b.py", False), ("**/*.py", "a/b.py", True), ("a?c", "a/c", False), ("a.c", "abc", False), ("a*", "ab\n", True), ("ab", "ab\n", False)])
def test_globs(spark, glob, path, hit):
    assert col(spark, path, lambda c: c.rlike(X.glob_regex(glob))) is hit


@pytest.mark.parametrize(("line", "globs"), [("build", ["**/build", "**/build/**"]), ("/dist", ["dist", "dist/**"]), ("/dist/", ["dist/**"]), ("__pycache__/", ["**/__pycache__/**"]), ("*.log", ["**/*.log"]), ("docs/**/*.html", ["docs/**/*.html"]), ("!x", []), ("# x", []), ("/", []), ("  ", [])])
def test_ignore_globs(spark, line, globs):
    assert col(spark, line, X.ignore_globs) == globs


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "doc_id string, upstream_id string")


def origin(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id string")


def test_impact_of_a_chain(spark):
    e = edges(spark, ("a", "b"), ("b", "c"))
    assert rows(graph.dependents(e, origin(spark, "c"))) == [("a",), ("b",)]
    assert rows(graph.dependents(e, origin(spark, "c"), transitive=False)) == [("b",)]
    assert rows(graph.dependents(e, origin(spark, "a", "solo"))) == []


def test_impact_of_a_cycle(spark):
    e = edges(spark, ("a", "b"), ("b", "a"))
    assert rows(graph.dependents(e, origin(spark, "a"))) == [("b",)]


def test_edge_status_order_and_transitive(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("d", "x"), ("g", "b"), ("gone", "b"))
    hashes = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("g", "5")], "doc_id string, body_hash string")
    stamps = spark.createDataFrame([("a", "b", "2"), ("b", "c", "old")], "doc_id string, upstream_id string, stamp string")
    s = graph.edge_status(e, hashes, stamps, include_ok=True)
    assert rows(s, "doc_id", "status") == [("a", "ok"), ("b", "suspect"), ("d", "missing_upstream"), ("g", "unstamped")]
    assert rows(graph.transitive_suspects(e, s)) == [("a", "b"), ("gone", "b")]


def test_staleness(spark):
    d = spark.createDataFrame([("s", "2026-01-01", 90), ("f", "2026-06-20", 90), ("n", None, 90), ("edge", "2026-03-24", 90), ("future", "2027-01-01", 90)], "doc_id string, reviewed string, sla_days int")
    got = {r["doc_id"]: (r["status"], r["age_days"]) for r in governance.staleness(d, "2026-06-22", include_fresh=True).collect()}
    assert got == {"s": ("stale", 172), "f": ("fresh", 2), "n": ("never_reviewed", None), "edge": ("fresh", 90), "future": ("fresh", 0)}


def owners(spark, *values):
    return governance.effective_owners(spark.createDataFrame(values, "doc_id string, owner string, team string, dri string, inherited string"))


def people(spark, *values):
    return spark.createDataFrame(values, "ord int, name string, active boolean")


def test_ownership_and_routing(spark):
    o = owners(spark, ("vacant", "", "team", "gone", None), ("lost", "gone", None, None, None), ("none", "", "", None, None), ("fine", "x", None, None, None))
    found = governance.ownership(o, people(spark, (0, "team", True), (1, "x", True), (2, "x", False)))
    assert rows(found, "doc_id", "status") == [("lost", "orphan_owner_departed"), ("none", "unowned"), ("vacant", "orphan_dri_vacant")]
    stale = governance.staleness(spark.createDataFrame([("lost", None, 9), ("fine", None, 9)], "doc_id string, reviewed string, sla_days int"), "2026-01-01")
    items = governance.worklist_items(o, found, stale)
    assert sorted(((r["assignee"], r["doc_id"], r["reason"]) for r in items.collect()), key=str) == [("team", "vacant", "orphan"), ("x", "fine", "stale"), (None, "lost", "orphan"), (None, "lost", "stale"), (None, "none", "orphan")]
    queues = {r["assignee"]: (r["item_count"], r["doc_count"]) for r in governance.worklist_queues(items).collect()}
    assert queues == {"team": (1, 1), "x": (1, 1), None: (3, 2)}
    assert [(r["doc_id"], r["reason"]) for r in governance.ranked(items).where("assignee is null").orderBy("rank").collect()] == [("lost", "orphan"), ("lost", "stale"), ("none", "orphan")]


REC = "seq long, repo_id string, record_id string, doc_id string, audience string, drift_kind string, verdict string, surface_hash string, detected_at string"
RES = "seq long, record_id string, resolution string, resolved_at string"


def record(i, verdict="FIX", doc="d", repo="r"):
    return (i, repo, str(i), doc, "eng-guide", "HASH", verdict, "h", "2026-01-01 00:00:00")


def test_status_and_health(spark):
    r = spark.createDataFrame([record(1), record(2, "ESCALATE")], REC)
    res = spark.createDataFrame([(1, "1", "accepted", "2026-01-01 00:10:00"), (2, "2", "overridden", "2026-01-01 00:20:00"), (3, "2", "rejected", "2026-01-02 00:00:00")], RES)
    repos = spark.createDataFrame([("r",), ("empty",)], "repo_id string")
    s = {x["repo_id"]: x for x in records.repo_status(repos, r, res.where("record_id = '1'")).collect()}
    assert (s["r"]["fix"], s["r"]["escalate"], s["r"]["unresolved"], s["r"]["signal"]) == (1, 1, 1, "drift")
    assert (s["empty"]["total"], s["empty"]["signal"]) == (0, "sync")
    h = {x["repo_id"]: x for x in records.repo_health(repos, r, res).collect()}
    assert (h["r"]["escalation_rate"], h["r"]["resolved"], h["r"]["overrides"], h["r"]["mttr_seconds"], h["r"]["mttr"]) == (0.5, 2, 1, 900.0, "15m")
    assert (h["empty"]["escalation_rate"], h["empty"]["mttr_seconds"]) == (0.0, None)


def test_promotion_goes_by_the_last_resolution(spark):
    r = spark.createDataFrame([record(i, doc=d) for i, d in enumerate("aaabbbccd")], REC)
    last = [(10 + i, str(i), "invalidated", "t") for i in range(3)] + [(20 + i, str(3 + i), x, "t") for i, x in enumerate(("invalidated", "invalidated", "rejected"))]
    res = spark.createDataFrame([(0, "0", "rejected", "t"), *last, (30, "6", "accepted", "t"), (31, "7", "accepted", "t")], RES)
    assert rows(records.promotion_candidates(r, res), "doc_id", "cnt", "resolution") == [("a", 3, "invalidated")]
    rules = records.to_rules(records.promotion_candidates(r, res))
    assert rows(records.apply_rules(r, rules)) == [("0", "INVALIDATE"), ("1", "INVALIDATE"), ("2", "INVALIDATE")]


def test_similar_ranks_and_excludes_the_target(spark):
    r = spark.createDataFrame([record(1, doc="a"), record(2, doc="a"), record(3, doc="b"), record(4, doc="b"), record(5, doc="z")], REC)
    res = spark.createDataFrame([(i, str(i), "accepted", f"2026-01-0{i}") for i in range(1, 5)], RES)
    got = records.similar(r.where("record_id in ('1', '5')"), r, res, 2)
    assert rows(got) == [("1", "2", 11, 1), ("1", "4", 8, 2), ("5", "3", 8, 2), ("5", "4", 8, 1)]
    assert records.similar(r, r, res, 0).count() == 0


def test_page_rejects_bad_bounds(spark):
    with pytest.raises(ValueError, match="offset"):
        records.page(spark.createDataFrame([record(1)], REC), -1)


def test_severity(spark):
    one = spark.range(1)
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    cases = [(("signature",), ("n",), (), (), "additive"), ((), (), ("x",), (), "breaking"), (("signature",), ("n",), (), ("s",), "breaking"), (("signature",), (), (), (), "breaking"), (("body",), (), (), (), "cosmetic"), ((), (), (), (), "unknown")]
    for tiers, added, removed, changed, want in cases:
        assert one.select(X.severity(arr(*tiers), arr(*added), arr(*removed), arr(*changed))).first()[0] == want


def test_compare_fingerprints(spark):
    schema = "doc_id string, name string, signature string, docstring string, body_hash string, lineno int"
    old = spark.createDataFrame([("d", "f", "f()", None, "1", 1), ("d", "g", "g()", "doc", "2", 2), ("same", "f", "f()", None, "1", 1), ("gone", "f", "f()", None, "1", 1)], schema)
    new = spark.createDataFrame([("d", "f", "f(x)", None, "1", 1), ("d", "h", "h()", "doc", "2", 2), ("same", "f", "f()", None, "1", 1)], schema)
    got = {r["doc_id"]: r for r in drift.compare(drift.fingerprints(old), drift.fingerprints(new)).collect()}
    assert set(got) == {"d", "gone"}
    assert (got["d"]["added"], got["d"]["removed"], got["d"]["changed"], got["d"]["severity"]) == (["h"], ["g"], ["f"], "breaking")
    assert got["gone"]["kind"] == "MISSING_DOC"


def test_regions(spark):
    text = "<!-- BEGIN a -->\nx\ny\n<!-- END a -->\n<!-- END b -->\n<!-- BEGIN c -->\n<!-- END d -->\n<!-- BEGIN e -->"
    got = trace.regions(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    assert sorted(((r["region_id"], r["body"], r["problem"]) for r in got.collect()), key=str) == [("a", "x\ny", None), ("b", "", "unopened"), ("d", "", "mismatched"), ("e", "", "unterminated")]


def test_tags_need_a_marker(spark):
    got = trace.tags(spark.createDataFrame([("d", "see FEAT-A-001\nfeature: FEAT-A-002, FEAT-B-003; FEAT-C-004\nFEATURES: feat-a-005")], "doc_id string, text string"))
    assert rows(got, "line", "feature_id") == [(2, "FEAT-A-002"), (2, "FEAT-B-003")]


def test_scope_replace_leaves_the_sibling(spark, tmp_path):
    t = spark.createDataFrame([("r", "git", 1), ("r", "local", 2)], "repo_id string, sync_kind string, doc_id int")
    new = spark.createDataFrame([("r", "git", 3)], t.schema)
    assert rows(store.replace_scope(t, new, ("repo_id", "sync_kind"))) == [("r", "git", 3), ("r", "local", 2)]
    store.write_scope(t, str(tmp_path / "t"), ("repo_id", "sync_kind"))
    store.write_scope(new, str(tmp_path / "t"), ("repo_id", "sync_kind"))
    assert rows(spark.read.parquet(str(tmp_path / "t")), "sync_kind", "doc_id") == [("git", 3), ("local", 2)]


def test_upsert_keeps_seq_and_omitted_values(spark):
    t = spark.createDataFrame([(1, "a", "x", "tok")], "seq long, key string, name string, token string")
    new = spark.createDataFrame([(5, "a", "y", None), (6, "b", "z", "t2")], t.schema)
    assert rows(store.upsert(t, new, "key", ("token",))) == [(1, "a", "y", "tok"), (6, "b", "z", "t2")]


def test_changed_only(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, c string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("n", "4")], "k string, c string")
    assert rows(store.changed_only(new, old, "k", "c"), "k") == [("b",), ("n",)]


def test_log_reader(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": 3}\n')
    assert rows(logs.read_log(spark, str(tmp_path), "a int")) == [(1,), (2,)]
    assert rows(logs.unknown_keys(spark.read.text(str(tmp_path)).where("value <> ''"), ["a"])) == [("b",)]
    (tmp_path / "l.jsonl").write_text("{bad\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        logs.read_log(spark, str(tmp_path), "a int").collect()


def test_canonical_json():
    assert logs.canonical({"b": None, "a": ["é", 1]}) == '{"a":["\\u00e9",1],"b":null}'


def test_python_symbols():
    got = {r["name"]: r for r in logs.symbols_of('X = 1\ndef f(a, *, b):\n    """doc"""\n    return a\nclass C(B):\n    def m(self): pass\n')}
    assert {n: r["kind"] for n, r in got.items()} == {"X": "variable", "f": "function", "C": "class", "C.m": "method"}
    assert (got["f"]["docstring"], got["f"]["arg_names"], got["C.m"]["lineno"]) == ("doc", ["a"], 6)
    same = {r["name"]: r for r in logs.symbols_of("\n\ndef f(a, *, b):\n    return a\n")}
    assert same["f"]["body_hash"] == got["f"]["body_hash"]
    with pytest.raises(SyntaxError):
        logs.symbols_of("def")


def test_variable_signatures():
    long = "a_name_of_many_words_that_goes_on_beyond_forty_eight_characters"
    source = f"{long}: dict[str, int] = 1\nX: int\nY = Z = '{'v' * 46}'\nW = '{'v' * 47}'\n"
    assert [r["signature"] for r in logs.symbols_of(source)] == [f"{long}: dict[str, int] = 1", "X: int", f"Y = '{'v' * 46}'", f"Z = '{'v' * 46}'", "W = ..."]


@pytest.mark.parametrize(("name", "public"), [("f", True), ("_f", False), ("__init__", True), ("C._m", False), ("_C.m", True)])
def test_visibility(spark, name, public):
    assert col(spark, name, X.is_public) is public


@pytest.mark.parametrize(("link", "want"), [("b.md", "docs/x/b.md"), ("./b.md", "docs/x/b.md"), ("../b.md", "docs/b.md"), ("../../../b.md", "../b.md"), ("a/../b.md", "docs/x/b.md")])
def test_normalized_path(spark, link, want):
    assert col(spark, link, lambda c: graph.normalized_path(F.lit("docs/x/a.md"), c)) == want


def test_worklist_severities_and_order(spark):
    """One document with every reason: a suspect and what was never reviewed come before medium work, orphans before stale ones."""
    want = {"orphan_owner_departed": "high", "orphan_dri_vacant": "medium", "unowned": "medium", "never_reviewed": "high", "stale": "medium", "suspect": "high", "missing_upstream": "high", "unstamped": "low", "suspect_transitive": "low"}
    owners = spark.createDataFrame([(i, "alice", "alice") for i in range(9)], "doc_id long, accountable string, durable string")
    reason = lambda s: [(i, x) for i, x in enumerate(want) if x in s]
    orphans = spark.createDataFrame([(i, s, "alice") for i, s in reason(("orphan_dri_vacant", "unowned", "orphan_owner_departed"))], "doc_id long, status string, durable string")
    stale = spark.createDataFrame(reason(("never_reviewed", "stale")), "doc_id long, status string")
    suspects = spark.createDataFrame([(i, s, 7) for i, s in reason(("suspect", "missing_upstream", "unstamped", "suspect_transitive"))], "doc_id long, status string, upstream_id long")
    items = governance.worklist_items(owners, orphans, stale, suspects)
    assert {r["status"]: r["severity"] for r in items.collect()} == want
    one = governance.worklist_items(owners.where("doc_id = 5").withColumn("doc_id", F.lit(1)), orphans.where("doc_id = 1"), stale.where("doc_id = 4").withColumn("doc_id", F.lit(1)), suspects.where("doc_id = 5").withColumn("doc_id", F.lit(1)))
    got = sorted(governance.ranked(one).collect(), key=lambda r: r["rank"])
    assert [(r["rank"], r["severity"], r["reason"]) for r in got] == [(1, "high", "suspect"), (2, "medium", "orphan"), (3, "medium", "stale")]


def test_lint_of_a_conformant_document(spark):
    text = "---\ncdm:\n  schema_version: 1.0.0\n  audience: eng-guide\n  fingerprint: ab\n---\n# T\n\n> why\n\n<!-- BEGIN a -->\nx\n<!-- END a -->\n"
    schema = "doc_id long, audience string, text string, region_keys array<string>, html boolean, html_text string"
    assert layout.lint(spark.createDataFrame([(1, "eng-guide", text, ["a"], False, None), (2, "eng-guide", None, [], True, None)], schema)).count() == 0
    bare = {(r["code"], r["subject"]) for r in layout.lint(spark.createDataFrame([(1, "eng-guide", "", ["a"], False, None)], schema)).collect()}
    assert bare == {("MISSING_FRONT_MATTER", None), ("MISSING_TITLE", None), ("MISSING_REGION", "a")}


@pytest.mark.parametrize(("target", "folder", "want"), [("a/b.md", "", "a/b.md"), ("a/b.md", "a", "b.md"), ("b.md", "a/c", "../../b.md"), ("a/x/b.md", "a/c", "../x/b.md")])
def test_relative_path(spark, target, folder, want):
    assert col(spark, target, lambda c: layout.relative_path(c, F.lit(folder))) == want


def test_impact_of_unknown_and_deep_origins(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(12)] + [(3, 9)], "doc_id long, upstream_id long")
    of = lambda i, **k: {r["doc_id"] for r in graph.dependents(edges, spark.createDataFrame([(i,)], "doc_id long"), **k).collect()}
    assert of(77) == set() and of(0) == set(range(1, 13)) and of(9) == {10, 11, 12, 3, 4, 5, 6, 7, 8} and of(9, transitive=False) == {3, 10}


def test_of_definitions_on_one_line_the_same_counts_in_every_order(spark):
    rows = [(1, "f", f"def f({x})", "doc", "body", 1) for x in "abcdefgh"]
    prints = [drift.fingerprints(spark.createDataFrame(r, "doc_id long, name string, signature string, docstring string, body_hash string, lineno int").coalesce(1)) for r in (rows, rows[::-1])]
    assert drift.compare(*prints).count() == 0


def test_similar_records_are_listed_once_for_equal_features(spark):
    pick = random.Random(3)
    one = lambda i: (str(i), pick.choice(["s1", "s2", "s3", None]), f"d{pick.randrange(4)}", pick.choice("kl"), pick.choice(["a", None]))
    rows, at = [one(i) for i in range(60)], {str(i): f"2024-01-01 00:00:{pick.randrange(6):02d}" for i in range(0, 60, 2)}
    own = spark.createDataFrame(rows, "record_id string, surface_hash string, doc_id string, drift_kind string, audience string")
    done = spark.createDataFrame(list(at.items()), "record_id string, at string").select("record_id", F.col("at").cast("timestamp").alias("resolved_at"), F.lit(1).alias("seq"))
    out = records.similar(own, own, done)
    score = lambda a, b: sum(w for x, y, w in zip(a[1:], b[1:], (5, 3, 2, 1), strict=True) if x is not None and x == y)
    want = {}
    for t in rows:
        pool = [(score(t, r), at[r[0]], r[0]) for r in rows if r[0] in at and r[0] != t[0]]
        pool.sort(key=lambda x: x[2])
        pool.sort(key=lambda x: (x[0], x[1]), reverse=True)
        want |= {(t[0], n): (r, s) for n, (s, _, r) in enumerate(pool[:3], 1)}
    assert {(r["target_id"], r["rank"]): (r["record_id"], r["score"]) for r in out.collect()} == want
    assert "windowspecdefinition(target_id" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_surfaces_stay_with_their_lines_in_many_tasks(spark):
    from docledger.plans import reporting

    out = reporting.surface_fingerprints(spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() >= 8
