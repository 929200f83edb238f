"""Headers, lint, replies, patches, fingerprints, reports and monitor runs, with exact values."""

import difflib
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from docledger.functions.canonical import json_text
from docledger.operators import layout, monitor, patches, replies, rpt, surface
from docledger.sources.headers import HeaderError, parsed

HEADERS = [
    ("", None), ("{}", {}), ("a: 1\nb:\n  c: 'x: y'\n  d: [1, a, \"q\"] # t\nz: yes", {"a": "1", "b": {"c": "x: y", "d": ["1", "a", "q"]}, "z": "True"}), ("cdm: {v: 1.0.0, l: {m: ~}}", {"cdm": {"v": "1.0.0", "l": {"m": None}}}),
    ("a:\n- 1\n- b: 2\n  c: 3\nd: http://x/y", {"a": ["1", {"b": "2", "c": "3"}], "d": "http://x/y"}), ("- a", ["a"]), ("text", "text"), ("a: 1\na: 2", {"a": "2"}),
]


@pytest.mark.parametrize(("text", "want"), HEADERS)
def test_headers(text, want):
    assert parsed(text) == want


@pytest.mark.parametrize("text", ["a: b: c", "a:\n    b: 1\n  c: 2", "a: [1, 2", "a: &x 1", "a: |\n  b", "a: 'x", "a: 1\n b: 2", "a:\n\tb: 1", "x\ny: 1"])
def test_headers_that_are_not_read(text):
    with pytest.raises(HeaderError):
        parsed(text)


LINT = "doc_id long, audience string, text string, region_keys array<string>, html boolean, html_text string"


def codes(spark, text, keys=(), html=False, page=None):
    return sorted((r["code"], r["subject"]) for r in layout.lint(spark.createDataFrame([(1, "eng-guide", text, list(keys), html, page)], LINT)).collect())


GOOD = "cdm:\n  schema_version: 1.0.0\n  audience: eng-guide\n  fingerprint: ab\n"


def test_lint(spark):
    body = "# T\n\n> why\n"
    for head in (GOOD, GOOD.replace("1.0.0", '"1.0.0"  # now'), "cdm: {schema_version: 1.0.0, audience: eng-guide, fingerprint: x}\n"):
        assert codes(spark, f"---\n{head}---\n{body}") == []
    assert codes(spark, f"---\n{GOOD}---\n{body}".replace("\n", "\r\n")) == []
    assert codes(spark, f"---\n{{}}\n---\n{body}") == [("MISSING_FRONT_MATTER", None)]
    assert codes(spark, f"---\n- a\n---\n{body}") == [("MALFORMED_STRUCTURE", None)] == codes(spark, f"---\na: [1\n---\n{body}")
    assert codes(spark, f"---\n{GOOD}") == [("MISSING_FRONT_MATTER", None), ("MISSING_TITLE", None)]
    assert codes(spark, f"---\n{GOOD}---\n{body}  <!-- BEGIN a -->\n<!-- X:BEGIN b -->\n<!-- X:END b -->\n", ["b"]) == []
    assert codes(spark, f"---\n{GOOD}---\n{body}", html=True, page='<meta name="other-docs-md-sha256" content="0f">') == [("HTML_STALE", None)]


def test_replies(spark):
    rows = [
        ('x {"verdict": "FIX", "cause": "c", "fix": {"rationale": "r", "new_doc_text": null}}', None, "FIX"), ('{"verdict": "FIX", "cause": "c", "fix": "{}"}', "fix_no_object", None), ('{"verdict": ["FIX"], "cause": "c"}', "invalid", None),
        ('\\{"verdict": "ESCALATE", "cause": "}"}', None, "ESCALATE"), (None, "no_object", None), ('{"a": "}"', "unbalanced", None), ('{"verdict": "FIX", "cause": "c", "fix": {"rationale": 1}}', "fix_malformed", None),
    ]
    got = replies.results(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "reply_id int, reply string")).orderBy("reply_id").collect()
    assert [(r["problem"], r["verdict"]) for r in got] == [r[1:] for r in rows]


def test_patches_are_shortest_and_apply():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") + "\n" for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found, out, at = patches.changes(a, b), [], 0
        for s, e, t, f in found:
            out, at = out + a[at:s] + b[t:f], e
        assert out + a[at:] == b and len(a) - sum(e - s for s, e, _, _ in found) == table[-1][-1]
    lines = [f"{i}\n" for i in range(30)]
    new = [*lines[:4], "x\n", *lines[4:12], *lines[13:25], "y\n", *lines[26:]]
    assert patches.patch_of("d", "".join(lines), "".join(new))[0] == "".join(difflib.unified_diff(lines, new, "a/d", "b/d"))
    assert patches.patch_of("d", "a", "a\n")[0].endswith("-a\n\\ No newline at end of file\n+a\n")


def test_canonical_texts(spark):
    texts = [None, "", "plain", 'q"\\', "a\tb\nc\rd\be\ff\x00\x1f\x7f", "é€😀", "</a> "]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(json_text(F.col("t"))).collect()]
    assert got == [json.dumps(t) for t in texts]


def test_surfaces(spark):
    schema = "doc_id string, ord int, name string, kind string, signature string, docstring string, body_hash string"
    rows = [("d", 1, "f", "function", 'f(a="é")', "x", None), ("d", 2, "_g", "function", "g", None, "ab")]
    records = spark.createDataFrame([("d", "switch", "-b", []), ("d", "record", "r", [("k", "v")])], "doc_id string, kind string, name string, fields array<struct<key:string,value:string>>")
    audiences = spark.createDataFrame([("d", "eng-guide"), ("n", "user-guide")], "doc_id string, audience string")
    got = {r["doc_id"]: r for r in surface.surface_fingerprints(spark.createDataFrame(rows, schema), audiences, records, include_body=True).collect()}
    digest = lambda p: hashlib.sha256(json.dumps(p, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    base = [{"name": r[2], "kind": r[3], "signature": r[4], "is_public": not r[2].startswith("_")} for r in sorted(rows, key=lambda r: r[2])]
    full = [base[0] | {"docstring": None, "body_hash": "ab"}, base[1] | {"docstring": "x"}]
    more = [{"name": "r", "kind": "record", "fields": [["k", "v"]]}, {"name": "-b", "kind": "switch", "fields": []}]
    assert got["d"]["composite"] == digest({"audience": "eng-guide", "symbols": full, "records": more})
    assert got["d"]["signature"] == digest({"audience": "eng-guide", "symbols": base, "records": more})
    assert got["d"]["body"] == digest({"bodies": [{"name": "_g", "body_hash": "ab"}]}) and got["d"]["sigs"][hashlib.sha256(b"f").hexdigest()[:16]] == digest(base[1])
    assert (got["n"]["composite"], got["n"]["docstring"], got["n"]["sigs"]) == (digest({"audience": "user-guide", "symbols": []}), None, {})


def test_reports_that_cannot_be_read(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "---\nreport-version: 1.0.0\n"), ("c", "---\nreport-version: 2\n---\n"), ("d", None)], "file string, text string")
    assert sorted((r["file"], r["fields"]["problem"]) for r in rpt.parse(files).collect()) == [("a", "missing fence"), ("b", "unterminated fence"), ("c", "version 2"), ("d", "missing fence")]


def test_reports_without_units(spark):
    head = spark.createDataFrame([("r", None, 0, 0, 0, 0, 0, None)], f"repo string, ref string, {', '.join(f'{n} long' for n in rpt.SUMMARY[:-1])}, percent double")
    units = spark.createDataFrame([], "repo string, ord int, unit string, file string, scanned long, documented long, percent double, uncovered array<string>")
    text = rpt.render(head, units, spark.createDataFrame([], "repo string, path string, suggested_unit string, reason string")).first()["text"]
    assert text.endswith("  percent: n/a\nunits: []\nundocumented: []\n") and "ref: null\n" in text


REGION = "doc_id int, region_id string, mode string, stored_hash string, expected string, known boolean, declared boolean"


def test_corrected_text_is_a_fixed_point(spark):
    text = "# T\n<!-- BEGIN a -->\nold\n<!-- END a -->\n<!-- BEGIN h -->\nmine\n<!-- END h -->\n<!-- BEGIN s -->\nedited\n<!-- END s -->\ntail"
    docs = spark.createDataFrame([(1, text, "was", "now"), (2, None, None, "now")], "doc_id int, text string, stored string, current string")
    regions = spark.createDataFrame([(1, "a", "generated", None, "new\nbody", True, True), (1, "h", "human", None, "x", True, True), (1, "s", "llm-seeded", "other", "y", True, True), (1, "gone", "generated", None, "z", True, True)], REGION)
    once = [x.cache() for x in monitor.corrected(docs, regions)]
    twice = monitor.corrected(*once)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(once[0]) == rows(twice[0]) and rows(once[1]) == rows(twice[1])
    assert {r["doc_id"]: (r["text"], r["stored"]) for r in once[0].collect()} == {1: (text.replace("old", "new\nbody"), "now"), 2: (None, None)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    assert {r["region_id"]: r["stored_hash"] for r in once[1].collect()} == {"a": digest("new\nbody"), "h": digest("mine"), "s": "other", "gone": None}


def test_a_run_ends_and_runs_again_on_its_result(spark):
    page = lambda body: f"<!-- BEGIN a -->\n{body}\n<!-- END a -->"
    docs = spark.createDataFrame([(1, page("old"), "was", "now", "eng-guide", "sig"), (2, page("old"), "now", "now", "eng-guide", "sig"), (3, None, "x", "now", "eng-guide", "sig")], "doc_id int, text string, stored string, current string, audience string, detail string")
    regions = spark.createDataFrame([(i, "a", "generated", None, "new", True, True) for i in (1, 2)], REGION)
    suspects, rules = spark.createDataFrame([(2, 9)], "doc_id int, upstream_id int"), spark.createDataFrame([], "doc_id int, kind string, audience string, verdict string")
    after, stamps, told, left = monitor.run(docs, regions, suspects, rules)
    assert sorted((r["doc_id"], r["kind"], r["verdict"], r["applied"], r["round"]) for r in told.collect()) == [(1, "HASH", "FIX", True, 0), (1, "REGION", "FIX", True, 0), (2, "REGION", "FIX", True, 0), (2, "SUSPECT_LINK", "ESCALATE", False, 0), (3, "MISSING_DOC", "ESCALATE", False, 0)]
    assert sorted((r["doc_id"], r["kind"]) for r in left.collect()) == [(2, "SUSPECT_LINK"), (3, "MISSING_DOC")]
    assert {r["doc_id"]: r["text"] for r in after.collect()} == {1: page("new"), 2: page("new"), 3: None}
    assert monitor.run(after, stamps, suspects, rules)[2].where("applied").count() == 0


def test_later_rounds_detect_only_what_was_touched(spark, monkeypatch):
    page = lambda body: f"<!-- BEGIN a -->\n{body}\n<!-- END a -->"
    rows = [(i, page("old" if i == 1 else "new"), "now", "now", "eng-guide", "sig") for i in range(6)] + [(6, None, "x", "now", "eng-guide", "sig")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, stored string, current string, audience string, detail string")
    regions = spark.createDataFrame([(i, "a", "generated", None, "new", True, True) for i in range(6)], REGION)
    suspects, rules = spark.createDataFrame([(2, 9)], "doc_id int, upstream_id int"), spark.createDataFrame([], "doc_id int, kind string, audience string, verdict string")
    looked, detect = [], monitor.detected
    monkeypatch.setattr(monitor, "detected", lambda d, r, s: (looked.append(d.count()), detect(d, r, s))[1])
    left = monitor.run(docs, regions, suspects, rules)[3]
    assert looked == [7, 1] and sorted((r["doc_id"], r["kind"]) for r in left.collect()) == [(2, "SUSPECT_LINK"), (6, "MISSING_DOC")]
    assert sorted((r["doc_id"], r["kind"]) for r in monitor.run(docs, regions, suspects, rules, bound=1)[3].collect()) == [(2, "SUSPECT_LINK"), (6, "MISSING_DOC")]
