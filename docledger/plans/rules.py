"""Registered queries over document rules and report rows, each with its SQL counterpart.

Documents are made from the text table by arithmetic on doc_id, so that every rule has cases; the SQL
states the outcome of each case instead of parsing anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions import text as X
from docledger.operators import coverage, documents, layout, reports, scripts
from docledger.plans.queries import WAIVERS
from docledger.plans.registry import query
from docledger.sources import adapters as A

# Layout.


def _pick(n: Column, *values) -> Column:
    """The value with number n, modulo how many there are."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))).cast("int"))


_HEADS = (
    "", "---\ncdm:\n  schema_version: 1.0.0\n  audience: eng-guide\n  fingerprint: ab12\n---\n",
    "---\ntitle: x\ncdm:\n  schema_version: '0.9'\n  audience: user-guide\n  fingerprint: ab12\n---\n", "---\ncdm:\n  other: 1\n---\n",
    '---\ncdm:\n  fingerprint: ab12\n  audience: "eng-guide"\n  schema_version: "1.0.0"\n---\n', "---\ncdm:\n  schema_version: 1.0.0\n",
    "---\ncdm: {schema_version: 1.0.0, audience: eng-guide, fingerprint: [ab, 12]}\n---\n", "---\n{}\n---\n", "---\ncdm:\n    a: 1\n  b: 2\n---\n",
    "---\r\ncdm:\r\n  schema_version: 1.0.0 # now\r\n  fingerprint: ab12\r\n  audience: eng-guide\r\n---\r\n",
)
_TITLES = ("plain\n", "# T\n", "# T\n\n> why\n", "\n#  T\n> why\n> more\n\n> no part\n")
_REGIONS = (
    "<!-- BEGIN a -->\nx\n<!-- END a -->\n", "<!-- BEGIN a -->\n<!-- END a -->\n<!-- BEGIN b -->\ny\n<!-- END b -->\n", "", "<!-- BEGIN a -->\nx\n",
    "<!-- BEGIN a -->\n<!-- END a -->\n<!-- BEGIN a -->\n<!-- END a -->\n",
)


def _laid_out(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    whole = F.regexp_replace("text", r"[#>\-]", "")
    body = F.concat(_pick(n, *_TITLES), whole, F.lit("\n"), _pick(n, *_REGIONS))
    digest = X.body_hash(body)
    name = F.when(n % 2 == 0, "code-doc").otherwise("other-docs")
    page = F.when(n % 9 == 2, "<p>").when(n % 9 == 4, F.concat(F.lit('<meta name="'), name, F.lit('-md-sha256" content="'), digest, F.lit('">'))).when(n % 9 != 1, '<meta name="code-doc-md-sha256" content="0ff">')
    keys = F.when(n % 2 == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array().cast("array<string>"))
    return A.bodies(spark, d).where("text is not null").select("doc_id", F.lit("eng-guide").alias("audience"), F.concat(_pick(n, *_HEADS), body).alias("text"), keys.alias("region_keys"), (n % 3 != 0).alias("html"), page.alias("html_text"))


@query("""WITH n AS (SELECT doc_id, doc_id % 10 AS h, doc_id % 4 AS t, doc_id % 5 AS r, doc_id % 2 = 0 AS even, doc_id % 3 <> 0 AS html, doc_id % 9 AS p FROM documents WHERE text IS NOT NULL),
  c AS (SELECT doc_id, unnest(CASE WHEN h = 8 THEN [{'code': 'MALFORMED_STRUCTURE', 'subject': NULL::VARCHAR}] ELSE [{'code': CASE WHEN h IN (0, 5, 7) THEN 'MISSING_FRONT_MATTER' END, 'subject': NULL::VARCHAR},
    {'code': CASE h WHEN 3 THEN 'MISSING_SCHEMA_VERSION' WHEN 2 THEN 'SCHEMA_VERSION_MISMATCH' END, 'subject': NULL}, {'code': CASE h WHEN 3 THEN 'MISSING_AUDIENCE' WHEN 2 THEN 'AUDIENCE_MISMATCH' END, 'subject': NULL},
    {'code': CASE WHEN h = 3 THEN 'MISSING_FINGERPRINT' END, 'subject': NULL}, {'code': CASE WHEN h = 5 OR t = 0 THEN 'MISSING_TITLE' WHEN t = 1 THEN 'MISSING_PURPOSE' END, 'subject': NULL},
    {'code': CASE WHEN html THEN CASE p WHEN 1 THEN 'HTML_MISSING' WHEN 2 THEN 'HTML_NOT_DERIVED' WHEN 4 THEN CASE WHEN h = 5 THEN 'HTML_STALE' END ELSE 'HTML_STALE' END END, 'subject': NULL},
    {'code': CASE WHEN r IN (3, 4) THEN 'MALFORMED_STRUCTURE' END, 'subject': NULL}, {'code': CASE WHEN r IN (0, 1) AND NOT even THEN 'UNDECLARED_REGION' END, 'subject': 'a'},
    {'code': CASE WHEN r = 1 THEN 'UNDECLARED_REGION' END, 'subject': 'b'}, {'code': CASE WHEN r < 3 AND even THEN 'MISSING_REGION' END, 'subject': 'c'}, {'code': CASE WHEN r = 2 AND even THEN 'MISSING_REGION' END, 'subject': 'a'}] END, recursive := true) FROM n)
  SELECT doc_id, code, subject FROM c WHERE code IS NOT NULL""")
def layout_lint(spark: SparkSession, d: str) -> DataFrame:
    return layout.lint(_laid_out(spark, d))


def _region_rows(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("doc_id"), F.col("k")
    rows = A.bodies(spark, d).where("text is not null").select("doc_id", F.col("text").alias("body"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    mode = _pick(n + k, "generated", "llm", "llm-seeded", "human", "generated", "human")
    stored = F.when((n + k) % 7 == 1, X.body_hash(F.col("body"))).when((n + k) % 7 > 3, "old")
    expected = F.when((n + k) % 8 != 7, F.when((n + k) % 4 == 0, F.col("body")).otherwise(F.concat("body", F.lit("x"))))
    return rows.select("doc_id", F.concat(F.lit("r"), k).alias("region_id"), "body", mode.alias("mode"), stored.alias("stored_hash"), ((n + 2 * k) % 3 != 0).alias("known"), (k != 4).alias("declared"), expected.alias("expected"))


_REGION_ROWS = """x AS (SELECT doc_id, k, doc_id + k AS s, (doc_id + 2 * k) % 3 <> 0 AS known, ['generated','llm','llm-seeded','human','generated','human'][(doc_id + k) % 6 + 1] AS mode FROM documents, range(5) t(k) WHERE text IS NOT NULL),
  y AS (SELECT *, s % 7 > 3 AS edited, mode = 'llm-seeded' AND s % 7 > 3 AS locked FROM x)"""


@query(f"WITH {_REGION_ROWS} SELECT doc_id, 'r' || k AS region_id, locked, mode = 'human' OR locked AS advisory FROM y")
def region_states(spark: SparkSession, d: str) -> DataFrame:
    return layout.region_states(_region_rows(spark, d)).select("doc_id", "region_id", "locked", "advisory")


@query(f"""WITH {_REGION_ROWS}, d AS (SELECT doc_id, doc_id % 11 <> 0 AS present, doc_id % 3 = 0 AS moved FROM documents WHERE text IS NOT NULL),
  z AS (SELECT y.*, moved, mode = 'human' OR locked AS own, s % 8 <> 7 AND s % 4 <> 0 AS differs FROM y JOIN d USING (doc_id) WHERE present AND k < 4),
  f AS (SELECT doc_id, 'r' || k AS subject, own, CASE WHEN NOT known THEN CASE WHEN own THEN NULL WHEN mode <> 'llm' THEN 'UNHEALABLE' WHEN moved THEN 'REGION' END
    WHEN differs AND (NOT own OR moved OR (mode = 'human' AND s % 7 = 1)) THEN 'REGION' END AS kind FROM z)
  SELECT doc_id, CASE WHEN present THEN 'HASH' ELSE 'MISSING_DOC' END AS kind, NULL::VARCHAR AS subject, true AS healable FROM d WHERE NOT present OR moved
  UNION ALL SELECT doc_id, kind, subject, kind = 'REGION' AND NOT own FROM f WHERE kind IS NOT NULL
  UNION ALL SELECT doc_id, 'SUSPECT_LINK', upstream_id::VARCHAR, false FROM edge_status WHERE status <> 'ok'""")
def drift_findings(spark: SparkSession, d: str) -> DataFrame:
    from docledger.operators import graph

    docs = A.bodies(spark, d).where("text is not null").select("doc_id", (F.col("doc_id") % 11 != 0).alias("present"), F.lit("now").alias("current"), F.when(F.col("doc_id") % 3 != 0, "now").when(F.col("doc_id") % 2 == 0, "old").alias("stored"))
    suspects = graph.edge_status(A.doc_edges(spark, d), A.doc_hashes(spark, d), A.edge_stamps(spark, d))
    return layout.drift_findings(docs, _region_rows(spark, d), suspects)


@query("""WITH n AS (SELECT doc_id, text AS f, doc_id % 3 AS k FROM documents WHERE text IS NOT NULL),
  t AS (SELECT doc_id, f || chr(10) || '<!-- BEGIN a -->' || chr(10) AS a, chr(10) || '<!-- END a -->' || chr(10) || f AS b, f, k FROM n)
  SELECT doc_id, a || CASE k WHEN 0 THEN 'x' || chr(10) || 'y' WHEN 1 THEN f ELSE 'old' || chr(10) || 'two' END || b AS text, k <> 2 AS changed FROM t WHERE f NOT IN ('old' || chr(10) || 'two')""")
def region_replace(spark: SparkSession, d: str) -> DataFrame:
    first = F.col("text")
    docs = A.bodies(spark, d).where("text is not null").select("doc_id", F.concat(first, F.lit("\n<!-- BEGIN a -->\nold\ntwo\n<!-- END a -->\n"), first).alias("text"), first.alias("first"))
    new = docs.where("doc_id % 3 < 2").select("doc_id", F.lit("a").alias("region_id"), F.when(F.col("doc_id") % 3 == 0, "x\ny").otherwise(F.col("first")).alias("body"))
    return layout.replaced_regions(docs.select("doc_id", "text"), new.unionByName(new.select("doc_id", F.lit("b").alias("region_id"), F.lit("no such region").alias("body"))))


# Coverage reports.


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage.file_coverage(A.files(spark, d), A.code_refs(spark, d), WAIVERS)


@query("""SELECT split_part(path, '/', 1) AS repo_id, count(*) FILTER (status = 'documented') AS documented, count(*) FILTER (status = 'undocumented') AS undocumented, count(*) FILTER (status = 'waived') AS waived,
  CASE WHEN count(*) FILTER (status <> 'waived') = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * count(*) FILTER (status = 'documented') / count(*) FILTER (status <> 'waived') END AS percent_files,
  string_agg(path || ':' || coalesce(owners, '') || ':' || status, ';' ORDER BY path) AS files FROM file_cov GROUP BY 1""")
def coverage_snapshot(spark: SparkSession, d: str) -> DataFrame:
    out = reports.coverage_snapshot(_coverage(spark, d).withColumn("repo_id", F.split("path", "/")[0]))
    listed = F.array_join(F.transform("files", lambda f: F.concat(f["path"], F.lit(":"), F.coalesce(F.array_join(f["owners"], ","), F.lit("")), F.lit(":"), f["status"])), ";")
    return out.withColumn("files", listed)


@query("""WITH c AS (SELECT split_part(path, '/', 1) AS unit, count(*) FILTER (status = 'documented') AS documented, count(*) FILTER (status = 'undocumented') AS undocumented, count(*) FILTER (status = 'waived') AS waived FROM file_cov GROUP BY 1),
  p AS (SELECT *, CASE WHEN documented + undocumented > 0 THEN 100.0::DOUBLE * documented / (documented + undocumented) END AS percent FROM c)
  SELECT unit, coalesce(percent < 40, false) OR undocumented > 0 AS failed, CASE WHEN coalesce(percent < 40, false) THEN 'below_floor' WHEN undocumented > 0 THEN 'unreferenced' END AS reason FROM p""")
def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    report = _coverage(spark, d).withColumn("unit", F.split("path", "/")[0]).groupBy("unit").agg(n("documented"), n("undocumented"), n("waived"))
    base = F.col("documented") + F.col("undocumented")
    report = report.withColumn("percent", F.when(base > 0, 100.0 * F.col("documented") / base))
    return reports.coverage_gate(report, 40.0, fail_on_unreferenced=True).select("unit", "failed", "reason")


@query("""SELECT path, CASE WHEN starts_with(path, 'small/') THEN CASE WHEN starts_with(path, 'small/plated/') THEN 'deep' ELSE 'small' END WHEN starts_with(path, 'promo/') THEN 'promo' END AS suggested_unit FROM file_cov WHERE status = 'undocumented'""")
def suggested_units(spark: SparkSession, d: str) -> DataFrame:
    units = spark.sql("SELECT * FROM VALUES ('small', 'small'), ('small/plated', 'deep'), ('promo', 'promo'), ('none', 'none') AS t(dir, unit)")
    return reports.suggested_units(_coverage(spark, d).where("status = 'undocumented'").select("path"), units).select("path", "suggested_unit")


@query("""SELECT split_part(path, '/', 1) AS unit, count(*) FILTER (suffix(path, '.py') AND NOT contains(path, '/brushed/') AND contains(path, '_1')) AS ignored_files,
  count(*) FILTER (suffix(path, '.py') AND NOT contains(path, '/brushed/') AND NOT contains(path, '_1')) AS scanned_files FROM files GROUP BY 1""")
def ignored_counts(spark: SparkSession, d: str) -> DataFrame:
    match = lambda *globs: X.matches_any(F.col("path"), list(globs))
    rows = A.files(spark, d).withColumn("unit", F.split("path", "/")[0])
    return reports.ignored_counts(rows, match("**/*.py"), match("**/brushed/**"), match("**/*_1*"))


@query("""WITH s AS (SELECT s.path, s.name, coalesce(o.owner, replace(regexp_replace(s.path, '\\.py$', ''), '/', '-')) AS doc, o.owner IS NULL AS new, coalesce('sibling symbols already in ' || o.owner, 'no doc references ' || s.path) AS reason
    FROM sym_cov s LEFT JOIN (SELECT path, min(owner) AS owner FROM sym_cov WHERE owner IS NOT NULL GROUP BY path) o ON o.path = s.path WHERE s.status = 'undocumented')
  SELECT doc AS suggested_doc_id, count(*) AS gaps, '### `' || doc || '`' || CASE WHEN bool_or(new) THEN ' (new doc)' ELSE '' END || ' — ' || arg_min(reason, path || chr(0) || name) || chr(10) || string_agg('- `' || path || '::' || name || '`', chr(10) ORDER BY path, name) AS section FROM s GROUP BY doc""")
def gap_sections(spark: SparkSession, d: str) -> DataFrame:
    return reports.gap_sections(coverage.suggest_owners(coverage.symbol_coverage(A.symbols(spark, d), A.selections(spark, d), WAIVERS)))


# Tickets, features, indexes.


def _handled(spark: SparkSession, d: str) -> DataFrame:
    return A.records(spark, d).select("record_id", "verdict")


@query("""SELECT record_id, pos::INT AS pos, CASE verdict WHEN 'FIX' THEN pos < 2 WHEN 'INVALIDATE' THEN pos = 0 ELSE false END AS auto_satisfied FROM records, range(3) t(pos) WHERE pos < CASE verdict WHEN 'FIX' THEN 3 ELSE 2 END""")
def acceptance_checklist(spark: SparkSession, d: str) -> DataFrame:
    return reports.checklist(_handled(spark, d)).select("record_id", "pos", "auto_satisfied")


def _features(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    modules = F.when(n % 10 == 0, F.array().cast("array<string>")).when(n % 10 == 1, F.array("p_brand", F.lit("nowhere"))).otherwise(F.array("p_brand"))
    return A.raw(spark, d, "part").select(F.format_string("%s-%03d", F.when(n % 7 == 0, "FEAT-extract").otherwise("FEAT-EXTRACT"), n - F.when(n % 5 == 0, 1).otherwise(0)).alias("feature_id"), F.col("p_type").alias("subsystem"), modules.alias("modules"))


@query("""WITH f AS (SELECT p_partkey AS n, printf('%s-%03d', CASE WHEN p_partkey % 7 = 0 THEN 'FEAT-extract' ELSE 'FEAT-EXTRACT' END, p_partkey - (p_partkey % 5 = 0)::INT) AS id FROM part)
  SELECT id AS feature_id, 'bad_id' AS problem FROM f WHERE n % 7 = 0 OR len(id) <> 16 UNION ALL SELECT id, 'duplicate_id' FROM f GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT id, 'no_modules' FROM f WHERE n % 10 = 0 UNION ALL SELECT DISTINCT id, 'unknown_module' FROM f WHERE n % 10 = 1""")
def feature_catalog_problems(spark: SparkSession, d: str) -> DataFrame:
    return reports.catalog_problems(_features(spark, d), A.raw(spark, d, "part").select(F.col("p_brand").alias("module")).distinct())


@query("""SELECT p_type AS subsystem, count(*) AS n, string_agg(printf('%s-%03d', CASE WHEN p_partkey % 7 = 0 THEN 'FEAT-extract' ELSE 'FEAT-EXTRACT' END, p_partkey - (p_partkey % 5 = 0)::INT), ',' ORDER BY printf('%s-%03d', CASE WHEN p_partkey % 7 = 0 THEN 'FEAT-extract' ELSE 'FEAT-EXTRACT' END, p_partkey - (p_partkey % 5 = 0)::INT)) AS features FROM part GROUP BY 1""")
def features_by_subsystem(spark: SparkSession, d: str) -> DataFrame:
    return reports.by_subsystem(_features(spark, d)).select("subsystem", F.size("features").cast("long").alias("n"), F.array_join("features", ",").alias("features"))


@query("""WITH c AS (SELECT 'doc-' || doc_id AS nodeid, unnest(['F-' || (doc_id % 30), 'G-' || (doc_id % 7)]) AS feature_id FROM documents) SELECT feature_id, string_agg(DISTINCT nodeid, ', ' ORDER BY nodeid) AS nodeids FROM c GROUP BY 1""")
def tested_by(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    cases = A.bodies(spark, d).select(F.concat(F.lit("doc-"), n).alias("nodeid"), F.array(F.concat(F.lit("F-"), n % 30), F.concat(F.lit("G-"), n % 7)).alias("features"))
    return reports.tested_by(cases).withColumn("nodeids", F.array_join("nodeids", ", "))


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'docs/a/' WHEN 1 THEN 'docs/index/' ELSE 'test-docs/' END AS dir, CASE doc_id % 3 WHEN 0 THEN '../a/' WHEN 1 THEN '' ELSE '../../test-docs/' END AS rel, doc_id % 2 = 0 AS html, doc_id % 4 AS t FROM documents)
  SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 'tests' ELSE 'main' END AS class, '| [' || CASE t WHEN 0 THEN doc_id::VARCHAR ELSE 'T \\| x' END || '](' || rel || 'd' || doc_id || CASE WHEN html THEN '.html' ELSE '.md' END || ') | ' || CASE t WHEN 2 THEN 'why' WHEN 3 THEN 'why more' ELSE '' END || ' |' AS row FROM n""")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    text = _pick(n, "plain\n", "# T | x\n\nno quote", "# T | x\n\n> why\n", "\n# T | x\n> why\n>  more\n\n> no part\n")
    docs = A.bodies(spark, d).select("doc_id", F.concat(_pick(n, "docs/a/", "docs/index/", "test-docs/"), F.lit("d"), n, F.lit(".md")).alias("path"), F.lit("eng-guide").alias("audience"), text.alias("text"), (n % 2 == 0).alias("html"))
    return reports.index_rows(docs, "docs/index/README.md").select("doc_id", "class", "row")


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'owner-' || c_nationkey END AS inherited, 'edit-' || substr(sha1('repo-1' || chr(0) || c_name || chr(0) || '2026-01-01'), 1, 12) AS edit_id, sha256(c_name) AS token FROM customer""")
def unit_owners_and_ids(spark: SparkSession, d: str) -> DataFrame:
    """The owner that a document inherits from its unit, the id of an edit of it and the stored form of a token."""
    c = A.raw(spark, d, "customer")
    docs = c.select(F.col("c_custkey").alias("doc_id"), "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("unit"))
    units = A.raw(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), F.concat(F.lit("owner-"), "n_nationkey").alias("owner"))
    rows = reports.unit_owners(docs, units).select("doc_id", "inherited", F.lit("repo-1").alias("repo_id"), F.col("c_name").alias("body"), F.lit("2026-01-01").alias("staged_at"))
    return reports.edit_ids(rows).select("doc_id", "inherited", "edit_id", reports.token_hash(F.col("body")).alias("token"))


@query("""SELECT event_id, substr(sha256('doc-' || user_id || chr(0) || substr(sha256(props), 1, 16) || chr(0) || event_type), 1, 12) AS record_id, CASE WHEN value IS NULL THEN 'review' WHEN value % 1 >= 0.9 THEN 'sync' WHEN value % 1 >= 0.6 THEN 'review' ELSE 'drift' END AS signal FROM events""")
def record_ids_and_signals(spark: SparkSession, d: str) -> DataFrame:
    """The id that follows from a record's document, surface and time, and the signal of a coverage ratio."""
    e = A.raw(spark, d, "events")
    return e.select("event_id", X.record_id(F.concat(F.lit("doc-"), "user_id"), X.short_hash(F.col("props")), F.col("event_type")).alias("record_id"), X.coverage_signal(F.col("value") % 1).alias("signal"))


@query("""SELECT path, CASE WHEN suffix(path, '.py') THEN 'python' ELSE 'unknown' END AS language, 'main' AS class FROM files""")
def file_classes(spark: SparkSession, d: str) -> DataFrame:
    return A.files(spark, d).select("path", X.language(F.col("path")).alias("language"), X.path_class(F.col("path")).alias("class"))


# Scope, gates, replies, styles, keys.


@query("""SELECT path, CASE WHEN starts_with(path, 'small/plated/') THEN 'deep' ELSE split_part(path, '/', 1) END AS unit FROM files
  WHERE CASE WHEN starts_with(path, 'small/plated/') THEN suffix(path, '.txt') WHEN starts_with(path, 'small/') THEN suffix(path, '.py') WHEN starts_with(path, 'promo/') THEN true ELSE false END""")
def scoped_files(spark: SparkSession, d: str) -> DataFrame:
    units = spark.sql("SELECT * FROM VALUES ('small', 'small', array('.py')), ('small/plated', 'deep', array('.txt')), ('promo', 'promo', array('.py', '.txt')) AS t(dir, unit, formats)")
    return coverage.scoped_files(A.files(spark, d).select("path"), units)


@query("SELECT repo_id, count(*) FILTER (drift_kind <> 'SUSPECT_LINK') AS gating, bool_or(drift_kind <> 'SUSPECT_LINK') AS failed FROM records GROUP BY 1")
def check_gate(spark: SparkSession, d: str) -> DataFrame:
    return documents.gate(A.records(spark, d).withColumnRenamed("drift_kind", "kind"))


@query(r"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"a": {"b": "}"}, "n": ' || doc_id || '}' WHEN 1 THEN '{"q": "\"{\\"}' WHEN 2 THEN '{}' END AS object FROM documents""")
def reply_objects(spark: SparkSession, d: str) -> DataFrame:
    """Replies of prose around an object with nested braces, quotes and backslashes, an empty one, none, and one that never closes."""
    n = F.col("doc_id")
    first = F.coalesce(F.regexp_replace("text", r"[{}\"\\]", ""), F.lit(""))
    found = F.when(n % 5 == 0, F.concat(F.lit('{"a": {"b": "}"}, "n": '), n, F.lit('} and {"c": 1}'))).when(n % 5 == 1, '{"q": "\\"{\\\\"} }"').when(n % 5 == 2, "{}}").when(n % 5 == 3, "no object").otherwise('{"open": "}"')
    return A.bodies(spark, d).select("doc_id", documents.json_object(F.concat(first, F.lit("\n```json\n"), found)).alias("object"))


_STYLES = {"document_type": "guide", "tone": "plain", "writing_style": "short", "vocabulary": "basic"}


@query("SELECT c_custkey AS doc_id, 'tone' AS category, 'loud' AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'vocabulary', 'basic' FROM customer WHERE c_custkey % 3 <> 0")
def missing_styles(spark: SparkSession, d: str) -> DataFrame:
    """Every third document has a mapping of its own, and every sixth a second one that must not count."""
    docs = A.raw(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    own = lambda every, at, tone: docs.where(f"doc_id % {every} = 0").select(F.lit(at).alias("ord"), "doc_id", F.lit("guide").alias("document_type"), F.lit(tone).alias("tone"), F.lit("short").alias("writing_style"), F.lit("rich").alias("vocabulary"))
    templates = spark.sql("SELECT * FROM VALUES ('document_type', 'guide'), ('tone', 'plain'), ('writing_style', 'short'), ('vocabulary', 'rich') AS t(category, name)")
    return documents.missing_styles(documents.styles(docs, own(6, 2, "shrill").unionByName(own(3, 1, "loud")), _STYLES), templates)


@query("SELECT event_id, 'repo-' || (user_id % 8) AS repo_id, CASE WHEN event_id % 3 = 0 THEN 'own' WHEN event_id % 3 = 1 THEN 'sent' END AS local_path FROM events WHERE user_id % 8 >= 6")
def refused_registrations(spark: SparkSession, d: str) -> DataFrame:
    """Registrations of unknown repositories, with the one path that each has."""
    n = F.col("event_id")
    rows = A.raw(spark, d, "events").select("event_id", F.concat(F.lit("repo-"), F.col("user_id") % 8).alias("repo_id"), F.when(n % 3 == 0, "own").alias("identity_path"), F.when(n % 3 < 2, "sent").alias("local_path"))
    known = spark.range(6).select(F.concat(F.lit("repo-"), "id").alias("repo_id"))
    return documents.folded_identity(documents.orphaned(rows, known, "repo_id")).select("event_id", "repo_id", "local_path")


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY assignee ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE reason WHEN 'orphan' THEN 0 ELSE 1 END, doc_id) AS rank FROM items WHERE reason <> 'suspect')
  SELECT coalesce(assignee, '(unowned)') AS assignee, rank, '    [' || severity || '] ' || reason || ' ' || doc_id || ' — ' || status AS line FROM i""")
def hub_worklist(spark: SparkSession, d: str) -> DataFrame:
    """The worklist of a hub, which has no bodies to hash and so no suspect links, as lines."""
    from docledger.operators import governance

    owners = governance.effective_owners(A.doc_owners(spark, d))
    items = governance.worklist_items(owners, governance.ownership(owners, A.roster(spark, d)), governance.staleness(A.reviewed_docs(spark, d), A.NOW))
    return documents.worklist_lines(governance.ranked(items))


# Scripts, and reports as text.


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    head = F.concat(F.lit("#!/bin/sh\n# Sizes.\n#   of "), n, F.lit("\nsize_"), n, F.lit("() {\n  if [ $1 ]; then { echo "), n, F.lit("; }; fi\n}\n\nfunction _hidden { :; }\n# above\nopen() {\n  echo\n}\nno-name() {\n}\nno.name() {\n"))
    tail = F.when(F.col("p_partkey") % 2 == 0, 'while getopts ":ab:" o; do :; done\ncase $x in --long) ;; esac\n').otherwise("case $1 in -h|--help) ;; -x) ;; esac\n")
    return A.raw(spark, d, "part").select(F.concat(F.lit("s"), n, F.lit(".sh")).alias("path"), F.concat(head, tail).alias("text"))


@query("""WITH p AS (SELECT 's' || p_partkey || '.sh' AS path, p_partkey AS n FROM part)
  SELECT path, 'size_' || n AS name, 4 AS lineno, 6 AS end_lineno, 'Sizes.' || chr(10) || '  of ' || n AS docstring FROM p
  UNION ALL SELECT path, '_hidden', 8, 8, NULL FROM p UNION ALL SELECT path, 'open', 10, 12, 'above' FROM p""")
def shell_functions(spark: SparkSession, d: str) -> DataFrame:
    return scripts.shell_functions(_scripts(spark, d)).drop("signature")


@query("SELECT 's' || p_partkey || '.sh' AS path, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['-a', '-b'] ELSE ['-h', '--help', '-x'] END) AS switch FROM part")
def shell_switches(spark: SparkSession, d: str) -> DataFrame:
    return scripts.shell_switches(_scripts(spark, d))


def _report(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cov = _coverage(spark, d).withColumn("unit", F.split("path", "/")[0])
    n = lambda s: F.count_if(F.col("status") == s)
    units = cov.groupBy("unit").agg(F.count("*").alias("scanned"), n("documented").alias("documented"), n("waived").alias("waived"), F.collect_list(F.when(F.col("status") == "undocumented", F.col("path"))).alias("uncovered"))
    units = units.withColumn("percent", coverage.report_percent(F.col("documented"), F.col("scanned"), F.col("waived")))
    return units, cov.where("status = 'undocumented'").select("path", F.lit(None).cast("string").alias("suggested_unit"))


_SLICES = """u AS (SELECT split_part(path, '/', 1) AS unit, count(*) AS scanned, count(*) FILTER (status = 'documented') AS documented, count(*) FILTER (status = 'waived') AS waived, list(path ORDER BY path) FILTER (status = 'undocumented') AS gaps FROM file_cov GROUP BY 1),
  v AS (SELECT *, CASE WHEN scanned > waived THEN floor((documented * 20000 + scanned - waived) / (2.0 * (scanned - waived))) / 100 END AS percent FROM u)"""


@query(f"""WITH {_SLICES}, l AS (SELECT unit AS key, unnest(list_concat(['  - unit: ' || unit, '    scanned: ' || scanned, '    documented: ' || documented, '    percent: ' || coalesce(printf('%.2f', percent), 'n/a')],
    CASE WHEN gaps IS NULL THEN ['    uncovered: []'] ELSE list_concat(['    uncovered:'], list_transform(gaps, lambda p: '      - ' || p)) END)) AS line, unnest(range(5 + coalesce(len(gaps), 0)))::INT AS pos FROM v)
  SELECT 'units' AS part, key, pos, line FROM l UNION ALL SELECT 'undocumented', path, 0, '  - path: ' || path FROM file_cov WHERE status = 'undocumented'
  UNION ALL SELECT 'undocumented', path, 1, '    suggested_unit: null' FROM file_cov WHERE status = 'undocumented'""")
def coverage_report_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.coverage_lines(*_report(spark, d))


@query(f"WITH {_SLICES} SELECT unit, scanned, documented, percent::DOUBLE AS percent FROM v")
def coverage_report_read_back(spark: SparkSession, d: str) -> DataFrame:
    return reports.parsed_units(reports.coverage_lines(*_report(spark, d)))
