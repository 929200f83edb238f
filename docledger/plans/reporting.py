"""Registered queries over whole reports: coverage reports, tickets, issues, worklists, indexes, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions import text as X
from docledger.operators import coverage, documents, governance, monitor, records, reports, rpt, surface, trace
from docledger.plans.queries import WAIVERS, _items
from docledger.plans.registry import query
from docledger.sources import adapters as A
from docledger.sources import logs


def _handled(spark: SparkSession, d: str) -> DataFrame:
    """Handled drifts with a fix of a region, of the whole document, of neither or none, and with the last resolution."""
    rows, k = A.records(spark, d), F.col("seq") % 5
    last = records.last_resolution(A.resolutions(spark, d)).select("record_id", "resolution")
    return rows.join(last, "record_id", "left").select(
        "record_id", "doc_id", F.col("drift_kind").alias("kind"), F.when(F.col("drift_kind") == "REGION", F.concat(F.lit("r"), F.col("seq") % 4)).alias("region_id"), "verdict", F.lit("the code moved").alias("cause"),
        F.concat(F.lit("hash "), "surface_hash").alias("detail"), (F.col("seq") % 6 != 0).alias("healable"), "resolution", F.when(k > 0, F.concat(F.lit("why "), "seq")).alias("rationale"),
        F.when(k == 1, "a").alias("fix_region_id"), F.when(k == 2, "x").alias("fix_region_body"), F.when(k == 3, "y").alias("fix_doc_text"),
    )


@query(r"""WITH r AS (SELECT *, CASE WHEN verdict = 'ESCALATE' OR drift_kind = 'UNHEALABLE' OR seq % 6 = 0 THEN 'high' WHEN verdict = 'INVALIDATE' THEN 'low' ELSE 'medium' END AS severity FROM records),
  a AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS affected FROM chosen WHERE split_part(name, '.', -1) NOT LIKE '\_%' ESCAPE '\' GROUP BY doc_id)
  SELECT r.record_id, severity, CASE verdict WHEN 'INVALIDATE' THEN 'dismiss' WHEN 'ESCALATE' THEN 'escalate' ELSE 'apply' END AS action, 'hash ' || surface_hash || ' The remediation agent''s read: the code moved' AS summary,
  '[' || upper(severity) || '] ' || drift_kind || ' in ' || r.doc_id || CASE WHEN drift_kind = 'REGION' THEN ' · region r' || (r.seq % 4) ELSE '' END AS title, coalesce(affected, '') AS affected,
  CASE r.seq % 5 WHEN 1 THEN 'region' WHEN 2 THEN 'region' WHEN 3 THEN 'whole-doc' ELSE 'none' END AS change_kind,
  CASE WHEN r.seq % 5 > 0 THEN 'why ' || r.seq WHEN verdict = 'INVALIDATE' THEN 'No documentation change needed — the code moved' ELSE 'Needs a human author — the code moved' END AS proposed_change,
  CASE verdict WHEN 'INVALIDATE' THEN 'Dismiss as not-applicable' WHEN 'ESCALATE' THEN 'Escalate to a human author' ELSE 'Apply the proposed fix' END AS recommended_action,
  CASE WHEN resolution IS NULL THEN 'proposed' WHEN resolution = 'accepted' THEN 'validated' WHEN resolution = 'overridden' THEN 'changes-requested' ELSE 'rejected' END AS status
  FROM r LEFT JOIN a USING (doc_id) LEFT JOIN last_res l ON l.record_id = r.record_id""")
def ticket_rows(spark: SparkSession, d: str) -> DataFrame:
    chosen = coverage.selected_symbols(A.symbols(spark, d), A.selections(spark, d)).select("doc_id", "name", X.is_public(F.col("name")).alias("public"))
    columns = ("severity", "action", "title", "summary", "change_kind", "proposed_change", "recommended_action", "status")
    return reports.tickets(_handled(spark, d), chosen).select("record_id", *columns, F.array_join("affected_symbols", ",").alias("affected"))


_REPORTS = """WITH c AS (SELECT *, split_part(path, '/', 1) AS unit1, split_part(path, '/', 2) AS repo FROM file_cov),
  n AS (SELECT repo, CASE WHEN grouping(unit1) = 0 THEN unit1 END AS unit, count(*) AS scanned, count(*) FILTER (status = 'documented') AS documented, count(*) FILTER (status = 'waived') AS waived, count(*) FILTER (status = 'undocumented') AS uncovered,
    list(path ORDER BY path) FILTER (status = 'undocumented') AS gaps FROM c GROUP BY GROUPING SETS ((repo), (repo, unit1))),
  v AS (SELECT *, CASE WHEN scanned > waived THEN floor((documented * 20000 + scanned - waived) / (2.0 * (scanned - waived))) / 100 END AS percent FROM n),
  g AS (SELECT repo, path, unit1, CASE WHEN unit1 = 'promo' THEN 'promo.yaml' END AS su FROM c WHERE status = 'undocumented')"""


def _reports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries, units and gaps of the reports of all repositories."""
    cov = coverage.file_coverage(A.files(spark, d), A.code_refs(spark, d), WAIVERS).withColumns({"unit": F.split("path", "/")[0], "repo": F.split("path", "/")[1]})
    n = lambda s: F.count_if(F.col("status") == s)
    percent = coverage.report_percent(F.col("documented"), F.col("scanned"), F.col("waived"))
    counts = [F.count("*").alias("scanned"), n("documented").alias("documented"), n("waived").alias("waived"), n("undocumented").alias("uncovered_files")]
    whole = cov.groupBy("repo").agg(*counts).withColumn("percent", percent)
    head = whole.select("repo", F.when(F.col("repo") != "plated", "main").alias("ref"), F.col("scanned").alias("scanned_files"), F.col("documented").alias("documented_files"), F.col("waived").alias("waived_files"), F.lit(0).cast("long").alias("ignored_files"), "uncovered_files", "percent")
    units = cov.groupBy("repo", "unit").agg(*counts, F.collect_list(F.when(F.col("status") == "undocumented", F.col("path"))).alias("uncovered")).withColumn("percent", percent)
    units = units.select("repo", F.col("unit").alias("ord"), "unit", F.concat("unit", F.lit(".yaml")).alias("file"), "scanned", "documented", "percent", "uncovered")
    gaps = cov.where("status = 'undocumented'").select("repo", "path", F.when(F.col("unit") == "promo", "promo.yaml").alias("suggested_unit"), F.concat(F.lit("no dir: '"), "unit", F.lit("'")).alias("reason"))
    return head, units, gaps


@query(f"""{_REPORTS}, p AS (SELECT repo, string_agg('  - unit: ' || unit || chr(10) || '    file: ' || unit || '.yaml' || chr(10) || '    scanned: ' || scanned || chr(10) || '    documented: ' || documented || chr(10) || '    percent: ' || coalesce(printf('%.2f', percent), 'n/a') || chr(10)
    || CASE WHEN gaps IS NULL THEN '    uncovered: []' ELSE '    uncovered:' || chr(10) || array_to_string(list_transform(gaps, lambda x: '      - ' || x), chr(10)) END || chr(10), '' ORDER BY unit) AS units FROM v WHERE unit IS NOT NULL GROUP BY 1),
  q AS (SELECT repo, string_agg('  - path: ' || path || chr(10) || '    suggested_unit: ' || coalesce(su, 'null') || chr(10) || '    reason: ''no dir: ''''' || unit1 || '''''''' || chr(10), '' ORDER BY path) AS gap_text FROM g GROUP BY 1)
  SELECT v.repo, '---' || chr(10) || 'report-version: 1.0.0' || chr(10) || 'kind: coverage' || chr(10) || 'repo: ' || v.repo || chr(10) || 'ref: ' || CASE WHEN v.repo = 'plated' THEN 'null' ELSE 'main' END || chr(10) || 'generated-by: docledger' || chr(10) || '---' || chr(10) || 'summary:' || chr(10)
    || '  scanned_files: ' || scanned || chr(10) || '  documented_files: ' || documented || chr(10) || '  waived_files: ' || waived || chr(10) || '  ignored_files: 0' || chr(10) || '  uncovered_files: ' || uncovered || chr(10) || '  percent: ' || coalesce(printf('%.2f', percent), 'n/a') || chr(10)
    || 'units:' || chr(10) || units || CASE WHEN gap_text IS NULL THEN 'undocumented: []' || chr(10) ELSE 'undocumented:' || chr(10) || gap_text END AS text FROM v JOIN p USING (repo) LEFT JOIN q USING (repo) WHERE v.unit IS NULL""")
def coverage_report_text(spark: SparkSession, d: str) -> DataFrame:
    return rpt.render(*_reports(spark, d))


@query(f"""{_REPORTS} SELECT repo AS file, 'units' AS part, 'documented=' || documented || ',file=' || unit || '.yaml,percent=' || coalesce(printf('%.2f', percent), '') || ',scanned=' || scanned || ',unit=' || unit AS fields, coalesce(array_to_string(gaps, ','), '') AS uncovered FROM v WHERE unit IS NOT NULL
  UNION ALL SELECT repo, 'undocumented', 'path=' || path || ',reason=no dir: ''' || unit1 || ''',suggested_unit=' || coalesce(su, ''), '' FROM g
  UNION ALL SELECT repo, 'summary', 'documented_files=' || documented || ',ignored_files=0,percent=' || coalesce(printf('%.2f', percent), '') || ',scanned_files=' || scanned || ',uncovered_files=' || uncovered || ',waived_files=' || waived, '' FROM v WHERE unit IS NULL
  UNION ALL SELECT repo, 'head', 'generated-by=docledger,kind=coverage,ref=' || CASE WHEN repo = 'plated' THEN '' ELSE 'main' END || ',repo=' || repo || ',report-version=1.0.0', '' FROM v WHERE unit IS NULL""")
def coverage_report_parsed(spark: SparkSession, d: str) -> DataFrame:
    """What parsing finds in rendered reports: all that they were made from."""
    out = rpt.parse(rpt.render(*_reports(spark, d)).withColumnRenamed("repo", "file"))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ",")
    return out.select("file", "part", fields.alias("fields"), F.array_join("uncovered", ",").alias("uncovered"))


@query(r"""WITH s AS (SELECT split_part(s.path, '/', 1) AS repo, s.path, s.name, coalesce(o.owner, replace(regexp_replace(s.path, '\.py$', ''), '/', '-')) AS doc, o.owner IS NULL AS new, coalesce('sibling symbols already in ' || o.owner, 'no doc references ' || s.path) AS reason
    FROM sym_cov s LEFT JOIN (SELECT path, min(owner) AS owner FROM sym_cov WHERE owner IS NOT NULL GROUP BY path) o ON o.path = s.path WHERE s.status = 'undocumented'),
  p AS (SELECT repo, doc, count(*) AS n, '### `' || doc || '`' || CASE WHEN arg_min(new, path || chr(0) || name) THEN ' (new doc)' ELSE '' END || ' — ' || arg_min(reason, path || chr(0) || name) || chr(10) || string_agg('- `' || path || '::' || name || '`', chr(10) ORDER BY path, name) || chr(10) AS section FROM s GROUP BY 1, 2)
  SELECT repo, 'docs: ' || sum(n)::BIGINT || ' undocumented public symbol' || CASE WHEN sum(n) = 1 THEN '' ELSE 's' END AS title, 'Automated coverage report (bot-generated).' || chr(10) || chr(10) || 'The following PUBLIC symbols have no owning document. Each is grouped under the suggested owner (an existing doc, or a proposed new one):' || chr(10) || chr(10) || string_agg(section, chr(10) ORDER BY doc) AS body FROM p GROUP BY 1""")
def gap_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = coverage.suggest_owners(coverage.symbol_coverage(A.symbols(spark, d), A.selections(spark, d), WAIVERS))
    return reports.gap_issues(rows.withColumn("repo", F.split("path", "/")[0]), "repo")


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY assignee ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE reason WHEN 'orphan' THEN 0 WHEN 'stale' THEN 1 ELSE 2 END, doc_id, coalesce(upstream_id, -1)) AS rank FROM items),
  o AS (SELECT assignee, count(*) AS n, count(DISTINCT doc_id) AS c FROM i GROUP BY 1)
  SELECT 0 AS part, NULL AS assignee, 0 AS assignee_order, 0 AS rank, '# Worklist — ' || count(*) || ' item(s) across ' || count(DISTINCT doc_id) || ' document(s), ' || (SELECT count(*) FROM o) || ' owner(s)' AS line FROM i
  UNION ALL SELECT 1, assignee, (assignee IS NULL)::INT, -1, '' FROM o UNION ALL SELECT 1, assignee, (assignee IS NULL)::INT, 0, '  ' || coalesce(assignee, '(unowned)') || ': ' || n || ' item(s) across ' || c || ' doc(s)' FROM o
  UNION ALL SELECT 1, assignee, (assignee IS NULL)::INT, rank::INT, '    [' || severity || '] ' || reason || ' ' || doc_id || coalesce(' → ' || upstream_id, '') || ' — ' || status FROM i""")
def worklist_report(spark: SparkSession, d: str) -> DataFrame:
    return documents.worklist_report(governance.ranked(_items(spark, d)))


@query(r"""WITH f AS (SELECT DISTINCT path FROM syms UNION SELECT '__init__.py' UNION SELECT 'solo.py'),
  y AS (SELECT path, name FROM syms WHERE name NOT LIKE '\_%' ESCAPE '\' AND NOT contains(name, '.') UNION ALL SELECT 'solo.py', 'run' UNION ALL SELECT '__init__.py', 'VERSION'),
  m AS (SELECT CASE WHEN path = 'solo.py' THEN 'solo' ELSE split_part(path, '/', 1) END AS module, path FROM f WHERE path <> '__init__.py'),
  g AS (SELECT lower(split_part(p_type, ' ', 1)) AS module, list(DISTINCT printf('FEAT-MOD-%03d', p_size)) AS x FROM part GROUP BY 1)
  SELECT m.module, min(m.path) AS path, coalesce(string_agg(DISTINCT y.name, ',' ORDER BY y.name), '') AS symbols, coalesce(array_to_string(list_sort(any_value(g.x)), ','), '') AS features FROM m LEFT JOIN y USING (path) LEFT JOIN g ON g.module = m.module GROUP BY 1""")
def module_index(spark: SparkSession, d: str) -> DataFrame:
    more = spark.sql("SELECT * FROM VALUES ('solo.py', 'run'), ('__init__.py', 'VERSION') AS t(path, name)")
    symbols = A.symbols(spark, d).select("path", "name").unionByName(more)
    features = A.raw(spark, d, "part").groupBy(F.format_string("FEAT-MOD-%03d", F.col("p_size").cast("long")).alias("feature_id")).agg(F.collect_set(F.lower(F.split("p_type", " ")[0])).alias("modules"))
    out = trace.module_index(symbols.select("path").distinct(), symbols, features)
    return out.select("module", "path", F.array_join("symbols", ",").alias("symbols"), F.array_join("features", ",").alias("features"))


@query(r"""WITH y AS (SELECT l_orderkey AS doc_id, 'f' || l_linenumber AS name, CASE WHEN l_orderkey % 2 = 0 THEN 'eng-guide' ELSE 'user-guide' END AS audience, '{"is_public":true,"kind":"function","name":"f' || l_linenumber || '","signature":"def f(a=\"' || l_returnflag || '\")"}' AS sig,
    CASE WHEN l_linenumber % 2 = 0 THEN '"line\n' || l_linestatus || '"' ELSE 'null' END AS doc, CASE WHEN l_linenumber % 3 = 0 THEN '"' || substr(sha256(l_partkey::VARCHAR), 1, 16) || '"' END AS body FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)),
  i AS (SELECT *, CASE WHEN audience = 'eng-guide' THEN '{' || coalesce('"body_hash":' || body || ',', '') || '"docstring":' || doc || ',' || substr(sig, 2) ELSE sig END AS item FROM y),
  a AS (SELECT doc_id, any_value(audience) AS audience, string_agg(item, ',' ORDER BY name, body) AS items, string_agg(sig, ',' ORDER BY name) AS sigs, string_agg('{"docstring":' || doc || ',"name":"' || name || '"}', ',' ORDER BY name) AS docs,
    string_agg('{"body_hash":' || body || ',"name":"' || name || '"}', ',' ORDER BY name) FILTER (body IS NOT NULL) AS bodies, count(DISTINCT name) AS anchors FROM i GROUP BY 1)
  SELECT doc_id, substr(sha256('{"audience":"' || audience || '","symbols":[' || items || ']}'), 1, 16) AS composite, substr(sha256('{"audience":"' || audience || '","symbols":[' || sigs || ']}'), 1, 16) AS signature,
    CASE WHEN audience = 'eng-guide' THEN substr(sha256('{"docstrings":[' || docs || ']}'), 1, 16) END AS docstring, CASE WHEN audience = 'eng-guide' AND bodies IS NOT NULL THEN substr(sha256('{"bodies":[' || bodies || ']}'), 1, 16) END AS body, anchors FROM a""")
def surface_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of the surfaces of all orders: whole, by tier and by symbol."""
    # dealt by document, so that all that follows happens where its lines are, in tasks of a bounded size
    lines = logs.spread(A.raw(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(x).alias(x) for x in ("l_returnflag", "l_linestatus", "l_partkey")])
    audience = F.when(F.col("l_orderkey") % 2 == 0, "eng-guide").otherwise("user-guide")
    symbols = lines.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("f"), "l_linenumber").alias("name"), F.lit("function").alias("kind"), F.concat(F.lit('def f(a="'), "l_returnflag", F.lit('")')).alias("signature"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("line\n"), "l_linestatus")).alias("docstring"), F.when(F.col("l_linenumber") % 3 == 0, X.short_hash(F.col("l_partkey").cast("string"))).alias("body_hash"),
    )
    audiences = lines.select(F.col("l_orderkey").alias("doc_id"), audience.alias("audience")).distinct()
    return surface.surface_fingerprints(symbols, audiences, include_body=True).withColumn("anchors", F.size("sigs").cast("long")).drop("sigs")


def _watched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents of whole texts with one region, whose surface has moved for every third; rules dismiss the move of every seventh."""
    n = F.col("doc_id")
    body = F.when(n % 2 == 0, "old").otherwise("new")
    text = F.concat(F.regexp_replace("text", "<!--", ""), F.lit("\n<!-- BEGIN a -->\n"), body, F.lit("\n<!-- END a -->\n"))
    docs = A.bodies(spark, d).where("text is not null").select("doc_id", text.alias("text"), F.when(n % 3 == 0, "was").otherwise("now").alias("stored"), F.lit("now").alias("current"), F.lit("eng-guide").alias("audience"), F.lit("signature").alias("detail"))
    mode = F.get(F.array(*[F.lit(m) for m in ("generated", "human", "llm-seeded")]), (F.floor(n / 6) % 3).cast("int"))
    stored = F.when(mode == "llm-seeded", F.when(F.floor(n / 18) % 2 == 0, "edited").otherwise(X.body_hash(body)))
    regions = docs.select("doc_id", F.lit("a").alias("region_id"), mode.alias("mode"), stored.alias("stored_hash"), F.lit("new").alias("expected"), F.lit(True).alias("known"), F.lit(True).alias("declared"))
    suspects = spark.createDataFrame([], "doc_id long, upstream_id long")
    rules = docs.where(n % 7 == 0).select("doc_id", F.lit("HASH").alias("kind"), "audience", F.lit("INVALIDATE").alias("verdict"))
    return docs, regions, suspects, rules


@query("""WITH m AS (SELECT doc_id, replace(text, '<!--', '') AS t, doc_id % 3 = 0 AS moved, doc_id % 2 = 0 AS differs, doc_id % 7 = 0 AS ruled, (doc_id // 6) % 3 AS mode, (doc_id // 18) % 2 = 0 AS edited FROM documents WHERE text IS NOT NULL),
  a AS (SELECT *, mode = 1 OR mode = 2 AND edited AS advisory FROM m)
  SELECT doc_id, t || chr(10) || '<!-- BEGIN a -->' || chr(10) || CASE WHEN differs AND advisory THEN 'old' ELSE 'new' END || chr(10) || '<!-- END a -->' || chr(10) AS text, CASE WHEN moved AND ruled THEN 'was' ELSE 'now' END AS stored,
    moved::BIGINT + (differs AND (moved OR NOT advisory))::BIGINT AS records, (moved AND NOT ruled)::BIGINT + (differs AND NOT advisory)::BIGINT AS applied, (moved AND ruled)::BIGINT + (differs AND advisory AND moved AND (ruled OR mode = 1))::BIGINT AS remaining FROM a""")
def monitor_run(spark: SparkSession, d: str) -> DataFrame:
    docs, _, found, left = monitor.run(*_watched(spark, d))
    told = found.groupBy("doc_id").agg(F.count("*").alias("records"), F.count_if("applied").alias("applied"))
    remaining = left.groupBy("doc_id").agg(F.count("*").alias("remaining"))
    return docs.select("doc_id", "text", "stored").join(told, "doc_id", "left").join(remaining, "doc_id", "left").fillna(0, ["records", "applied", "remaining"])


@query("""WITH i AS (SELECT * FROM items WHERE reason = 'stale') SELECT i.doc_id, reason, i.status, i.severity, o.accountable AS assignee FROM i JOIN owners o ON o.doc_id = i.doc_id""")
def worklist_without_roster(spark: SparkSession, d: str) -> DataFrame:
    """Items of a repository that has no roster, and of a hub."""
    owners = governance.effective_owners(A.doc_owners(spark, d))
    return governance.repo_worklist(owners, A.reviewed_docs(spark, d), A.NOW).select("doc_id", "reason", "status", "severity", "assignee")


@query("""WITH u AS (SELECT p_partkey % 50 AS unit, lower(replace(p_type, ' ', '/')) AS dir FROM part) SELECT dir, string_agg(DISTINCT 'u' || unit, ',' ORDER BY 'u' || unit) AS units FROM u GROUP BY 1 HAVING count(DISTINCT unit) > 1""")
def identical_directories(spark: SparkSession, d: str) -> DataFrame:
    """Directories of all parts' types in four spellings."""
    n, plain = F.col("p_partkey"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/")))
    dirs = F.when(n % 4 == 0, plain).when(n % 4 == 1, F.concat(F.lit("./"), plain, F.lit("/"))).when(n % 4 == 2, F.replace(plain, F.lit("/"), F.lit("//"))).otherwise(F.replace(plain, F.lit("/"), F.lit("\\")))
    units = A.raw(spark, d, "part").select(F.concat(F.lit("u"), n % 50).alias("unit"), dirs.alias("dir"))
    return documents.identical_directories(units).withColumn("units", F.array_join("units", ","))


@query(r"""WITH c AS (SELECT doc_id, list_sort(list(DISTINCT name) FILTER (split_part(name, '.', -1) NOT LIKE '\_%' ESCAPE '\')) AS names FROM chosen GROUP BY 1)
  SELECT doc_id, 'This eng-guide section is authored from the code surface (the single source of truth) and is re-authored whenever that surface changes. It covers the public API: '
    || CASE WHEN coalesce(len(names), 0) = 0 THEN 'no public symbols' ELSE '`' || array_to_string(names, '`, `') || '`' END || '.' AS prose FROM c""")
def authored_prose(spark: SparkSession, d: str) -> DataFrame:
    chosen = coverage.selected_symbols(A.symbols(spark, d), A.selections(spark, d))
    names = chosen.groupBy("doc_id").agg(F.collect_set(F.when(X.is_public(F.col("name")), F.col("name"))).alias("names"))
    return names.select("doc_id", X.authored_prose(F.lit("eng-guide"), F.col("names")).alias("prose"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS k, l_partkey % 9 AS a FROM lineitem), s AS (SELECT DISTINCT doc_id, 'a' || a AS anchor FROM l WHERE k % 3 = 0), d AS (SELECT DISTINCT doc_id FROM s), c AS (SELECT DISTINCT doc_id, 'a' || a AS anchor FROM l WHERE k % 3 = 1 OR a % 2 = 0)
  SELECT d.doc_id, coalesce((SELECT string_agg(anchor, ',' ORDER BY anchor) FROM c WHERE c.doc_id = d.doc_id AND anchor NOT IN (SELECT anchor FROM s WHERE s.doc_id = d.doc_id)), '') AS added,
    coalesce((SELECT string_agg(anchor, ',' ORDER BY anchor) FROM s WHERE s.doc_id = d.doc_id AND anchor NOT IN (SELECT anchor FROM c WHERE c.doc_id = d.doc_id)), '') AS removed FROM d""")
def anchor_changes(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of regions, stamped in every third and not stamped in others, against the current ones."""
    from docledger.operators import drift

    lines, k, a = A.raw(spark, d, "lineitem"), F.col("l_linenumber"), F.col("l_partkey") % 9
    anchor = F.concat(F.lit("a"), a)
    stamped = lines.groupBy(F.col("l_orderkey").alias("doc_id"), k.cast("string").alias("region_id")).agg(F.collect_set(F.when(k % 3 == 0, anchor)).alias("x")).select("doc_id", "region_id", F.when(F.size("x") > 0, F.col("x")).alias("anchors"))
    current = lines.where((k % 3 == 1) | (a % 2 == 0)).select(F.col("l_orderkey").alias("doc_id"), anchor.alias("anchor"))
    out = drift.anchor_changes(stamped, current)
    return out.select("doc_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query("""SELECT p_partkey AS n, p_name AS name, 'record' AS kind, p_size::VARCHAR AS size, 'a \\| ' || p_brand AS brand, '' AS none FROM part""")
def record_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of table rows of records: attributes, fields with a bar, and a field that there is none of."""
    fields = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.concat(F.lit("a | "), "p_brand"))
    at = lambda field: X.record_cell(field, F.col("p_name"), F.lit("record"), fields).alias(field)
    return A.raw(spark, d, "part").select(F.col("p_partkey").alias("n"), at("name"), at("kind"), at("size"), at("brand"), at("none"))
