"""Registered queries over the entity tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions import text as X
from docledger.operators import coverage, documents, drift, governance, graph, layout, records, store, trace
from docledger.plans.registry import query
from docledger.sources import adapters as A
from docledger.sources import logs

# Work to be done per owner: the flagship. Ownership, staleness and suspect links meet here.


def _items(spark: SparkSession, d: str) -> DataFrame:
    owners = governance.effective_owners(A.doc_owners(spark, d))
    suspects = graph.edge_status(A.doc_edges(spark, d), A.doc_hashes(spark, d), A.edge_stamps(spark, d))
    return governance.worklist_items(owners, governance.ownership(owners, A.roster(spark, d)), governance.staleness(A.reviewed_docs(spark, d), A.NOW), suspects)


@query("SELECT assignee, count(*) AS item_count, count(DISTINCT doc_id) AS doc_count, count(*) FILTER (severity = 'high') AS high_count FROM items GROUP BY assignee")
def worklist_queues(spark: SparkSession, d: str) -> DataFrame:
    return governance.worklist_queues(_items(spark, d))


@query("""SELECT assignee, row_number() OVER (PARTITION BY assignee ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
  CASE reason WHEN 'orphan' THEN 0 WHEN 'stale' THEN 1 ELSE 2 END, doc_id, coalesce(upstream_id, -1)) AS rank, doc_id, reason, status, severity, upstream_id FROM items""")
def worklist_items(spark: SparkSession, d: str) -> DataFrame:
    return governance.ranked(_items(spark, d))


@query("SELECT doc_id, status, age_days, sla_days FROM stale WHERE status <> 'fresh'")
def staleness_findings(spark: SparkSession, d: str) -> DataFrame:
    return governance.staleness(A.reviewed_docs(spark, d), A.NOW).select("doc_id", "status", "age_days", "sla_days")


@query("SELECT status, count(*) AS docs FROM stale GROUP BY status")
def staleness_summary(spark: SparkSession, d: str) -> DataFrame:
    return governance.staleness(A.reviewed_docs(spark, d), A.NOW, include_fresh=True).groupBy("status").agg(F.count("*").alias("docs"))


@query("SELECT doc_id, accountable, durable FROM owners")
def effective_owners(spark: SparkSession, d: str) -> DataFrame:
    return governance.effective_owners(A.doc_owners(spark, d)).select("doc_id", "accountable", "durable")


@query("SELECT doc_id, status, accountable FROM ownership WHERE status <> 'ok'")
def ownership_findings(spark: SparkSession, d: str) -> DataFrame:
    return governance.ownership(governance.effective_owners(A.doc_owners(spark, d)), A.roster(spark, d)).select("doc_id", "status", "accountable")


@query("SELECT status, count(*) AS docs FROM ownership GROUP BY status")
def ownership_summary(spark: SparkSession, d: str) -> DataFrame:
    return governance.ownership(governance.effective_owners(A.doc_owners(spark, d)), A.roster(spark, d), include_ok=True).groupBy("status").agg(F.count("*").alias("docs"))


# Records and resolutions.


@query("SELECT seq, record_id, doc_id, verdict FROM records WHERE verdict = 'FIX' AND audience = 'user-guide' ORDER BY seq LIMIT 50 OFFSET 20")
def records_page(spark: SparkSession, d: str) -> DataFrame:
    return records.page(A.records(spark, d), 20, 50, verdict="FIX", audience="user-guide", doc_id=None).select("seq", "record_id", "doc_id", "verdict")


@query("SELECT seq, record_id FROM records WHERE verdict = 'ESCALATE'")
def records_by_verdict(spark: SparkSession, d: str) -> DataFrame:
    return records.by_verdict(A.records(spark, d), "ESCALATE").select("seq", "record_id")


@query("""SELECT 'total' AS dimension, '' AS value, count(*) AS cnt FROM records UNION ALL SELECT 'verdict', verdict, count(*) FROM records GROUP BY verdict
  UNION ALL SELECT 'audience', audience, count(*) FROM records GROUP BY audience UNION ALL SELECT 'doc_id', doc_id, count(*) FROM records GROUP BY doc_id""")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    return records.log_summary(A.records(spark, d))


@query("SELECT coalesce(resolution, 'unresolved') AS resolution, count(*) AS cnt FROM records LEFT JOIN last_res USING (record_id) GROUP BY 1")
def log_resolution_summary(spark: SparkSession, d: str) -> DataFrame:
    return records.resolution_summary(A.records(spark, d), A.resolutions(spark, d))


@query("SELECT seq, record_id, resolution FROM resolutions WHERE record_id IN (SELECT record_id FROM records WHERE repo_id = 'repo-3')")
def repo_resolutions(spark: SparkSession, d: str) -> DataFrame:
    return records.of_records(A.resolutions(spark, d), A.records(spark, d).where("repo_id = 'repo-3'")).select("seq", "record_id", "resolution")


@query("SELECT record_id, doc_id FROM records WHERE record_id NOT IN (SELECT record_id FROM resolutions)")
def unresolved_records(spark: SparkSession, d: str) -> DataFrame:
    return records.unresolved(A.records(spark, d), A.resolutions(spark, d)).select("record_id", "doc_id")


def _repos(rows: DataFrame) -> DataFrame:
    return rows.select("repo_id").distinct()


_STATUS = """SELECT repo_id, count(*) AS total, count(*) FILTER (verdict = 'FIX') AS fix, count(*) FILTER (verdict = 'INVALIDATE') AS invalidate, count(*) FILTER (verdict = 'ESCALATE') AS escalate,
  count(*) FILTER (record_id NOT IN (SELECT record_id FROM resolutions)) AS unresolved, max(detected_at) AS last_detected_at, count(*) FILTER (verdict = 'ESCALATE') AS escalations,
  CASE WHEN count(*) FILTER (verdict = 'ESCALATE') > 0 THEN 'drift' WHEN count(*) FILTER (record_id NOT IN (SELECT record_id FROM resolutions)) > 0 THEN 'review' ELSE 'sync' END AS signal FROM records GROUP BY repo_id"""


@query(_STATUS)
def repo_status(spark: SparkSession, d: str) -> DataFrame:
    rows = A.records(spark, d)
    return records.repo_status(_repos(rows), rows, A.resolutions(spark, d))


@query(f"SELECT signal, count(*) AS repos, sum(escalations)::BIGINT AS escalations FROM ({_STATUS}) GROUP BY signal")
def fleet_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = A.records(spark, d)
    return records.fleet_rollup(records.repo_status(_repos(rows), rows, A.resolutions(spark, d)))


@query("""WITH h AS (SELECT r.repo_id, count(*) AS total, count(f.record_id) AS resolved, count(*) FILTER (r.verdict = 'ESCALATE') AS esc,
    sum(epoch_us(f.resolved_at) - epoch_us(r.detected_at)) AS us FROM records r LEFT JOIN first_res f ON f.record_id = r.record_id GROUP BY 1),
  o AS (SELECT repo_id, count(*) AS overrides FROM resolutions JOIN records USING (record_id) WHERE resolution = 'overridden' GROUP BY 1),
  m AS (SELECT h.*, coalesce(overrides, 0) AS overrides, CASE WHEN resolved > 0 THEN us::DOUBLE / resolved / 1e6 END AS mttr_seconds FROM h LEFT JOIN o USING (repo_id))
  SELECT repo_id, total, resolved, total - resolved AS unresolved, overrides, esc::DOUBLE / total AS escalation_rate, mttr_seconds,
  CASE WHEN mttr_seconds < 60 THEN floor(mttr_seconds + 0.5)::BIGINT || 's' WHEN mttr_seconds < 3600 THEN floor(mttr_seconds / 60 + 0.5)::BIGINT || 'm' WHEN mttr_seconds < 86400 THEN floor(mttr_seconds / 3600 + 0.5)::BIGINT || 'h' ELSE floor(mttr_seconds / 86400 + 0.5)::BIGINT || 'd' END AS mttr FROM m""")
def repo_health(spark: SparkSession, d: str) -> DataFrame:
    rows = A.records(spark, d)
    return records.repo_health(_repos(rows), rows, A.resolutions(spark, d))


@query("""WITH t AS (SELECT drift_kind, audience, count(*) AS cnt, count(*) FILTER (verdict = 'ESCALATE') AS escalations, count(*) FILTER (resolution = 'overridden') AS overrides
    FROM records LEFT JOIN first_res USING (record_id) GROUP BY 1, 2)
  SELECT *, escalations::DOUBLE / cnt AS escalation_rate, overrides::DOUBLE / cnt AS override_rate, row_number() OVER (ORDER BY escalations::DOUBLE / cnt DESC, overrides::DOUBLE / cnt DESC, drift_kind, audience) AS rank FROM t""")
def repo_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return records.telemetry(A.records(spark, d), A.resolutions(spark, d))


_PROMOTED = """SELECT doc_id, drift_kind, audience, count(*) AS cnt, min(resolution) AS resolution FROM records JOIN last_res USING (record_id) GROUP BY 1, 2, 3
  HAVING count(*) >= 3 AND count(DISTINCT resolution) = 1 AND min(resolution) IN ('invalidated', 'rejected')"""


@query(_PROMOTED)
def promotion_candidates(spark: SparkSession, d: str) -> DataFrame:
    return records.promotion_candidates(A.records(spark, d), A.resolutions(spark, d))


@query(f"SELECT record_id, 'INVALIDATE' AS rule_verdict FROM records JOIN ({_PROMOTED}) p USING (doc_id, drift_kind, audience)")
def rule_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = A.records(spark, d)
    return records.apply_rules(rows, records.to_rules(records.promotion_candidates(rows, A.resolutions(spark, d))))


@query("""WITH p AS (SELECT r.*, l.resolved_at FROM records r JOIN last_res l ON l.record_id = r.record_id),
  t AS (SELECT * FROM records WHERE record_id NOT IN (SELECT record_id FROM resolutions)),
  s AS (SELECT t.record_id AS target_id, p.record_id, 5 * (t.surface_hash = p.surface_hash)::INT + 3 * (t.doc_id = p.doc_id)::INT + 2 * (t.drift_kind = p.drift_kind)::INT + (t.audience = p.audience)::INT AS score, p.resolved_at
    FROM t JOIN p ON t.record_id <> p.record_id)
  SELECT target_id, record_id, score, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, resolved_at DESC, record_id) AS rank FROM s QUALIFY rank <= 3""")
def similar_records(spark: SparkSession, d: str) -> DataFrame:
    rows, res = A.records(spark, d), A.resolutions(spark, d)
    return records.similar(records.unresolved(rows, res), rows, res)


@query("SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS cnt FROM conversations GROUP BY 1")
def latest_per_conversation(spark: SparkSession, d: str) -> DataFrame:
    return records.ends_of(A.raw(spark, d, "conversations"), "conv_id", "turn")


# Dependencies between documents.


def _status(spark: SparkSession, d: str, ok: bool = False) -> DataFrame:
    return graph.edge_status(A.doc_edges(spark, d), A.doc_hashes(spark, d), A.edge_stamps(spark, d), ok)


@query("SELECT doc_id, upstream_id, status FROM edge_status WHERE status <> 'ok'")
def suspect_links(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d).select("doc_id", "upstream_id", "status")


@query("SELECT count(DISTINCT doc_id) AS docs, count(*) AS edges, count(*) FILTER (status <> 'ok') AS flagged FROM edge_status")
def dependency_report(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d, True).agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("edges"), F.count_if(F.col("status") != "ok").alias("flagged"))


@query("SELECT doc_id, upstream_id, coalesce(u, s) AS stamp, u IS NOT NULL AND u IS DISTINCT FROM s AS changed FROM (SELECT e.doc_id, e.upstream_id, h.body_hash AS u, t.stamp AS s FROM edges e JOIN hashes x ON x.doc_id = e.doc_id LEFT JOIN hashes h ON h.doc_id = e.upstream_id LEFT JOIN stamps t ON t.doc_id = e.doc_id AND t.upstream_id = e.upstream_id)")
def edge_restamp(spark: SparkSession, d: str) -> DataFrame:
    return graph.restamp(A.doc_edges(spark, d), A.doc_hashes(spark, d), A.edge_stamps(spark, d))


@query(r"""WITH m AS (SELECT path, max(page_id) AS upstream_id FROM (SELECT page_id, path FROM paths UNION ALL SELECT page_id, regexp_extract(html, 'href="/([^"#]+)"', 1) FROM pages) GROUP BY path),
  l AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link, unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS pos FROM pages),
  t AS (SELECT *, trim(trim(split_part(link, '#', 1)), '/') AS path FROM l WHERE NOT contains(split_part(link, '#', 1), '://') AND NOT starts_with(split_part(link, '#', 1), 'mailto:')),
  f AS (SELECT doc_id, upstream_id, link, pos FROM t JOIN m USING (path) WHERE path <> '' AND doc_id <> upstream_id AND upstream_id <> doc_id // 2)
  SELECT DISTINCT doc_id, upstream_id FROM f""")
def inferred_edges(spark: SparkSession, d: str) -> DataFrame:
    own = A.raw(spark, d, "pages").select("page_id", F.regexp_extract("html", 'href="/([^"#]+)"', 1).alias("path"))
    docs = A.paths(spark, d).unionByName(own).withColumnRenamed("page_id", "doc_id")
    declared = A.raw(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.floor(F.col("page_id") / 2).cast("long").alias("upstream_id"))
    # every other link is turned into one relative to its page's folder
    up = F.array_join(F.array_repeat(F.lit(".."), F.size(F.split("path", "/")) - 1), "/")
    relative = F.when((F.col("pos") % 2 == 1) & F.col("link").startswith("/"), F.concat(up, "link")).otherwise(F.col("link"))
    links = A.links(spark, d).join(A.paths(spark, d), "page_id").select(F.col("page_id").alias("doc_id"), "path", "pos", relative.alias("link"))
    return graph.inferred_edges(links, docs, declared).drop("via")


@query("SELECT DISTINCT doc_id FROM edges WHERE upstream_id = 10 AND doc_id <> 10")
def impact_direct(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependents(A.doc_edges(spark, d), spark.createDataFrame([(10,)], "doc_id long"), transitive=False)


@query("WITH r(doc_id) AS (SELECT 10::BIGINT UNION SELECT e.doc_id FROM edges e JOIN r ON e.upstream_id = r.doc_id) SELECT doc_id FROM r WHERE doc_id <> 10")
def impact_transitive(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependents(A.doc_edges(spark, d), spark.createDataFrame([(10,)], "doc_id long"))


@query("""WITH s AS (SELECT * FROM edge_status), r(doc_id) AS (SELECT doc_id FROM s WHERE status IN ('suspect', 'missing_upstream') UNION SELECT e.doc_id FROM edges e JOIN r ON e.upstream_id = r.doc_id)
  SELECT DISTINCT doc_id, upstream_id FROM edges WHERE doc_id IN (SELECT doc_id FROM r) AND upstream_id IN (SELECT doc_id FROM r) AND (doc_id, upstream_id) NOT IN (SELECT (doc_id, upstream_id) FROM s WHERE status <> 'ok')""")
def transitive_suspects(spark: SparkSession, d: str) -> DataFrame:
    return graph.transitive_suspects(A.doc_edges(spark, d), _status(spark, d, True))


# Coverage.

WAIVERS = [("economy/**", None, "legacy"), ("promo/*", "C1", "generated")]


@query(r"SELECT page_id, path FROM paths WHERE regexp_full_match(path, '(?:.*/)?[^/]*[1-6][^/]*') AND regexp_matches(path, '^(en|fr)/') AND NOT regexp_full_match(path, 'fr/[^/]*7')")
def glob_scan(spark: SparkSession, d: str) -> DataFrame:
    hits = coverage.effective_scope(A.paths(spark, d), ["en/**", "fr/**"], ["fr/*7"])
    return hits.where(X.matches_any(F.col("path"), [f"**/*{i}*" for i in range(1, 7)]))


@query(r"""WITH l AS (SELECT DISTINCT coalesce(['#', '!', '/', '', '', '*.'][k], '') || regexp_replace(word, '[^a-z/.*?]', '', 'g') || CASE WHEN k % 2 = 0 THEN '/' ELSE '' END AS line
    FROM (SELECT word, row_number() OVER (PARTITION BY doc_id ORDER BY pos) % 7 AS k FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents))),
  b AS (SELECT line, trim(line, '/') AS b, starts_with(line, '/') AS a, suffix(line, '/') AS dir, contains(trim(line, '/'), '/') AS s, regexp_matches(line, '[*?]') AS w
    FROM l WHERE trim(line) <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '!') AND trim(line, '/') <> '')
  SELECT line, unnest(CASE WHEN dir AND (a OR s) THEN [b || '/**'] WHEN dir THEN ['**/' || b || '/**'] WHEN a OR (s AND NOT w) THEN [b, b || '/**'] WHEN s THEN [b] WHEN w THEN ['**/' || b] ELSE ['**/' || b, '**/' || b || '/**'] END) AS glob FROM b""")
def gitignore_globs(spark: SparkSession, d: str) -> DataFrame:
    """Globs of ignore lines made of all words of all texts: plain ones, comments, negations, anchored ones, folders and wildcards."""
    words = A.bodies(spark, d).select(F.posexplode(F.split("text", " ")).alias("pos", "word"))
    k = (F.col("pos") + 1) % 7
    mark = F.coalesce(F.get(F.array(*[F.lit(x) for x in ("#", "!", "/", "", "", "*.")]), F.when(k > 0, k - 1)), F.lit(""))
    line = F.concat(mark, F.regexp_replace("word", "[^a-z/.*?]", ""), F.when(k % 2 == 0, "/").otherwise(""))
    return words.select(line.alias("line")).distinct().select("line", F.explode(X.ignore_globs(F.col("line"))).alias("glob"))


@query("SELECT path, coalesce(owners, '') AS owners, status FROM file_cov")
def coverage_files(spark: SparkSession, d: str) -> DataFrame:
    out = coverage.file_coverage(A.files(spark, d), A.code_refs(spark, d), WAIVERS)
    return out.select("path", F.array_join("owners", ",").alias("owners"), "status")


@query("""SELECT 'files' AS what, count(*) AS universe, count(*) FILTER (status = 'documented') AS documented, count(*) FILTER (status = 'undocumented') AS undocumented, count(*) FILTER (status = 'waived') AS waived,
  count(*) FILTER (status = 'documented')::DOUBLE / (count(*) - count(*) FILTER (status = 'waived')) * 100 AS percent FROM file_cov
  UNION ALL SELECT 'symbols', count(*), count(*) FILTER (status = 'documented'), count(*) FILTER (status = 'undocumented'), count(*) FILTER (status = 'waived'),
  count(*) FILTER (status = 'documented')::DOUBLE / (count(*) - count(*) FILTER (status = 'waived')) * 100 FROM sym_cov WHERE split_part(name, '.', -1) NOT LIKE '\\_%' ESCAPE '\\'""")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    f = coverage.file_coverage(A.files(spark, d), A.code_refs(spark, d), WAIVERS).select("status").withColumn("what", F.lit("files"))
    s = coverage.symbol_coverage(A.symbols(spark, d), A.selections(spark, d), WAIVERS).where("public").select("status").withColumn("what", F.lit("symbols"))
    out = coverage.summary(f.unionByName(s), "what")
    return out.withColumn("percent", coverage.percent(F.col("documented"), F.col("universe"), F.col("waived")))


@query("""WITH u AS (SELECT unnest(['economy', 'promo', 'small', 'nothing']) AS unit), c AS (SELECT split_part(path, '/', 1) AS unit, count(*) AS universe, count(*) FILTER (status = 'documented') AS documented,
    count(*) FILTER (status = 'undocumented') AS undocumented, count(*) FILTER (status = 'waived') AS waived FROM file_cov GROUP BY 1)
  SELECT u.unit, coalesce(universe, 0) AS universe, coalesce(documented, 0) AS documented, coalesce(undocumented, 0) AS undocumented, coalesce(waived, 0) AS waived,
  CASE WHEN universe - waived > 0 THEN floor((documented * 20000 + universe - waived) / (2.0 * (universe - waived))) / 100 END AS percent FROM u LEFT JOIN c USING (unit)""")
def coverage_by_unit(spark: SparkSession, d: str) -> DataFrame:
    names = ["economy", "promo", "small", "nothing"]
    dirs = spark.createDataFrame([(i, n, n) for i, n in enumerate(names)], "ord int, unit string, dir string")
    cov = coverage.file_coverage(A.files(spark, d).drop("unit"), A.code_refs(spark, d), WAIVERS)
    return coverage.by_unit(dirs.select("unit"), coverage.owning_unit(cov, dirs).select("owning_unit", "status", F.lit(1)))


@query("""SELECT s.path, s.name, s.lineno, coalesce(o.owner, replace(regexp_replace(s.path, '\\.py$', ''), '/', '-')) AS suggested_doc_id, o.owner IS NULL AS is_new_doc, coalesce('sibling symbols already in ' || o.owner, 'no doc references ' || s.path) AS reason
  FROM sym_cov s LEFT JOIN (SELECT path, min(owner) AS owner FROM sym_cov WHERE owner IS NOT NULL GROUP BY path) o ON o.path = s.path WHERE s.status = 'undocumented'""")
def owner_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return coverage.suggest_owners(coverage.symbol_coverage(A.symbols(spark, d), A.selections(spark, d), WAIVERS))


@query("""SELECT DISTINCT doc_id, path, name, kind, lineno FROM chosen WHERE (n % 2 <> 0 OR split_part(name, '.', -1) NOT LIKE '\\_%' ESCAPE '\\') AND (n % 8 <> 4 OR (kind = 'method' AND args = 'rf'))""")
def symbol_selection(spark: SparkSession, d: str) -> DataFrame:
    return coverage.selected_symbols(A.symbols(spark, d), A.selections(spark, d), surface=True).select("doc_id", "path", "name", "kind", "lineno").distinct()


@query("""WITH p AS (SELECT string_split(path, '/') AS x, status FROM file_cov), a AS (SELECT array_to_string(x[1:k], '/') AS dir, k AS depth, status FROM (SELECT x, status, unnest(range(1, len(x))) AS k FROM p))
  SELECT dir, depth::INT AS depth, count(*) FILTER (status = 'documented') AS documented, count(*) FILTER (status = 'undocumented') AS undocumented, count(*) FILTER (status = 'waived') AS waived FROM a GROUP BY 1, 2""")
def directory_rollup(spark: SparkSession, d: str) -> DataFrame:
    cov = coverage.file_coverage(A.files(spark, d), A.code_refs(spark, d), WAIVERS)
    return coverage.directory_rollup(cov, ("documented", "undocumented", "waived"))


# Texts.


@query(r"SELECT doc_id, substr(sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))), 1, 16) AS hash FROM documents")
def body_hash(spark: SparkSession, d: str) -> DataFrame:
    return A.bodies(spark, d).select("doc_id", X.body_hash(F.col("text")).alias("hash"))


@query("""WITH l AS (SELECT doc_id, pos, line, CASE WHEN pos % 5 = 1 THEN 'BEGIN' WHEN pos % 5 = 3 THEN 'END' END AS m FROM body_lines)
  SELECT b.doc_id, 'r' || (b.pos // 5) AS region_id, b.pos AS start, e.pos AS stop, coalesce(x.line, '') AS body, CASE WHEN e.pos IS NULL THEN 'unterminated' END AS problem
  FROM l b LEFT JOIN l e ON e.doc_id = b.doc_id AND e.pos = b.pos + 2 LEFT JOIN l x ON x.doc_id = b.doc_id AND x.pos = b.pos + 1 WHERE b.m = 'BEGIN'""")
def region_scan(spark: SparkSession, d: str) -> DataFrame:
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 1, F.concat(F.lit("<!-- BEGIN r"), F.floor(i / 5), F.lit(" -->"))).when(i % 5 == 3, F.concat(F.lit("<!-- END r"), F.floor(i / 5), F.lit(" -->"))).otherwise(x))
    return trace.regions(A.bodies(spark, d).select("doc_id", F.array_join(marked, "\n").alias("text"))).select("doc_id", "region_id", "start", "stop", "body", "problem")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Bodies with a line of tags behind them, of another case in every third, and none that is well-formed in every fifth."""
    n = F.col("doc_id")
    marker = F.when(n % 3 == 0, "FEATURES: ").otherwise("see Feature:  ")
    first = F.when(n % 5 == 0, F.lit("FEAT-EXTRACT-12")).otherwise(F.format_string("FEAT-EXTRACT-%03d", n % 30))
    tag = F.concat(marker, first, F.lit(", "), F.format_string("FEAT-CONFIGV2-%03d", n % 7), F.lit(" done; as in FEAT-PROSE-001\nFEAT-PROSE-002"))
    return A.bodies(spark, d).select("doc_id", F.concat(F.translate("text", "\r\v\f", "   "), F.lit("\n"), tag).alias("text"))


_TAGS = "SELECT doc_id, len(string_split(text, chr(10))) + 1 AS line, unnest(list_concat(CASE WHEN doc_id % 5 = 0 THEN [] ELSE [printf('FEAT-EXTRACT-%03d', doc_id % 30)] END, [printf('FEAT-CONFIGV2-%03d', doc_id % 7)])) AS feature_id FROM documents WHERE text IS NOT NULL"


@query(_TAGS)
def tag_scan(spark: SparkSession, d: str) -> DataFrame:
    return trace.tags(_tagged(spark, d)).select("doc_id", F.col("line").cast("long").alias("line"), "feature_id")


@query(f"""WITH e AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'test' ELSE 'demo' END AS kind FROM ({_TAGS})),
  g AS (SELECT feature_id, bool_or(kind = 'test') AS t, bool_or(kind = 'demo') AS m, count(DISTINCT doc_id) AS n FROM e GROUP BY 1), f AS (SELECT printf('FEAT-EXTRACT-%03d', i) AS feature_id FROM range(40) r(i))
  SELECT coalesce(f.feature_id, g.feature_id) AS feature_id, coalesce(t, false) AS has_test, coalesce(m, false) AS has_demo, coalesce(n, 0) AS n_paths,
  CASE WHEN f.feature_id IS NULL THEN 'unknown' WHEN NOT coalesce(t, false) THEN 'no_test' WHEN NOT coalesce(m, false) THEN 'no_demo' ELSE 'complete' END AS status FROM f FULL JOIN g ON f.feature_id = g.feature_id""")
def trace_matrix(spark: SparkSession, d: str) -> DataFrame:
    refs = trace.tags(_tagged(spark, d)).select("feature_id", F.when(F.col("doc_id") % 2 == 0, "test").otherwise("demo").alias("kind"), F.col("doc_id").alias("path"))
    features = spark.range(40).select(F.format_string("FEAT-EXTRACT-%03d", "id").alias("feature_id"))
    return trace.trace_matrix(features, refs)


@query("""WITH f AS (SELECT unnest(['F-1', 'F-1', 'F-2', 'F-3']) AS feature_id, unnest(['economy', 'promo', 'economy', 'absent']) AS module),
  n AS (SELECT module, count(DISTINCT feature_id) AS k FROM f GROUP BY 1),
  s AS (SELECT split_part(path, '/', 1) AS module, min(path) AS first_path, count(DISTINCT name) AS c FROM syms WHERE name NOT LIKE '\\_%' ESCAPE '\\' AND NOT contains(name, '.') GROUP BY 1)
  SELECT coalesce(s.module, n.module) AS module, first_path, coalesce(c, 0) AS n_symbols, coalesce(k, 0) AS n_features FROM s FULL JOIN n ON s.module = n.module""")
def source_index(spark: SparkSession, d: str) -> DataFrame:
    features = spark.createDataFrame([("F-1", ["economy", "promo"]), ("F-2", ["economy"]), ("F-3", ["absent"])], "feature_id string, modules array<string>")
    return trace.source_index(A.symbols(spark, d), features)


def _surface(spark: SparkSession, d: str, edited: bool) -> DataFrame:
    """Order lines as symbols of their order's document; the edited surface lacks some, has others, and changes signatures."""
    lines = A.raw(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") % 10)
    if edited:
        lines = lines.where("NOT (k = 1 AND l_linenumber = 1) AND k <> 9")
    elif not edited:
        lines = lines.where("NOT (k = 2 AND l_linenumber = 1)")
    mark = F.when(F.lit(edited) & (F.col("k") == 3) & (F.col("l_linenumber") == 1), "!").otherwise("")
    body = F.when(F.lit(edited) & (F.col("k") == 4), "new").otherwise("old")
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), "l_linenumber").alias("name"), F.concat(F.lit("def f("), "l_returnflag", mark, F.lit(")")).alias("signature"), F.lit("doc").alias("docstring"), body.alias("body_hash"), F.col("l_linenumber").alias("lineno"))


@query("""WITH o AS (SELECT l_orderkey AS doc_id, l_orderkey % 10 AS k, count(DISTINCT l_linenumber) AS n, bool_or(l_linenumber = 1) AS one FROM lineitem GROUP BY 1, 2),
  x AS (SELECT *, CASE WHEN k = 9 THEN 'MISSING_DOC' ELSE 'HASH' END AS kind FROM o WHERE k = 9 OR k = 4 OR (k IN (1, 2, 3) AND one))
  SELECT doc_id, CASE WHEN k = 1 AND n = 1 THEN 'MISSING_DOC' ELSE kind END AS kind, (k = 2)::INT AS n_added, (k = 1 AND n > 1)::INT AS n_removed, (k = 3)::INT AS n_changed,
  CASE WHEN k = 9 OR (k = 1 AND n = 1) THEN 'breaking' WHEN k = 1 OR k = 3 THEN 'breaking' WHEN k = 2 THEN 'additive' ELSE 'cosmetic' END AS severity FROM x WHERE NOT (k = 2 AND n = 1)""")
def drift_severity(spark: SparkSession, d: str) -> DataFrame:
    out = drift.compare(drift.fingerprints(_surface(spark, d, False)), drift.fingerprints(_surface(spark, d, True)))
    return out.select("doc_id", "kind", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"), F.size("changed").alias("n_changed"), "severity")


@query("""WITH d AS (SELECT page_id AS n, page_id % 40 AS repo_id, CASE WHEN page_id < 40 THEN 'docs/index.md' WHEN page_id % 3 = 0 THEN 'docs/p' || page_id || '.md' ELSE 'x/p' || page_id || '.md' END AS path, CASE WHEN page_id % 4 < 2 THEN 'a' ELSE 'b' END AS audience FROM pages)
  SELECT d.repo_id, i.n AS doc_id, d.n AS missing_id, CASE WHEN d.n % 3 <> 0 THEN '../x/p' ELSE 'p' END || d.n || CASE WHEN d.n % 2 = 0 THEN '.html' ELSE '.md' END AS link FROM d JOIN d i ON i.repo_id = d.repo_id AND i.n < 40
  WHERE d.n >= 40 AND (i.n % 2 = 0 OR d.audience = 'a') AND NOT (d.n % 7 = 0 OR d.n % 7 = 1 AND d.n % 2 = 0 OR d.n % 7 = 2)""")
def index_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Documents that their repository's index lacks: by sources, derived pages and words around a link; half of the indexes list one audience."""
    n = F.col("page_id")
    plain = F.when(n % 3 == 0, F.concat(F.lit("p"), n)).otherwise(F.concat(F.lit("../x/p"), n))
    path = F.when(n < 40, "docs/index.md").when(n % 3 == 0, F.concat(F.lit("docs/p"), n, F.lit(".md"))).otherwise(F.concat(F.lit("x/p"), n, F.lit(".md")))
    docs = A.raw(spark, d, "pages").select((n % 40).alias("repo_id"), n.alias("doc_id"), path.alias("path"), F.when(n % 4 < 2, "a").otherwise("b").alias("audience"), (n % 2 == 0).alias("html"), (n < 40).alias("index"), F.when(n % 2 == 1, F.array(F.lit("a"))).alias("kinds"), plain.alias("plain"))
    mark = F.when(n % 7 == 0, F.concat(F.lit("["), n, F.lit("]("), "plain", F.lit(".md)"))).when((n % 7 == 1) & (n % 2 == 0), F.concat(F.lit("see "), "plain", F.lit(".html."))).when(n % 7 == 2, F.concat(F.lit("x=/"), "plain", F.lit(".md-")))
    text = docs.withColumn("page_id", F.col("doc_id")).groupBy("repo_id").agg(F.concat(F.lit("---\na: p40.md\n---\n"), F.array_join(F.collect_list(mark), " ")).alias("text"))
    return layout.index_gaps(docs.join(text, "repo_id").drop("plain"))


@query("""SELECT page_id AS doc_id, path FROM paths WHERE page_id % 3 <> 0""")
def index_completeness(spark: SparkSession, d: str) -> DataFrame:
    docs = A.paths(spark, d).select(F.col("page_id").alias("doc_id"), F.lit("eng-guide").alias("audience"), F.concat("path", F.lit("-"), "page_id").alias("path"), F.col("path").alias("plain"))
    index = docs.where("doc_id % 3 = 0").select("audience", F.concat(F.lit("- ["), "doc_id", F.lit("]("), "path", F.lit(")")).alias("text"))
    return drift.unlinked(index, docs).select("doc_id", F.col("plain").alias("path"))


# Mutations.


@query("""SELECT o_custkey AS repo_id, o_orderstatus AS sync_kind, o_orderkey AS doc_id FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0))
  UNION ALL SELECT o_custkey, 'F', o_orderkey + 1000000 FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0""")
def scope_replace(spark: SparkSession, d: str) -> DataFrame:
    o = A.raw(spark, d, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderstatus").alias("sync_kind"), F.col("o_orderkey").alias("doc_id"))
    new = o.where("sync_kind = 'F' AND repo_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    return store.replace_scope(o, new, ("repo_id", "sync_kind"))


@query("""SELECT event_id AS edit_id, CASE WHEN event_id % 2 = 0 AND event_type = 'error' THEN 'applied' WHEN event_id % 2 = 0 THEN 'pending' ELSE 'staged' END AS status, CASE WHEN event_id % 2 = 0 AND event_type = 'error' THEN 'now' END AS applied_at FROM events""")
def apply_edits(spark: SparkSession, d: str) -> DataFrame:
    e = A.raw(spark, d, "events")
    edits = e.select(F.col("event_id").alias("edit_id"), F.when(F.col("event_id") % 2 == 0, "pending").otherwise("staged").alias("status"), F.lit(None).cast("string").alias("applied_at"))
    return store.mark_edits(edits, e.where("event_type = 'error'").select(F.col("event_id").alias("edit_id")), "applied", "now")


# Configured documents.


@query("""SELECT 'doc-' || s_suppkey AS doc_id, coalesce(string_agg(path, ',' ORDER BY path), '') AS paths FROM supplier LEFT JOIN refs ON doc_id = 'doc-' || s_suppkey GROUP BY 1""")
def document_tree(spark: SparkSession, d: str) -> DataFrame:
    docs = A.raw(spark, d, "supplier").select(F.concat(F.lit("doc-"), "s_suppkey").alias("doc_id"))
    return documents.tree(docs, A.code_refs(spark, d)).select("doc_id", F.array_join("paths", ",").alias("paths"))


@query("SELECT l_orderkey AS change_id, bool_or(l_partkey % 3 <> 0) AS should_sync FROM lineitem GROUP BY 1")
def loop_guard(spark: SparkSession, d: str) -> DataFrame:
    changes = A.raw(spark, d, "lineitem").select(F.col("l_orderkey").alias("change_id"), F.col("l_partkey").cast("string").alias("path"))
    managed = A.raw(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("path"))
    return documents.loop_guard(changes, managed)


_SCOPED = "SELECT o_custkey AS repo_id, CASE WHEN o_orderkey % 4 = 0 THEN 'git' ELSE 'local' END AS sync_kind, o_orderkey AS doc_id FROM orders"


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    o = A.raw(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("repo_id"), F.when(F.col("o_orderkey") % 4 == 0, "git").otherwise("local").alias("sync_kind"), F.col("o_orderkey").alias("doc_id"))


@query(f"WITH s AS ({_SCOPED}), g AS (SELECT DISTINCT repo_id FROM s WHERE sync_kind = 'git') SELECT * FROM s WHERE (sync_kind = 'git') = (repo_id IN (SELECT repo_id FROM g))")
def scope_pick(spark: SparkSession, d: str) -> DataFrame:
    return documents.pick_scope(_scoped(spark, d))


@query("SELECT o_custkey AS repo_id, max(o_orderkey) AS seq, arg_max(o_totalprice, o_orderkey) AS ratio, arg_max(o_orderdate, o_orderkey) AS captured_at FROM orders GROUP BY 1")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    o = A.raw(spark, d, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("ratio"), F.col("o_orderdate").alias("captured_at"))
    return documents.latest(o, "repo_id")


@query("SELECT o_custkey AS doc_id, min(o_orderkey) AS seq, arg_min(o_orderstatus, o_orderkey) AS sync_kind FROM orders GROUP BY 1")
def first_document(spark: SparkSession, d: str) -> DataFrame:
    o = A.raw(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("sync_kind"))
    return documents.first_per_doc(o)


@query("""WITH c AS (SELECT repo_id, count(*) AS drifts, count(*) FILTER (drift_kind = 'HASH') AS hash, count(*) FILTER (drift_kind = 'REGION') AS region FROM records WHERE verdict = 'ESCALATE' AND repo_id <> 'repo-2' GROUP BY 1),
  r AS (SELECT 'repo-' || i AS repo_id, CASE WHEN i % 2 = 0 THEN 'git' ELSE 'local' END AS mode, i % 3 AS ahead FROM range(12) t(i))
  SELECT repo_id, mode, ahead, coalesce(drifts, 0) AS drifts, coalesce(hash, 0) AS hash, coalesce(region, 0) AS region, drifts IS NULL AS ok, drifts IS NULL AND (mode = 'git' OR ahead = 0) AS fully_synced FROM r LEFT JOIN c USING (repo_id)""")
def sync_summary(spark: SparkSession, d: str) -> DataFrame:
    drifts = A.records(spark, d).where("verdict = 'ESCALATE' and repo_id <> 'repo-2'").select("repo_id", F.col("drift_kind").alias("kind"))
    repos = spark.range(12).select(F.concat(F.lit("repo-"), "id").alias("repo_id"), F.when(F.col("id") % 2 == 0, "git").otherwise("local").alias("mode"), (F.col("id") % 3).alias("ahead"))
    return documents.sync_summary(drifts, repos, ("HASH", "REGION"))


@query("""SELECT 'duplicate_doc' AS problem, l_orderkey::VARCHAR AS subject FROM lineitem GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'dangling_upstream', (o_orderkey + 3)::VARCHAR FROM orders WHERE o_orderkey + 3 NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT 'unindexed_unit', r_name FROM region WHERE r_regionkey > 2 UNION ALL SELECT 'missing_unit', 'nowhere'""")
def config_problems(spark: SparkSession, d: str) -> DataFrame:
    docs = A.raw(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    edges = A.raw(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") + 3).alias("upstream_id"))
    regions = A.raw(spark, d, "region")
    listed = regions.where("r_regionkey <= 2").select(F.col("r_name").alias("unit")).union(spark.createDataFrame([("nowhere",)], "unit string"))
    return documents.config_problems(docs, edges, regions.select(F.col("r_name").alias("unit")), listed)


@query("""SELECT record_id, CASE WHEN verdict = 'ESCALATE' OR drift_kind IN ('UNHEALABLE', 'MISSING_DOC') THEN 'high' WHEN verdict = 'INVALIDATE' THEN 'low' ELSE 'medium' END AS severity,
  CASE verdict WHEN 'INVALIDATE' THEN 'dismiss' WHEN 'ESCALATE' THEN 'escalate' ELSE 'apply' END AS action,
  CASE WHEN drift_kind = 'REGION' AND (seq % 2 = 0 OR seq % 3 = 0) THEN 'FIX' WHEN drift_kind = 'HASH' AND audience = 'user-guide' AND seq % 7 = 0 THEN 'INVALIDATE' WHEN drift_kind = 'HASH' THEN 'FIX' ELSE 'ESCALATE' END AS offline FROM records""")
def tickets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    severity, action = documents.ticket(c("verdict"), c("drift_kind"), c("drift_kind") != "MISSING_DOC")
    detail = F.when(c("seq") % 7 == 0, "a Docstring moved").otherwise("signature")
    offline = documents.offline_verdict(c("drift_kind"), c("audience"), detail, c("seq") % 2 == 0, F.when(c("seq") % 3 == 0, "llm").otherwise("generated"))
    return A.records(spark, d).select("record_id", severity.alias("severity"), action.alias("action"), offline.alias("offline"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'owner: o' || (doc_id % 9) || chr(10) END AS header, substr(sha256(text), 1, 16) AS hash FROM documents""")
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\nowner: o"), F.col("doc_id") % 9, F.lit("\n---\n"))).otherwise("")
    return documents.front_matter(A.bodies(spark, d).select("doc_id", F.concat(head, "text").alias("text"))).select("doc_id", "header", "hash")


@query("""WITH s AS (SELECT doc_id, pos, coalesce(nullif(trim(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'section') AS base FROM body_lines),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY pos) - 1 AS k FROM s) SELECT doc_id, pos, CASE WHEN k = 0 THEN base ELSE base || '-' || k END AS slug FROM n""")
def heading_slugs(spark: SparkSession, d: str) -> DataFrame:
    lines = A.bodies(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return documents.heading_slugs(lines.select("doc_id", "pos", F.col("line").alias("heading"))).select("doc_id", "pos", "slug")


@query("SELECT path FROM files WHERE starts_with(path, 'economy/') ORDER BY path LIMIT 200")
def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 ignored files by path: the cap is the feature."""
    return A.files(spark, d).where(F.col("path").rlike(X.glob_regex("economy/**"))).select("path").orderBy("path").limit(200)


@query("""SELECT 'verdict' AS dimension, verdict AS value, count(*) AS cnt FROM records GROUP BY 2 UNION ALL SELECT 'audience', audience, count(*) FROM records GROUP BY 2 UNION ALL SELECT 'doc_id', doc_id, count(*) FROM records GROUP BY 2
  UNION ALL SELECT 'total', '', count(*) FROM records UNION ALL SELECT 'resolution', coalesce(resolution, 'unresolved'), count(*) FROM records LEFT JOIN last_res USING (record_id) GROUP BY 2""")
def report_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = A.records(spark, d)
    resolved = records.resolution_summary(rows, A.resolutions(spark, d)).select(F.lit("resolution").alias("dimension"), F.col("resolution").alias("value"), "cnt")
    return records.log_summary(rows).unionByName(resolved)


# Python sources and canonical JSON.


@query(r"""SELECT event_id, substr(sha256('{"k":' || regexp_extract(props, '[0-9]+') || ',"z":[1,{"a":"\u00e9","b":true},null]}'), 1, 16) AS digest FROM events""")
def canonical_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of JSON whose keys are out of order, with spaces, nesting, a null and a letter beyond ASCII."""
    text = F.concat(F.lit('{"z": [1, {"b": true, "a": "é"}, null], '), F.substring("props", 2, 1 << 30))
    return A.raw(spark, d, "events").select("event_id", logs.canonical_hash(text).alias("digest"))


def _modules(spark: SparkSession, d: str) -> DataFrame:
    """A module per part: a class with a documented method and a constant; every fourth is no Python file."""
    n, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    source = F.concat(F.lit("class P"), n, F.lit("(Base, metaclass=M):\n    def price(self, qty: int=3, *, tax=None) -> int:\n        'Price.'\n        return qty * "), size, F.lit("  # each\nSIZE: int = "), size)
    return A.raw(spark, d, "part").select(F.concat(F.lit("p"), n, F.when(n.cast("long") % 4 == 0, ".txt").otherwise(".py")).alias("path"), source.alias("text"))


@query(r"""WITH p AS (SELECT 'p' || p_partkey || '.py' AS path, p_partkey AS n, p_size AS k FROM part WHERE p_partkey % 4 <> 0)
  SELECT path, 'P' || n AS name, 'class' AS kind, 'class P' || n || '(Base, metaclass=M)' AS signature, 1 AS lineno, 4 AS end_lineno, NULL AS docstring, '' AS arg_names, NULL AS body_hash FROM p
  UNION ALL SELECT path, 'P' || n || '.price', 'method', 'def price(self, qty: int = 3, *, tax=None) -> int', 2, 4, 'Price.', 'self,qty', substr(sha256('Return(value=BinOp(left=Name(id=''qty'', ctx=Load()), op=Mult(), right=Constant(value=' || k || ')))'), 1, 16) FROM p
  UNION ALL SELECT path, 'SIZE', 'variable', 'SIZE: int = ' || k, 5, 5, NULL, '', NULL FROM p""")
def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    return logs.python_symbols(_modules(spark, d).where("path like '%.py'")).withColumn("arg_names", F.array_join("arg_names", ","))


@query("""SELECT 'p' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '.txt' ELSE '.py' END AS path, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'P' || p_partkey || ',P' || p_partkey || '.price,SIZE' END AS symbols FROM part""")
def symbol_inventory(spark: SparkSession, d: str) -> DataFrame:
    return logs.symbol_inventory(_modules(spark, d)).withColumn("symbols", F.array_join("symbols", ","))
