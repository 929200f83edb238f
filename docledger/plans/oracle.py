"""Entity tables as DuckDB common table expressions, for the SQL counterparts of the queries."""

ENTITIES = {
    "records": """SELECT event_id AS seq, 'repo-' || (user_id % 8) AS repo_id, event_id::VARCHAR AS record_id, 'doc-' || user_id AS doc_id,
  CASE WHEN user_id % 2 = 0 THEN 'user-guide' ELSE 'eng-guide' END AS audience,
  ['HASH','REGION','MISSING_DOC','UNHEALABLE','SUSPECT_LINK'][(event_id % 5 + 1)::INT] AS drift_kind,
  CASE event_type WHEN 'error' THEN 'ESCALATE' WHEN 'signup' THEN 'INVALIDATE' ELSE 'FIX' END AS verdict,
  substr(sha256(props), 1, 16) AS surface_hash, ts AS detected_at FROM events""",
    "resolutions": """SELECT 2 * event_id AS seq, event_id::VARCHAR AS record_id,
  CASE WHEN event_id % 11 = 0 THEN 'overridden' ELSE ['accepted','rejected','invalidated','overridden'][((user_id + event_id % 5) % 4 + 1)::INT] END AS resolution,
  ts + INTERVAL 30 MINUTE AS resolved_at FROM events WHERE event_id % 3 <> 0
  UNION ALL SELECT 2 * event_id + 1, event_id::VARCHAR, 'rejected', ts + INTERVAL 90 MINUTE FROM events WHERE event_id % 3 <> 0 AND event_id % 21 = 1""",
    "last_res": "SELECT * FROM resolutions QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq DESC) = 1",
    "first_res": "SELECT * FROM resolutions QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq) = 1",
    "repos": "SELECT DISTINCT repo_id FROM records",
    "reviewed": """SELECT c_custkey AS doc_id, c_mktsegment AS audience, r.reviewed,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 60 WHEN 'BUILDING' THEN 120 WHEN 'MACHINERY' THEN 30 ELSE 90 END AS sla_days
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS reviewed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) r ON o_custkey = c_custkey""",
    "stale": """SELECT *, CASE WHEN reviewed IS NULL THEN 'never_reviewed' WHEN age_days > sla_days THEN 'stale' ELSE 'fresh' END AS status
  FROM (SELECT *, CASE WHEN reviewed IS NOT NULL THEN greatest(0, floor((epoch_us(TIMESTAMP '1998-08-01') - epoch_us(reviewed)) / 86400000000.0))::INT END AS age_days FROM reviewed)""",
    "owners": """SELECT *, coalesce(nullif(dri, ''), nullif(owner, ''), nullif(team, '')) AS accountable, coalesce(nullif(team, ''), nullif(owner, '')) AS durable FROM (
  SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'owner-' || (c_custkey % 50) END AS owner,
  CASE WHEN c_custkey % 4 = 0 THEN n_name END AS team, CASE WHEN c_acctbal >= 5000 THEN c_name END AS dri
  FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "roster": """SELECT n_name AS name, n_nationkey % 3 <> 0 AS active FROM nation UNION ALL SELECT 'owner-' || i, i % 5 <> 0 FROM range(40) t(i)
  UNION ALL SELECT c_name, c_custkey % 2 = 0 FROM customer""",
    "ownership": """SELECT o.*, CASE WHEN accountable IS NULL THEN 'unowned' WHEN a.active THEN 'ok' WHEN durable <> accountable AND d.active THEN 'orphan_dri_vacant' ELSE 'orphan_owner_departed' END AS status
  FROM owners o LEFT JOIN roster a ON a.name = accountable LEFT JOIN roster d ON d.name = durable""",
    "edges": "SELECT c_custkey AS doc_id, c_custkey // 2 AS upstream_id FROM customer WHERE c_custkey > 1 UNION ALL SELECT 5, 40",
    "hashes": "SELECT c_custkey AS doc_id, substr(sha256(c_name), 1, 16) AS body_hash FROM customer WHERE c_custkey % 10 <> 7",
    "stamps": "SELECT e.doc_id, e.upstream_id, substr(sha256(CASE WHEN e.doc_id % 7 = 0 THEN c_name || ' old' ELSE c_name END), 1, 16) AS stamp FROM edges e JOIN customer ON c_custkey = e.upstream_id WHERE e.doc_id % 5 <> 0",
    "edge_status": """SELECT e.doc_id, e.upstream_id, CASE WHEN u.body_hash IS NULL THEN 'missing_upstream' WHEN s.stamp IS NULL THEN 'unstamped' WHEN s.stamp <> u.body_hash THEN 'suspect' ELSE 'ok' END AS status
  FROM edges e JOIN hashes d ON d.doc_id = e.doc_id LEFT JOIN hashes u ON u.doc_id = e.upstream_id LEFT JOIN stamps s ON s.doc_id = e.doc_id AND s.upstream_id = e.upstream_id""",
    "items": """SELECT i.*, CASE WHEN m.status = 'orphan_dri_vacant' THEN m.durable WHEN m.status = 'orphan_owner_departed' THEN NULL ELSE o.accountable END AS assignee,
  CASE WHEN i.status IN ('orphan_owner_departed','never_reviewed','suspect','missing_upstream') THEN 'high' WHEN i.status = 'unstamped' THEN 'low' ELSE 'medium' END AS severity FROM (
  SELECT doc_id, 'orphan' AS reason, status, NULL::BIGINT AS upstream_id FROM ownership WHERE status <> 'ok'
  UNION ALL SELECT doc_id, 'stale', status, NULL FROM stale WHERE status <> 'fresh'
  UNION ALL SELECT doc_id, 'suspect', status, upstream_id FROM edge_status WHERE status <> 'ok') i
  LEFT JOIN owners o ON o.doc_id = i.doc_id LEFT JOIN (SELECT doc_id, status, durable FROM ownership WHERE status LIKE 'orphan%') m ON m.doc_id = i.doc_id""",
    "files": "SELECT replace(lower(p_type), ' ', '/') || '/part_' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '.txt' ELSE '.py' END AS path, p_partkey AS file_id, p_type AS unit FROM part",
    "refs": "SELECT DISTINCT 'doc-' || l_suppkey AS doc_id, path FROM lineitem JOIN files ON file_id = l_partkey WHERE l_returnflag = 'R' AND l_quantity > 45",
    "file_cov": """SELECT f.path, f.unit, r.owners, CASE WHEN r.owners IS NOT NULL THEN 'documented' WHEN starts_with(f.path, 'economy/') THEN 'waived' ELSE 'undocumented' END AS status
  FROM files f LEFT JOIN (SELECT path, string_agg(doc_id, ',' ORDER BY doc_id) AS owners FROM refs GROUP BY path) r USING (path)""",
    "syms": """SELECT path, CASE WHEN l_orderkey % 5 = 0 THEN '_' ELSE '' END || 'C' || (l_suppkey % 7) || CASE WHEN l_linenumber % 2 = 0 THEN '.m' || l_linenumber ELSE '' END AS name,
  CASE WHEN l_linenumber % 2 = 0 THEN 'method' WHEN l_linenumber % 3 = 0 THEN 'variable' ELSE 'class' END AS kind, l_orderkey::INT AS lineno, (l_orderkey + l_linenumber)::INT AS end_lineno,
  lower(l_returnflag) || lower(l_linestatus) AS args FROM lineitem JOIN files ON file_id = l_partkey WHERE l_quantity >= 40""",
    "chosen": """SELECT DISTINCT r.doc_id, r.n, s.* FROM syms s JOIN (SELECT *, substr(doc_id, 5)::BIGINT AS n FROM refs) r USING (path) WHERE CASE r.n % 4
  WHEN 0 THEN s.name = 'C' || (r.n % 7) OR split_part(s.name, '.', 1) = 'C' || (r.n % 7)
  WHEN 1 THEN s.kind = 'variable' AND s.name IN ('C' || (r.n % 7), 'C0') WHEN 2 THEN s.lineno <= 2000 AND s.end_lineno >= 1 ELSE true END""",
    "sym_cov": """SELECT s.*, c.owner, CASE WHEN c.owner IS NOT NULL THEN 'documented' WHEN split_part(s.name, '.', -1) LIKE '\\_%' ESCAPE '\\' THEN 'private' WHEN starts_with(s.path, 'economy/') THEN 'waived' WHEN starts_with(s.path, 'promo/') AND s.name = 'C1' THEN 'waived' ELSE 'undocumented' END AS status
  FROM syms s LEFT JOIN (SELECT path, name, kind, lineno, min(doc_id) AS owner FROM chosen GROUP BY ALL) c ON c.path = s.path AND c.name = s.name AND c.kind = s.kind AND c.lineno = s.lineno""",
    "paths": r"SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages",
    "body_lines": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS pos FROM documents",
}


def sql(query: str) -> str:
    """A query with the entities that it names, and those they name, before it."""
    import re

    needed: list[str] = []

    def need(text: str) -> None:
        for name in ENTITIES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need(ENTITIES[name])
                needed.append(name)

    need(query)
    tables = ", ".join(f"{n} AS ({ENTITIES[n]})" for n in dict.fromkeys(needed))
    if not tables:
        return query
    return f"WITH RECURSIVE {tables}, {query[5:].lstrip()}" if query.startswith("WITH ") else f"WITH RECURSIVE {tables} {query}"
