"""Registered queries over changes in order: edits, registrations, the roster. Their SQL applies one change after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.operators import edits, patches, store
from docledger.plans.registry import query
from docledger.sources import adapters as A


def _clerk() -> Column:
    return F.concat(F.lit("clerk-"), F.col("o_orderkey") % 50)


def _group() -> Column:
    return F.concat(F.lit("p"), F.col("o_orderkey") % 6)


def _config_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents of four fifths of the customers, each with two references."""
    n = F.col("c_custkey")
    ref = lambda path, *symbols: F.struct(F.lit(path).alias("path"), F.array(*symbols).cast("array<string>").alias("symbols"))
    none = F.lit(None).cast("string")
    return A.raw(spark, d, "customer").where("c_custkey % 5 <> 0").select(
        F.concat(F.lit("doc-"), n).alias("doc_id"), F.concat(F.lit("docs/"), n, F.lit(".md")).alias("path"), F.lit("eng-guide").alias("audience"), F.col("c_name").alias("owner"),
        none.alias("team"), none.alias("dri"), F.array(ref("r0"), ref("r1", F.lit("F"))).alias("refs"), F.array().cast("array<string>").alias("context"),
    )


def _config_edits(spark: SparkSession, d: str) -> DataFrame:
    """An edit per order of a customer, in order of its key."""
    k = F.col("o_orderkey")
    of = lambda lo, hi: (k % 23 >= lo) & (k % 23 <= hi)
    action = F.when(k % 97 == 0, "rename").when(of(0, 0), "create_doc").when(of(1, 10), "add_code_ref").when(of(11, 11), "remove_code_ref").when(of(12, 15), "set_context_refs").otherwise("reassign_owner")
    path = F.concat(F.lit("r"), k % 3)
    ref = F.struct(path.alias("path"), F.array("o_orderstatus").alias("symbols"))
    return A.raw(spark, d, "orders").select(
        k.alias("seq"), F.concat(F.lit("doc-"), "o_custkey").alias("doc_id"), action.alias("action"), F.when(of(0, 0) | of(11, 11), path).alias("path"), F.when(of(0, 0), "user-guide").alias("audience"),
        F.when(of(0, 10), F.array(ref)).alias("refs"), F.when(of(12, 15), F.array(F.concat(F.lit("c"), k % 4), F.concat(F.lit("c"), F.floor(k / 7) % 6 + 2))).alias("context"),
        F.when(k % 2 == 0, _clerk()).alias("owner"), F.when(k % 3 == 0, _group()).alias("team"), F.when(k % 5 == 0, F.col("o_orderstatus")).alias("dri"),
    )


_EDITS = """e AS (SELECT 'doc-' || o_custkey AS doc_id, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i,
    CASE WHEN o_orderkey % 97 = 0 THEN 'rename' WHEN k = 0 THEN 'create_doc' WHEN k <= 10 THEN 'add_code_ref' WHEN k = 11 THEN 'remove_code_ref' WHEN k <= 15 THEN 'set_context_refs' ELSE 'reassign_owner' END AS action,
    'r' || (o_orderkey % 3) AS path, {'path': 'r' || (o_orderkey % 3), 'symbols': [o_orderstatus]} AS ref, ['c' || (o_orderkey % 4), 'c' || ((o_orderkey // 7) % 6 + 2)] AS context,
    CASE WHEN o_orderkey % 2 = 0 THEN 'clerk-' || (o_orderkey % 50) END AS owner, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || (o_orderkey % 6) END AS team, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS dri
    FROM (SELECT *, o_orderkey % 23 AS k FROM orders)),
  d AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS known, path, audience, owner,
      CASE WHEN known THEN [{'path': 'r0', 'symbols': []::VARCHAR[]}, {'path': 'r1', 'symbols': ['F']}] ELSE [] END AS refs
    FROM (SELECT 'doc-' || c_custkey AS doc_id, 'docs/' || c_custkey || '.md' AS path, 'eng-guide' AS audience, c_name AS owner FROM customer WHERE c_custkey % 5 <> 0) a FULL JOIN (SELECT DISTINCT doc_id FROM e) b ON a.doc_id = b.doc_id),
  s AS (SELECT doc_id, 0::BIGINT AS i, known, path, audience, owner, NULL::VARCHAR AS team, NULL::VARCHAR AS dri, refs, []::VARCHAR[] AS context, NULL::VARCHAR AS problem, NULL::BIGINT AS failed_seq FROM d
    UNION ALL SELECT doc_id, i, known OR p IS NULL, CASE WHEN p IS NULL AND new THEN epath ELSE path END, CASE WHEN p IS NULL AND new THEN 'user-guide' ELSE audience END,
      CASE WHEN p IS NOT NULL THEN owner WHEN new THEN NULL WHEN action = 'reassign_owner' THEN coalesce(eowner, owner) ELSE owner END,
      CASE WHEN p IS NOT NULL THEN team WHEN new THEN NULL WHEN action = 'reassign_owner' THEN coalesce(eteam, team) ELSE team END,
      CASE WHEN p IS NOT NULL THEN dri WHEN new THEN NULL WHEN action = 'reassign_owner' THEN coalesce(edri, dri) ELSE dri END,
      CASE WHEN p IS NOT NULL THEN refs WHEN new THEN [ref] WHEN action = 'remove_code_ref' THEN kept WHEN action = 'add_code_ref' AND NOT list_contains(refs, ref) THEN list_append(refs, ref) ELSE refs END,
      CASE WHEN p IS NOT NULL THEN context WHEN new THEN [] WHEN action = 'set_context_refs' THEN econtext ELSE context END, p, CASE WHEN p IS NOT NULL THEN seq END
    FROM (SELECT *, action = 'create_doc' AS new, CASE WHEN action = 'rename' THEN 'unknown action rename' WHEN action <> 'create_doc' AND NOT known THEN 'unknown document'
        WHEN action = 'remove_code_ref' AND len(kept) = len(refs) THEN 'no code_ref with path ' || epath || ' to remove' WHEN action = 'set_context_refs' AND econtext[1] = econtext[2] THEN 'duplicate context_refs' END AS p
      FROM (SELECT s.doc_id, e.i, e.seq, e.action, e.path AS epath, e.ref, e.context AS econtext, e.owner AS eowner, e.team AS eteam, e.dri AS edri, s.known, s.path, s.audience, s.owner, s.team, s.dri, s.refs, s.context,
          list_filter(s.refs, lambda r: r.path <> e.path) AS kept FROM s JOIN e ON e.doc_id = s.doc_id AND e.i = s.i + 1 WHERE s.problem IS NULL)))"""


@query(f"""WITH RECURSIVE {_EDITS}
  SELECT doc_id, known, path, audience, owner, team, dri, array_to_string(list_transform(refs, lambda r: r.path || ':' || array_to_string(r.symbols, ',')), ';') AS refs, array_to_string(context, ',') AS context, problem, failed_seq
  FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1""")
def config_edits(spark: SparkSession, d: str) -> DataFrame:
    """Documents after all staged edits, each document's one after the other, up to the first that cannot be applied."""
    out = edits.applied(_config_docs(spark, d), _config_edits(spark, d))
    refs = F.array_join(F.transform("refs", lambda r: F.concat(r["path"], F.lit(":"), F.array_join(r["symbols"], ","))), ";")
    return out.withColumns({"refs": refs, "context": F.array_join("context", ",")})


@query("""WITH e AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'clerk-' || (o_orderkey % 50) END AS owner, ['p' || (o_orderkey % 6), o_orderstatus] AS more FROM orders),
  o AS (SELECT doc_id, owner FROM e WHERE owner IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1),
  r AS (SELECT c_custkey AS doc_id, c_mktsegment AS ref FROM customer UNION SELECT doc_id, unnest(more) FROM e)
  SELECT c_custkey AS doc_id, coalesce(o.owner, c_name) AS owner, (SELECT string_agg(ref, ',' ORDER BY ref) FROM r WHERE r.doc_id = c_custkey) AS refs FROM customer LEFT JOIN o ON o.doc_id = c_custkey""")
def owner_edits(spark: SparkSession, d: str) -> DataFrame:
    """Owner and references of documents after edits that set an owner or none and add references."""
    docs = A.raw(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("owner"), F.array("c_mktsegment").alias("refs"))
    k = F.col("o_orderkey")
    staged = A.raw(spark, d, "orders").select(k.alias("seq"), F.col("o_custkey").alias("doc_id"), F.when(k % 3 == 0, _clerk()).alias("owner"), F.array(_group(), "o_orderstatus").alias("add_refs"))
    return edits.edited_owners(docs, staged).withColumn("refs", F.array_join("refs", ","))


@query("""WITH n AS (SELECT o_orderkey AS seq, o_custkey AS repo_id, 'clerk-' || (o_orderkey % 50) AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'p' || (o_orderkey % 6) END AS token FROM orders),
  f AS (SELECT repo_id, min(seq) AS seq, arg_max(name, seq) AS name, sha256(arg_max(token, seq) FILTER (token IS NOT NULL)) AS token FROM n GROUP BY 1),
  t AS (SELECT -c_custkey AS seq, c_custkey AS repo_id, c_name AS name, sha256(c_mktsegment) AS token FROM customer WHERE c_custkey % 2 = 1)
  SELECT coalesce(t.seq, f.seq) AS seq, coalesce(t.repo_id, f.repo_id) AS repo_id, coalesce(f.name, t.name) AS name, coalesce(f.token, t.token) AS token_hash FROM t FULL JOIN f ON t.repo_id = f.repo_id""")
def repo_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Repositories after registrations with and without a token; only hashes of tokens are kept."""
    table = A.raw(spark, d, "customer").where("c_custkey % 2 = 1").select((-F.col("c_custkey")).alias("seq"), F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("name"), F.sha2("c_mktsegment", 256).alias("token_hash"))
    k = F.col("o_orderkey")
    return store.register(table, A.raw(spark, d, "orders").select(k.alias("seq"), F.col("o_custkey").alias("repo_id"), _clerk().alias("name"), F.when(k % 4 == 0, _group()).alias("auth_token")))


@query("""WITH RECURSIVE c AS (SELECT CASE WHEN c_custkey % 10 = 9 THEN 'who-' || c_custkey ELSE c_name END AS name, o_orderkey AS seq, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS i,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'p' || (o_orderkey % 6) END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'clerk-' || (o_orderkey % 50) END AS gone FROM orders JOIN customer ON c_custkey = o_custkey),
  r AS (SELECT c_custkey AS ord, c_name AS name, c_custkey % 3 = 0 AS active FROM customer WHERE c_custkey % 4 <> 0),
  s AS (SELECT coalesce(r.name, c.name) AS name, 0::BIGINT AS i, r.ord, CASE WHEN r.name IS NOT NULL THEN 'person' END AS kind, r.active, NULL::VARCHAR AS departed_at, r.name IS NOT NULL AS known FROM r FULL JOIN (SELECT DISTINCT name FROM c) c ON c.name = r.name
    UNION ALL SELECT s.name, c.i, CASE WHEN known OR gone IS NOT NULL THEN ord ELSE 1000000000000 + seq END, CASE WHEN gone IS NULL THEN c.kind ELSE s.kind END, CASE WHEN gone IS NULL THEN true WHEN known THEN false END,
      CASE WHEN gone IS NOT NULL AND known THEN gone END, known OR gone IS NULL FROM s JOIN c ON c.name = s.name AND c.i = s.i + 1)
  SELECT ord, name, kind, active, departed_at FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY i DESC) = 1) WHERE known""")
def roster_changes(spark: SparkSession, d: str) -> DataFrame:
    """The roster after updates and departures, several of each name, some of unknown names."""
    c, k = A.raw(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_orderkey")
    roster = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.lit("person").alias("kind"), (F.col("c_custkey") % 3 == 0).alias("active"), F.lit(None).cast("string").alias("departed_at"))
    name = F.when(F.col("c_custkey") % 10 == 9, F.concat(F.lit("who-"), "c_custkey")).otherwise(F.col("c_name"))
    changes = A.raw(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(k.alias("seq"), name.alias("name"), F.when(k % 3 != 0, _group()).alias("kind"), F.when(k % 3 == 0, _clerk()).alias("departed_at"))
    return edits.roster_after(roster, changes)


_LINES = r"""l AS (SELECT doc_id AS n, string_split(translate(text, chr(13) || chr(11) || chr(12) || chr(133) || chr(8232) || chr(8233) || chr(28) || chr(29) || chr(30), '         '), chr(10)) AS x FROM documents WHERE text IS NOT NULL),
  t AS (SELECT n, x, len(x) AS c, len(x) // 2 AS p, n % 4 AS k FROM l),
  h AS (SELECT *, greatest(p - 3, 0) AS a, least(p + CASE k WHEN 1 THEN 4 ELSE 3 END, c) AS z, list_transform(x, lambda s: ' ' || s || chr(10)) AS same FROM t),
  r AS (SELECT *, CASE WHEN z - a = 1 THEN (a + 1)::VARCHAR WHEN z = a THEN a || ',0' ELSE (a + 1) || ',' || (z - a) END AS ra, CASE WHEN z - a + (k = 2)::INT = 1 THEN (a + 1)::VARCHAR ELSE (a + 1) || ',' || (z - a + (k = 2)::INT) END AS rb FROM h)"""


def _edited(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts before and after: as they were, with the middle line replaced, with one inserted, and new documents."""
    n = F.col("doc_id")
    lines = F.split(F.translate("text", "\r\x0b\x0c\x85  \x1c\x1d\x1e", " " * 9), "\n")
    text = A.bodies(spark, d).where("text is not null").select("doc_id", lines.alias("x")).withColumn("p", F.floor(F.size("x") / 2).cast("int"))
    own = F.concat(F.lit("#"), n, F.lit("#"))
    whole = lambda c: F.concat(F.array_join(c, "\n"), F.lit("\n"))
    head = F.concat(F.slice("x", F.lit(1), F.col("p")), F.array(own))
    rest = lambda skipped: F.slice("x", F.col("p") + 1 + skipped, F.size("x"))
    after = F.when(n % 4 == 1, whole(F.concat(head, rest(1)))).when(n % 4 == 2, whole(F.concat(head, rest(0)))).otherwise(whole(F.col("x")))
    return text.select("doc_id", F.concat(F.lit("d"), n, F.lit(".md")).alias("path"), F.when(n % 4 != 3, whole(F.col("x"))).alias("before"), after.alias("after"))


@query(f"""WITH {_LINES} SELECT 'd' || n || '.md' AS path, '--- a/d' || n || '.md' || chr(10) || '+++ b/d' || n || '.md' || chr(10) || CASE k
    WHEN 3 THEN '@@ -0,0 +1' || CASE WHEN c > 1 THEN ',' || c ELSE '' END || ' @@' || chr(10) || array_to_string(list_transform(x, lambda s: '+' || s || chr(10)), '')
    ELSE '@@ -' || ra || ' +' || rb || ' @@' || chr(10) || array_to_string(same[a + 1:p], '') || CASE k WHEN 1 THEN '-' || x[p + 1] || chr(10) ELSE '' END || '+#' || n || '#' || chr(10) || array_to_string(same[p + 1 + (k = 1)::INT:z], '') END AS patch,
  CASE WHEN k = 3 THEN c ELSE 1 END::INT AS added, (k = 1)::INT AS removed FROM r WHERE k > 0""")
def document_patches(spark: SparkSession, d: str) -> DataFrame:
    return patches.patches(_edited(spark, d).drop("doc_id"))


_FIXED = "---\nx: 1\n---\n# T\n<!-- BEGIN a -->\nold {n}\n<!-- END a -->\n<!-- BEGIN b -->\nkept\n<!-- END b -->\n"


@query(r"""WITH e AS (SELECT event_id AS n, event_id % 9 AS k FROM events), p AS (SELECT n, k, 'd' || n || '.md' AS path FROM e),
  o AS (SELECT *, '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ ' AS head FROM p)
  SELECT n AS record_id, CASE k WHEN 0 THEN 'no_applicable_fix' WHEN 1 THEN 'no_applicable_fix' WHEN 2 THEN 'unknown_document' WHEN 3 THEN 'missing_file' END AS problem, k IN (4, 7) AS applied, CASE WHEN k <> 2 THEN path END AS path,
    CASE k WHEN 4 THEN head || '-3,7 +3,8 @@' || chr(10) || ' ---' || chr(10) || ' # T' || chr(10) || ' <!-- BEGIN a -->' || chr(10) || '-old ' || n || chr(10) || '+new' || chr(10) || '+two' || chr(10) || ' <!-- END a -->' || chr(10) || ' <!-- BEGIN b -->' || chr(10) || ' kept' || chr(10)
      WHEN 7 THEN head || '-1,10 +1 @@' || chr(10) || array_to_string(list_transform(['---', 'x: 1', '---', '# T', '<!-- BEGIN a -->', 'old ' || n, '<!-- END a -->', '<!-- BEGIN b -->', 'kept', '<!-- END b -->'], lambda s: '-' || s || chr(10)), '') || '+whole ' || n || chr(10) END AS patch FROM o""")
def record_fixes(spark: SparkSession, d: str) -> DataFrame:
    """Fixes of all records, each on its own document: of regions that the engine may author or not, of whole documents, and none."""
    e = A.raw(spark, d, "events").select(F.col("event_id").alias("n"), (F.col("event_id") % 9).alias("k"))
    n, k = F.col("n"), F.col("k")
    text = F.replace(F.lit(_FIXED), F.lit("{n}"), n.cast("string"))
    docs = e.where(k != 2).select(n.alias("doc_id"), F.concat(F.lit("d"), n, F.lit(".md")).alias("path"), F.when(k != 3, text).alias("text"))
    region = F.when(k.isin(4, 8), "a").when(k == 5, "b").when(k == 6, "none")
    body = F.when(k == 8, F.concat(F.lit("old "), n)).when(k == 4, "new\ntwo").otherwise("changed")
    records = e.select(
        n.alias("record_id"), n.alias("doc_id"), F.when(k == 0, "ESCALATE").otherwise("FIX").alias("verdict"), F.when(k != 1, "why").alias("rationale"), region.alias("region_id"),
        F.when(region.isNotNull(), body).alias("new_region_body"), F.when(k == 7, F.concat(F.lit("whole "), n, F.lit("\n"))).alias("new_doc_text"),
    )
    regions = e.where(k == 5).select(n.alias("doc_id"), F.lit("b").alias("region_id"), F.lit(True).alias("kept"))
    return patches.applied_fixes(records, docs, regions)
