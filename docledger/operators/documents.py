"""Configured documents: reference trees, loop guard, sync summaries, tickets, edits, front matter, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.text import body_hash, normal_path, slug


def tree(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Documents with their references, sorted, as one array; documents without any have an empty one."""
    nested = refs.groupBy("doc_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return docs.join(nested, "doc_id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def loop_guard(changes: DataFrame, managed: DataFrame) -> DataFrame:
    """Per change set (change_id, path): whether any changed file is not a managed document. Empty sets have no row, so false."""
    marked = changes.join(managed.select("path").distinct().withColumn("m", F.lit(True)), "path", "left")
    return marked.groupBy("change_id").agg(F.bool_or(F.col("m").isNull()).alias("should_sync"))


def pick_scope(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """Rows of one sync kind per repo: the given one, else git if the repo has any, else local."""
    if kind is not None:
        return rows.where(F.col("sync_kind") == kind)
    has = rows.groupBy("repo_id").agg(F.max(F.when(F.col("sync_kind") == "git", 1).otherwise(0)).alias("git"))
    return rows.join(has, "repo_id").where(F.col("sync_kind") == F.when(F.col("git") == 1, "git").otherwise("local")).drop("git")


def first_per_doc(rows: DataFrame) -> DataFrame:
    """The first row of each document by insertion, across sync kinds."""
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("doc_id", *[F.col("r")[c].alias(c) for c in rest])


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last inserted row of each key, whatever time it claims."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


def sync_summary(drifts: DataFrame, repos: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Per repo: drifts in all and by kind, ok, and fully_synced (no drift, and for local mode no commit ahead)."""
    counts = drifts.groupBy("repo_id").agg(F.count("*").alias("drifts"), *[F.count_if(F.col("kind") == k).alias(k.lower()) for k in kinds])
    out = repos.join(counts, "repo_id", "left").fillna(0, ["drifts", *[k.lower() for k in kinds]])
    ok = F.col("drifts") == 0
    return out.withColumn("ok", ok).withColumn("fully_synced", ok & ((F.col("mode") == "git") | (F.col("ahead") == 0)))


def config_problems(docs: DataFrame, edges: DataFrame, units: DataFrame, listed: DataFrame) -> DataFrame:
    """Violations of cross-file rules: duplicate document ids, dangling upstreams, units that the index lacks or that do not exist."""
    rule = lambda df, name, c: df.select(F.lit(name).alias("problem"), F.col(c).cast("string").alias("subject"))
    twice = docs.groupBy("doc_id").count().where("count > 1")
    dangling = edges.join(docs.select(F.col("doc_id").alias("upstream_id")), "upstream_id", "left_anti").select("upstream_id").distinct()
    found = [rule(twice, "duplicate_doc", "doc_id"), rule(dangling, "dangling_upstream", "upstream_id"), rule(units.join(listed, "unit", "left_anti"), "unindexed_unit", "unit"), rule(listed.join(units, "unit", "left_anti"), "missing_unit", "unit")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def ticket(verdict: Column, kind: Column, healable: Column) -> tuple[Column, Column]:
    """Severity and action of a drift's ticket."""
    severity = F.when((verdict == "ESCALATE") | (kind == "UNHEALABLE") | ~healable, "high").when(verdict == "INVALIDATE", "low").otherwise("medium")
    action = F.when(verdict == "INVALIDATE", "dismiss").when(verdict == "ESCALATE", "escalate").otherwise("apply")
    return severity, action


def offline_verdict(kind: Column, audience: Column, detail: Column, renderable: Column, mode: Column) -> Column:
    """Verdict without a model: renderable or authored regions and moved surfaces are fixed, changes that users do not see dismissed."""
    unseen = detail.rlike("(?i)docstring|comment|private")
    return F.when((kind == "REGION") & (renderable | (mode == "llm")), "FIX").when((kind == "HASH") & (audience == "user-guide") & unseen, "INVALIDATE").when(kind == "HASH", "FIX").otherwise("ESCALATE")


def front_matter(docs: DataFrame) -> DataFrame:
    """Header between --- lines, body after it, and the body's hash; documents without a header are all body."""
    whole = r"\A---\n((?:.*\n)*?)---\n"
    header = F.when(F.col("text").rlike(whole), F.regexp_extract("text", whole, 1))
    body = F.regexp_replace("text", whole, "")
    return docs.select("doc_id", header.alias("header"), body.alias("body"), body_hash(body).alias("hash"))


def heading_slugs(headings: DataFrame) -> DataFrame:
    """Slugs of headings (doc_id, pos, heading), made distinct per document by -1, -2 and so on."""
    rows = headings.withColumn("base", slug(F.col("heading")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("pos")) - 1
    return rows.withColumn("slug", F.when(nth == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), nth))).drop("base")


def gate(drifts: DataFrame, edges_gate: bool = False) -> DataFrame:
    """Per repo whether a check fails: any drift counts, suspect links only if they are asked to."""
    gating = F.lit(edges_gate) | (F.col("kind") != "SUSPECT_LINK")
    return drifts.groupBy("repo_id").agg(F.count_if(gating).alias("gating"), F.bool_or(gating).alias("failed"))


def json_object(reply: Column) -> Column:
    """The first balanced {...} in a text, braces in strings not counted; null without one or when it never closes.

    Everything but braces, quotes and backslashes is skipped by splitting at those, so the fold has a step per mark.
    """
    tail = F.regexp_extract(reply, r"(?s)\{.*", 0)
    # pieces: text up to and with a mark
    pieces = F.regexp_extract_all(tail, F.lit(r'(?s)[^{}"\\]*(?:\\.|[{}"]|\z)'), F.lit(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("stop"))

    def step(s: Column, x: Column) -> Column:
        mark = F.substring(x, -1, 1)
        escaped = s["quoted"] & x.rlike(r"(?s)\\.\z")  # outside strings a backslash is a character like others
        free = ~s["quoted"] & ~escaped
        depth = s["depth"] + F.when(free & (mark == "{"), 1).when(free & (mark == "}"), -1).otherwise(0)
        at = s["at"] + F.char_length(x)
        closed = free & (mark == "}") & (depth == 0) & (s["stop"] == 0)
        return F.struct(depth.alias("depth"), (s["quoted"] != ((mark == '"') & ~escaped)).alias("quoted"), at.alias("at"), F.when(closed, at).otherwise(s["stop"]).alias("stop"))

    stop = F.aggregate(pieces, zero, step)["stop"]
    return F.when(stop > 0, F.substring(tail, F.lit(1), stop))


STYLE = ("document_type", "tone", "writing_style", "vocabulary")


def styles(docs: DataFrame, mappings: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Style of each document (doc_id): its first mapping (ord, doc_id and STYLE), else the defaults."""
    first = mappings.groupBy("doc_id").agg(F.min_by(F.struct(*STYLE), "ord").alias("own"))
    rows = docs.join(first, "doc_id", "left")
    return rows.select(*docs.columns, *[F.when(F.col("own").isNotNull(), F.col(f"own.{c}")).otherwise(F.lit(defaults[c])).alias(c) for c in STYLE])


def missing_styles(styled: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, category, name) of styles without a template (category, name)."""
    named = styled.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("name")) for c in STYLE])).alias("s")).select("doc_id", "s.*")
    return named.join(templates, ["category", "name"], "left_anti").select("doc_id", "category", "name")


def orphaned(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows that a write must refuse: their key names no parent. A null key is refused too."""
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def folded_identity(registrations: DataFrame) -> DataFrame:
    """Registrations with one path: the identity's own, else that of the payload."""
    return registrations.withColumn("local_path", F.coalesce("identity_path", "local_path")).drop("identity_path")


def worklist_lines(items: DataFrame) -> DataFrame:
    """Ranked worklist items as lines of a report, in order within each assignee: (assignee, rank, line)."""
    target = F.concat(F.col("doc_id").cast("string"), F.coalesce(F.concat(F.lit(" → "), F.col("upstream_id").cast("string")), F.lit("")))
    line = F.concat(F.lit("    ["), "severity", F.lit("] "), "reason", F.lit(" "), target, F.lit(" — "), "status")
    return items.select(F.coalesce("assignee", F.lit("(unowned)")).alias("assignee"), "rank", line.alias("line"))


def worklist_report(items: DataFrame, with_suspects: bool = True) -> DataFrame:
    """A worklist as a report, in lines sorted by (part, assignee_order, assignee, rank): head, owners and their items.

    items are ranked. The head counts items, documents and owners, a note says where suspect links are left out, and an empty
    worklist says so. Assignees are in order of name, the unowned last. Only counts meet in one row.
    """
    none = F.array().cast("array<string>")
    n = items.agg(F.count("*").alias("items"), F.count_distinct("doc_id").alias("docs"), F.count_distinct(F.coalesce("assignee", F.lit("\0"))).alias("owners"))
    head = F.concat(F.lit("# Worklist — "), "items", F.lit(" item(s) across "), "docs", F.lit(" document(s), "), "owners", F.lit(" owner(s)"))
    note = none if with_suspects else F.array(F.lit("  (suspect-link items omitted — this is the central mirror)"))
    clear = F.when(F.col("items") == 0, F.array(F.lit(""), F.lit("  nothing needs review — all clear"))).otherwise(none)
    top = n.select(F.lit(0).alias("part"), F.lit(None).cast("string").alias("assignee"), F.lit(0).alias("assignee_order"), F.posexplode(F.concat(F.array(head), note, clear)).alias("rank", "line"))
    order = F.col("assignee").isNull().cast("int").alias("assignee_order")
    counted = items.groupBy("assignee").agg(F.count("*").alias("items"), F.count_distinct("doc_id").alias("docs"))
    title = F.concat(F.lit("  "), F.coalesce("assignee", F.lit("(unowned)")), F.lit(": "), "items", F.lit(" item(s) across "), "docs", F.lit(" doc(s)"))
    owners = counted.select(F.lit(1).alias("part"), "assignee", order, F.posexplode(F.array(F.lit(""), title)).alias("rank", "line")).withColumn("rank", F.col("rank") - 1)
    rows = worklist_lines(items).select(F.lit(1).alias("part"), F.when(F.col("assignee") != "(unowned)", F.col("assignee")).alias("assignee"), F.col("rank").cast("int").alias("rank"), "line")
    return top.unionByName(owners).unionByName(rows.select("part", "assignee", order, "rank", "line"))


def identical_directories(units: DataFrame) -> DataFrame:
    """Directories (unit, dir) that several units cover under whatever spelling, with those units: (dir, units)."""
    same = units.select("unit", normal_path(F.col("dir")).alias("dir")).distinct()
    return same.groupBy("dir").agg(F.array_sort(F.collect_set("unit")).alias("units")).where(F.size("units") > 1)
