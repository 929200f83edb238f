"""Report rows: coverage snapshots, slices and gates, tickets, gap issues, feature and test indexes, index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import cell, directories, path_class
from docledger.operators import layout
from docledger.operators.documents import ticket
from docledger.operators.trace import FEATURE_ID

#: What a reviewer ticks off before a ticket closes, by verdict: text and whether the engine can tell by itself (fixed values).
CHECKLIST = {
    "INVALIDATE": (("Change is confined to non-public surface (docstring/comment/private)", True), ("Public API is unchanged", False)),
    "ESCALATE": (("A human has authored the missing/owned content", False), ("The new content is in sync with the code surface", False)),
    "FIX": (("Proposed text matches the current code surface", True), ("No human-owned region is modified", True), ("Document still passes the layout lint", False)),
}


def coverage_snapshot(cov: DataFrame, key: str = "repo_id") -> DataFrame:
    """Per key the counts and percentage of files (path, owners, status), and the files themselves by path.

    cov: key, path, owners, status. A key's list of files is one row, as it is stored; counts are aggregates of it.
    """
    n = lambda s: F.count_if(F.col("status") == s)
    files = F.array_sort(F.collect_list(F.struct("path", "owners", "status")))
    out = cov.groupBy(key).agg(n("documented").alias("documented"), n("undocumented").alias("undocumented"), n("waived").alias("waived"), files.alias("files"))
    base = F.col("documented") + F.col("undocumented")
    return out.withColumn("percent_files", F.when(base == 0, 100.0).otherwise(100.0 * F.col("documented") / base))


def ignored_counts(paths: DataFrame, include: Column, default_exclude: Column, exclude: Column, key: str = "unit") -> DataFrame:
    """Files per key that only the configured ignores removed: in scope before them, minus the universe."""
    before = include & ~default_exclude
    return paths.groupBy(key).agg(F.count_if(before & exclude).alias("ignored_files"), F.count_if(before & ~exclude).alias("scanned_files"))


def coverage_gate(report: DataFrame, least_percent: float, fail_on_unreferenced: bool = False) -> DataFrame:
    """Slices (unit, documented, undocumented, waived, percent) that fail: below the floor, or with gaps where none is allowed."""
    low = F.coalesce(F.col("percent") < least_percent, F.lit(False))
    gaps = F.lit(fail_on_unreferenced) & (F.col("undocumented") > 0)
    return report.withColumn("failed", low | gaps).withColumn("reason", F.when(low, "below_floor").when(gaps, "unreferenced"))


def suggested_units(gaps: DataFrame, units: DataFrame) -> DataFrame:
    """Gap files (path) with the unit whose directory contains them, the deepest one; null where no unit does.

    Directories above a path join units by equality.
    """
    above = gaps.select("path", F.explode_outer(directories(F.col("path"))).alias("dir"))
    hits = above.join(units.select("dir", "unit"), "dir").groupBy("path").agg(F.max_by("unit", F.char_length("dir")).alias("suggested_unit"))
    out = gaps.join(hits, "path", "left")
    return out.withColumn("reason", F.when(F.col("suggested_unit").isNull(), "no unit covers its directory").otherwise("in the unit's directory"))


#: Next action by verdict, status by resolution, and the texts around a cause without a fix (fixed values).
ACTIONS = {"INVALIDATE": "Dismiss as not-applicable", "ESCALATE": "Escalate to a human author", "FIX": "Apply the proposed fix"}
STATUSES = {"accepted": "validated", "overridden": "changes-requested", "rejected": "rejected", "invalidated": "rejected"}
NO_CHANGE, NEEDS_AUTHOR = "No documentation change needed — ", "Needs a human author — "


def _by(c: Column, values: dict[str, str], other: str) -> Column:
    return F.coalesce(*[F.when(c == k, v) for k, v in values.items()], F.lit(other))


def tickets(drifts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tickets of handled drifts (record_id, doc_id, kind, region_id, verdict, cause, detail, healable, resolution) and their fix.

    The fix: fix_region_id, fix_region_body, fix_doc_text, rationale, which is null where there is none. symbols: (doc_id, name, public).
    The proposed change is the fix's rationale, or what the verdict says of the cause; the status follows the resolution, none is proposed.
    """
    severity, action = ticket(F.col("verdict"), F.col("kind"), F.col("healable"))
    affected = symbols.where("public").groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("affected_symbols"))
    title = F.concat(F.lit("["), F.upper(severity), F.lit("] "), "kind", F.lit(" in "), "doc_id", F.coalesce(F.concat(F.lit(" · region "), F.nullif("region_id", F.lit(""))), F.lit("")))
    fixed = F.col("rationale").isNotNull()
    change = F.when(fixed & (F.col("fix_region_id").isNotNull() | F.col("fix_region_body").isNotNull()), "region").when(fixed & F.col("fix_doc_text").isNotNull(), "whole-doc").otherwise("none")
    proposed = F.when(fixed, F.col("rationale")).otherwise(F.concat(F.when(F.col("verdict") == "INVALIDATE", NO_CHANGE).otherwise(NEEDS_AUTHOR), "cause"))
    rows = drifts.withColumns({
        "severity": severity, "action": action, "title": title, "summary": F.concat("detail", F.lit(" The remediation agent's read: "), "cause"),
        "change_kind": change, "proposed_change": proposed, "recommended_action": _by(F.col("verdict"), ACTIONS, ACTIONS["FIX"]), "status": F.when(F.col("resolution").isNull(), "proposed").otherwise(_by(F.col("resolution"), STATUSES, "rejected")),
    })
    return rows.join(affected, "doc_id", "left").withColumn("affected_symbols", F.coalesce("affected_symbols", F.array().cast("array<string>")))


def checklist(drifts: DataFrame) -> DataFrame:
    """(record_id, pos, text, auto_satisfied): the acceptance criteria of each drift's verdict."""
    rows = {v: F.array(*[F.struct(F.lit(t).alias("text"), F.lit(a).alias("auto_satisfied")) for t, a in items]) for v, items in CHECKLIST.items()}
    found = F.when(F.col("verdict") == "INVALIDATE", rows["INVALIDATE"]).when(F.col("verdict") == "ESCALATE", rows["ESCALATE"]).otherwise(rows["FIX"])
    return drifts.select("record_id", F.posexplode(found).alias("pos", "item")).select("record_id", "pos", "item.*")


#: Head of a gap issue (fixed values but for the tool's name).
ISSUE_HEAD = ("Automated coverage report (bot-generated).", "", "The following PUBLIC symbols have no owning document. Each is grouped under the suggested owner (an existing doc, or a proposed new one):", "")


def gap_sections(suggestions: DataFrame, *keys: str) -> DataFrame:
    """One section per keys and suggested owner (suggested_doc_id, path, name, is_new_doc, reason): its gaps in order of path and name.

    Reason and novelty are those of the first gap. A null name is written as null.
    """
    gaps = F.array_sort(F.collect_list(F.struct("path", F.coalesce("name", F.lit("null")).alias("name"), "is_new_doc", "reason")))
    rows = suggestions.groupBy(*keys, "suggested_doc_id").agg(gaps.alias("g"))
    head = F.concat(F.lit("### `"), "suggested_doc_id", F.lit("`"), F.when(F.get("g", 0)["is_new_doc"], " (new doc)").otherwise(""), F.lit(" — "), F.coalesce(F.get("g", 0)["reason"], F.lit("")))
    lines = F.transform("g", lambda g: F.concat(F.lit("- `"), g["path"], F.lit("::"), g["name"], F.lit("`")))
    return rows.select(*keys, "suggested_doc_id", F.size("g").cast("long").alias("gaps"), F.concat(head, F.lit("\n"), F.array_join(lines, "\n")).alias("section"))


def gap_issues(suggestions: DataFrame, key: str) -> DataFrame:
    """The issue of each key (repository) that has gaps: (key, title, body). Without gaps there is no row, so nothing is opened."""
    own = gap_sections(suggestions, key).groupBy(key).agg(F.sum("gaps").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("suggested_doc_id", "section"))), lambda s: F.concat(s["section"], F.lit("\n"))).alias("s"))
    title = F.concat(F.lit("docs: "), "n", F.lit(" undocumented public symbol"), F.when(F.col("n") != 1, "s").otherwise(""))
    return own.select(key, title.alias("title"), F.array_join(F.concat(F.array(*[F.lit(x) for x in ISSUE_HEAD]), "s"), "\n").alias("body"))


def catalog_problems(features: DataFrame, modules: DataFrame) -> DataFrame:
    """Rules of a feature catalog (feature_id, modules) that are broken, as (feature_id, problem).

    Ids are FEAT, a subsystem and three digits; each occurs once; a feature names one module at least, and known ones only.
    """
    bad_id = features.where(~F.col("feature_id").rlike(FEATURE_ID)).select("feature_id", F.lit("bad_id").alias("problem"))
    twice = features.groupBy("feature_id").count().where("count > 1").select("feature_id", F.lit("duplicate_id").alias("problem"))
    empty = features.where(F.coalesce(F.size("modules"), F.lit(0)) <= 0).select("feature_id", F.lit("no_modules").alias("problem"))
    named = features.select("feature_id", F.explode("modules").alias("module"))
    unknown = named.join(modules, "module", "left_anti").select("feature_id", F.lit("unknown_module").alias("problem")).distinct()
    return bad_id.unionByName(twice).unionByName(empty).unionByName(unknown)


def by_subsystem(features: DataFrame) -> DataFrame:
    """Features of each subsystem in order of id."""
    return features.groupBy("subsystem").agg(F.array_sort(F.collect_list("feature_id")).alias("features"))


def tested_by(cases: DataFrame) -> DataFrame:
    """Test cases (nodeid, features) of each feature, in order."""
    return cases.select("nodeid", F.explode("features").alias("feature_id")).groupBy("feature_id").agg(F.array_sort(F.collect_set("nodeid")).alias("nodeids"))


def index_rows(docs: DataFrame, index_path: str) -> DataFrame:
    """Table rows of an index over documents (doc_id, path, audience, text, html): linked title and purpose.

    A link leads to the derived page where there is one. Every other document of the table has a row.
    """
    title, purpose = layout.title_and_purpose(F.coalesce("text", F.lit("")))
    link = layout.relative_path(F.when(F.col("html"), layout.html_twin(F.col("path"))).otherwise(F.col("path")), F.lit(index_path.rpartition("/")[0]))
    named = F.coalesce(F.nullif(title, F.lit("")), F.col("doc_id").cast("string"))
    rows = docs.where(F.col("path") != index_path).select("doc_id", "audience", path_class(F.col("path")).alias("class"), F.concat(F.lit("["), named, F.lit("]("), link, F.lit(")")).alias("title"), purpose.alias("summary"))
    return rows.select("doc_id", "audience", "class", F.concat(F.lit("| "), cell(F.col("title")), F.lit(" | "), cell(F.col("summary")), F.lit(" |")).alias("row"))


def edit_ids(edits: DataFrame) -> DataFrame:
    """Edits (repo_id, body, staged_at) with an id that follows from them."""
    return edits.withColumn("edit_id", F.concat(F.lit("edit-"), F.substring(F.sha1(F.concat_ws("\0", "repo_id", "body", "staged_at")), 1, 12)))


def token_hash(token: Column) -> Column:
    """What is stored of a token."""
    return F.sha2(token, 256)


def unit_owners(docs: DataFrame, units: DataFrame) -> DataFrame:
    """Documents (doc_id, unit, ...) with the owner of their unit as inherited."""
    return docs.join(units.select("unit", F.col("owner").alias("inherited")), "unit", "left")


def coverage_lines(units: DataFrame, gaps: DataFrame) -> DataFrame:
    """A coverage report as lines in order: (part, key, pos, line); units before what is undocumented.

    units: (unit, scanned, documented, percent, uncovered: array of paths); gaps: (path, suggested_unit). Keys sort the lines of a
    part, so the report is written by ranges and no task holds all of it. Percentages have two decimals, n/a where there is none.
    """
    number = F.coalesce(F.format_string("%.2f", "percent"), F.lit("n/a"))
    head = F.array(F.concat(F.lit("  - unit: "), "unit"), F.concat(F.lit("    scanned: "), "scanned"), F.concat(F.lit("    documented: "), "documented"), F.concat(F.lit("    percent: "), F.when(F.col("percent").isNull(), "n/a").otherwise(number)))
    listed = F.when(F.size("uncovered") == 0, F.array(F.lit("    uncovered: []"))).otherwise(F.concat(F.array(F.lit("    uncovered:")), F.transform(F.array_sort("uncovered"), lambda p: F.concat(F.lit("      - "), p))))
    a = units.select(F.lit("units").alias("part"), F.col("unit").alias("key"), F.posexplode(F.concat(head, listed)).alias("pos", "line"))
    rows = F.array(F.concat(F.lit("  - path: "), "path"), F.concat(F.lit("    suggested_unit: "), F.coalesce("suggested_unit", F.lit("null"))))
    return a.unionByName(gaps.select(F.lit("undocumented").alias("part"), F.col("path").alias("key"), F.posexplode(rows).alias("pos", "line")))


def parsed_units(lines: DataFrame) -> DataFrame:
    """Units of coverage_lines, read back: unit, scanned, documented, percent."""
    own = lines.where("part = 'units' and pos < 4").withColumn("field", F.regexp_extract("line", r"^\s*(?:- )?(\w+): ", 1)).withColumn("value", F.regexp_extract("line", r"^\s*(?:- )?\w+: (.*)$", 1))
    at = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    return own.groupBy("key").agg(at("unit").alias("unit"), at("scanned").cast("long").alias("scanned"), at("documented").cast("long").alias("documented"), F.nullif(at("percent"), F.lit("n/a")).cast("double").alias("percent")).drop("key")
