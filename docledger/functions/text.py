"""Column functions on paths, names, bodies and Markdown."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def normalized(body: Column) -> Column:
    """Line ends as \\n."""
    return F.replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def body_hash(body: Column) -> Column:
    return short_hash(normalized(body))


def record_id(doc: Column, surface: Column, detected_at: Column) -> Column:
    return short_hash(F.concat_ws("\0", doc, surface, detected_at), 12)


def glob_regex(glob: str) -> str:
    """A glob as a regular expression of the whole path: **/ any leading segments, ** anything, * and ? within a segment."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(parts.get(t) or re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", t) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob))
    return rf"^(?s:{body})\z"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def language(path: Column) -> Column:
    return F.when(F.lower(path).rlike(r"\.pyi?\z"), "python").otherwise("unknown")


def is_public(name: Column) -> Column:
    """By the part after the last dot: dunder names are public, others with a leading underscore are not."""
    leaf = F.element_at(F.split(name, r"\."), -1)
    return leaf.rlike(r"^__.*__\z") | ~leaf.startswith("_")


def directories(path: Column) -> Column:
    """All directories above a path, the topmost first; none for a path without any."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(path.contains("/"), above).otherwise(F.array().cast("array<string>"))


def proposed_doc_id(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.pyi?\z", ""), F.lit("/"), F.lit("-"))


def cell(c: Column) -> Column:
    """Text of a Markdown table cell."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def slug(heading: Column) -> Column:
    """Anchor of a heading; `section` where nothing is left of it."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(heading), r"[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("section"))


def path_class(path: Column) -> Column:
    return F.when(path.rlike("^test-docs/"), "tests").when(F.lower(path).rlike(r"(^|/)readme(\.[^/]*)?\z"), "readme").otherwise("main")


def coverage_signal(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "review").when(ratio >= 0.9, "sync").when(ratio >= 0.6, "review").otherwise("drift")


def ignore_globs(line: Column) -> Column:
    """Globs of one line of an ignore file; none for comments, blanks and negations."""
    raw = F.trim(F.regexp_replace(line, r"[\t\r]+", " "))
    body = F.trim(raw, F.lit("/"))
    anchored, is_dir = raw.startswith("/"), raw.endswith("/")
    slash, wild = body.contains("/"), body.rlike(r"[*?]")
    inside = F.concat(body, F.lit("/**"))
    anywhere = F.concat(F.lit("**/"), body)
    both = F.array(body, inside)
    none = F.array().cast("array<string>")
    return (
        F.when((raw == "") | raw.startswith("#") | raw.startswith("!") | (body == ""), none)
        .when(is_dir & (anchored | slash), F.array(inside)).when(is_dir, F.array(F.concat(anywhere, F.lit("/**"))))
        .when(anchored, both).when(slash & ~wild, both).when(slash, F.array(body))
        .when(wild, F.array(anywhere)).otherwise(F.array(anywhere, F.concat(anywhere, F.lit("/**"))))
    )


def severity(tiers: Column, added: Column, removed: Column, changed: Column) -> Column:
    """Severity of a change: removals and changed signatures break, additions do not, other tiers are cosmetic."""
    return (
        F.when((F.size(removed) > 0) | (F.size(changed) > 0), "breaking").when(F.size(added) > 0, "additive")
        .when(F.array_contains(tiers, "signature"), "breaking").when(F.size(tiers) > 0, "cosmetic").otherwise("unknown")
    )


def normal_path(path: Column) -> Column:
    """A directory without empty and . parts and with / between them, so that spellings of one directory are equal."""
    return F.array_join(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != ".")), "/")


def record_cell(field: str, name: Column, kind: Column, fields: Column) -> Column:
    """Cell of a table row of records: their name or kind, else the value of a field; empty where there is none."""
    own = {"name": name, "kind": kind}
    return cell(F.coalesce(own[field] if field in own else F.try_element_at(fields, F.lit(field)), F.lit("")))


def authored_prose(audience: Column, names: Column) -> Column:
    """What stands in for prose that a model would write: a sentence over the public names (an array) of a surface, always the same for it."""
    listed = F.array_join(F.transform(F.array_sort(names), lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")
    covered = F.when(F.size(names) > 0, listed).otherwise("no public symbols")
    return F.concat(F.lit("This "), audience, F.lit(" section is authored from the code surface (the single source of truth) and is re-authored whenever that surface changes. It covers the public API: "), covered, F.lit("."))
