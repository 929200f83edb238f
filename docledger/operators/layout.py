"""Layout rules of documents, states of their managed regions, and drift of documents against code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import body_hash, normalized
from docledger.operators import trace
from docledger.sources.headers import parsed_header

#: Version of the layout that a document declares, and the name under which a derived page carries its source's hash.
LAYOUT_VERSION = "1.0.0"
BLOCK = "cdm"
HASH_META = "[a-z]+-docs?-md-sha256"
_FENCED = r"\A---\n((?:.*\n)*?)---\n"


def header(text: Column) -> Column:
    """Lines between the fences of a front matter; null without one."""
    return F.when(text.rlike(_FENCED), F.regexp_extract(text, _FENCED, 1))


def body(text: Column) -> Column:
    return F.regexp_replace(text, _FENCED, "")


def embedded_hash(html: Column) -> Column:
    """Hash of the source that a derived page carries in a meta tag."""
    return F.nullif(F.regexp_extract(html, HASH_META + r"""["'][^>]*?content=["']([0-9a-f]+)""", 1), F.lit(""))


def html_twin(path: Column) -> Column:
    """Path of the page derived from a document: its suffix, if any, replaced."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*\z", ""), F.lit(".html"))


def title_and_purpose(text: Column) -> tuple[Column, Column]:
    """The first filled line if it is a heading of level one, and the quoted lines after it, put together."""
    lines = F.filter(F.transform(F.split(body(text), "\n"), lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, r"^\s+", "").alias("x"))), lambda s: s["x"].rlike(r"\S"))
    first = F.get(lines, 0)["x"]
    title = F.when(first.startswith("# "), F.trim(F.substring(first, 3, 1 << 30)))
    rest = F.slice(lines, F.when(title.isNotNull(), 2).otherwise(1), F.size(lines))
    # a quote ends at the first line that is empty or no quote
    start = F.get(rest, 0)["i"]
    run = F.filter(rest, lambda s, k: (s["i"] == start + k) & s["x"].startswith(">"))
    whole = F.filter(run, lambda s, k: s["i"] == start + k)
    text_of = F.transform(whole, lambda s: F.trim(F.regexp_replace(s["x"], "^>+", "")))
    return F.coalesce(title, F.lit("")), F.trim(F.array_join(text_of, " "))


def _codes(*found: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, F.lit(code)) for code, condition in found]))


def lint(docs: DataFrame) -> DataFrame:
    """Layout rules that documents break, as (doc_id, code, subject); codes are fixed values.

    docs: doc_id, audience, text, region_keys (array), html (whether a derived page is declared) and html_text (null where
    it does not exist). Line ends count as one whatever they are. A header that is no mapping, or that is not read, is malformed, and
    nothing else is told of its document; one that never closes is none. Regions with a wrong marker, or one id
    twice, are malformed, and their ids are not compared.
    """
    docs = docs.where("text is not null").withColumn("text", normalized(F.col("text"))).withColumn("h", parsed_header(header(F.col("text")))).withColumn("broken", F.col("h.problem").isNotNull())
    own = lambda key: F.try_element_at("h.fields", F.lit(f"{BLOCK}.{key}"))
    filled = F.coalesce(F.size("h.fields") > 0, F.lit(False))
    lines = F.filter(F.split(body(F.col("text")), "\n"), lambda x: x.rlike(r"\S"))
    rows = docs.withColumns({"version": own("schema_version"), "declared": own("audience"), "fingerprint": own("fingerprint"), "filled": filled, "lines": lines, "hash": body_hash(body(F.col("text"))), "embedded": embedded_hash(F.col("html_text"))})
    titled = F.coalesce(F.get("lines", 0).rlike(r"^#\s+\S"), F.lit(False))
    codes = _codes(
        ("MISSING_FRONT_MATTER", ~F.col("filled")),
        ("MISSING_SCHEMA_VERSION", F.col("filled") & F.col("version").isNull()),
        ("SCHEMA_VERSION_MISMATCH", F.col("filled") & (F.col("version") != LAYOUT_VERSION)),
        ("MISSING_AUDIENCE", F.col("filled") & F.col("declared").isNull()),
        ("AUDIENCE_MISMATCH", F.col("filled") & (F.col("declared") != F.col("audience"))),
        ("MISSING_FINGERPRINT", F.col("filled") & F.col("fingerprint").isNull()),
        ("MISSING_TITLE", ~titled),
        ("MISSING_PURPOSE", titled & ~F.coalesce(F.get("lines", 1).rlike(r"^>\s*\S"), F.lit(False))),
        ("HTML_MISSING", F.col("html") & F.col("html_text").isNull()),
        ("HTML_NOT_DERIVED", F.col("html") & F.col("html_text").isNotNull() & F.col("embedded").isNull()),
        ("HTML_STALE", F.col("html") & (F.col("embedded") != F.col("hash"))),
    )
    own = rows.select("doc_id", F.explode(F.when(F.col("broken"), F.array(F.lit("MALFORMED_STRUCTURE"))).otherwise(codes)).alias("code")).withColumn("subject", F.lit(None).cast("string"))
    sound = docs.where("not broken").select("doc_id", "region_keys", body(F.col("text")).alias("text"))
    found = trace.regions(sound).groupBy("doc_id").agg(F.bool_or(F.col("problem").isNotNull()).alias("wrong"), F.collect_list("region_id").alias("ids"))
    found = found.withColumn("wrong", F.col("wrong") | (F.size(F.array_distinct("ids")) < F.size("ids")))
    regions = sound.select("doc_id", "region_keys").join(found, "doc_id", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    pair = lambda code, values: F.transform(values, lambda x: F.struct(F.lit(code).alias("code"), x.alias("subject")))
    both = F.concat(pair("UNDECLARED_REGION", F.array_except(ids, "region_keys")), pair("MISSING_REGION", F.array_except("region_keys", ids)))
    malformed = F.array(F.struct(F.lit("MALFORMED_STRUCTURE").alias("code"), F.lit(None).cast("string").alias("subject")))
    told = regions.select("doc_id", F.explode(F.when(F.coalesce("wrong", F.lit(False)), malformed).otherwise(both)).alias("r")).select("doc_id", "r.*")
    return own.unionByName(told)


def region_states(regions: DataFrame) -> DataFrame:
    """Regions (doc_id, region_id, body, mode, stored_hash, known) with locked and advisory.

    A seeded region is locked when its stored hash differs from its body's: somebody has edited
    it. The engine authors neither those nor regions in human mode.
    """
    hashed = body_hash(F.col("body"))
    edited = F.coalesce(F.col("stored_hash") != hashed, F.lit(False))
    locked = (F.col("mode") == "llm-seeded") & edited
    return regions.withColumn("edited", edited).withColumn("locked", locked).withColumn("advisory", (F.col("mode") == "human") | locked)


def drift_findings(docs: DataFrame, regions: DataFrame, suspects: DataFrame) -> DataFrame:
    """All drift of documents as (doc_id, kind, subject, healable).

    docs: doc_id, present, stored and current (fingerprints). regions: as for region_states, with
    declared and expected (the rendered body, null where nothing is rendered). suspects:
    (doc_id, upstream_id). A missing document has no other finding but suspect links. Undeclared regions
    are not looked at. Of a region that nobody renders, an llm one drifts when the code has moved, others
    cannot be healed. A region that the engine does not author is only reported, when the code has moved or when its
    human body is still the one that was reviewed.
    """
    none = F.lit(None).cast("string")
    moved = ~F.col("stored").eqNullSafe(F.col("current"))
    row = lambda kind, subject, healable: [F.lit(kind).alias("kind"), subject.alias("subject"), healable.alias("healable")]
    own = docs.where(~F.col("present") | moved).select("doc_id", F.when(F.col("present"), "HASH").otherwise("MISSING_DOC").alias("kind"), none.alias("subject"), F.lit(True).alias("healable"))
    states = region_states(regions.where("declared")).join(docs.where("present").select("doc_id", moved.alias("moved")), "doc_id")
    pending = (F.col("mode") == "human") & F.col("stored_hash").isNotNull() & ~F.col("edited")
    differs = F.coalesce(F.col("expected") != F.col("body"), F.lit(False))
    unrendered = F.when(~F.col("advisory"), F.when(F.col("mode") != "llm", "UNHEALABLE").when(F.col("moved"), "REGION"))
    rendered = F.when(differs & (~F.col("advisory") | F.col("moved") | pending), "REGION")
    kind = F.when(F.col("known"), rendered).otherwise(unrendered)
    healable = (kind == "REGION") & ~F.col("advisory")
    parts = states.select("doc_id", kind.alias("kind"), F.col("region_id").alias("subject"), healable.alias("healable")).where("kind is not null")
    links = suspects.select("doc_id", *row("SUSPECT_LINK", F.col("upstream_id").cast("string"), F.lit(False)))
    return own.unionByName(parts).unionByName(links)


def undeclared_and_missing(docs: DataFrame) -> DataFrame:
    """Region rules of lint alone: (doc_id, code, subject)."""
    return lint(docs).where("code in ('UNDECLARED_REGION', 'MISSING_REGION')")


def index_gaps(docs: DataFrame) -> DataFrame:
    """Documents that an index of their repository does not link, as (repo_id, doc_id: the index, missing_id, link).

    docs: repo_id, doc_id, path, audience, html (whether a derived page exists), index, kinds (audiences that the index lists, null
    for all) and text, which only indexes need; an index without a text is left out. A link counts wherever the relative path to
    the source, or to its derived page, stands in the body after the header, even as a part of a longer word; link is the first of both
    that would do. Words of the bodies are joined with the paths first, and only what they do not find is searched for in
    the body, so that a body meets the documents that it may lack, and not all of its repository.
    """
    bodies = docs.where("index and text is not null").select("repo_id", F.col("doc_id").alias("index_id"), F.col("path").alias("index_path"), "kinds", body(normalized(F.col("text"))).alias("body"))
    folder = F.when(F.col("index_path").contains("/"), F.regexp_replace("index_path", r"/[^/]*\z", "")).otherwise(F.lit(""))
    target = docs.select("repo_id", F.col("doc_id").alias("missing_id"), "path", "audience", "html")
    pairs = bodies.drop("body").join(target, "repo_id").where((F.col("missing_id") != F.col("index_id")) & (F.col("kinds").isNull() | F.array_contains("kinds", F.col("audience"))))
    both = F.when(F.col("html"), F.array(relative_path(F.col("path"), folder), relative_path(html_twin(F.col("path")), folder))).otherwise(F.array(relative_path(F.col("path"), folder)))
    pairs = pairs.select("repo_id", "index_id", "missing_id", F.array_sort(both).alias("links"))
    words = bodies.select("repo_id", "index_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"[^\s()<>\[\]\"'`#|]+"), F.lit(0)))).alias("link"))
    found = pairs.select("repo_id", "index_id", "missing_id", F.explode("links").alias("link")).join(words, ["repo_id", "index_id", "link"], "left_semi").select("repo_id", "index_id", "missing_id").distinct()
    left = pairs.join(found, ["repo_id", "index_id", "missing_id"], "left_anti").join(bodies.select("repo_id", "index_id", "body"), ["repo_id", "index_id"])
    return left.where(~F.exists("links", lambda x: F.contains("body", x))).select("repo_id", F.col("index_id").alias("doc_id"), "missing_id", F.get("links", 0).alias("link"))


def relative_path(target: Column, folder: Column) -> Column:
    """A path as seen from a folder: one .. for each part that is left, then the parts that follow the common ones."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    a, b = parts(folder), parts(target)
    most = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.transform(F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0))), lambda i: F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False))), F.lit(False))
    common = F.when(most == 0, 0).when(differ == 0, most).otherwise(differ - 1).cast("int")
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - common), F.slice(b, common + 1, F.greatest(F.size(b) - common, F.lit(0)))), "/")


def replaced_regions(docs: DataFrame, bodies: DataFrame, begin: str = trace.BEGIN, end: str = trace.END) -> DataFrame:
    """Documents (doc_id, text) with the bodies of some regions (doc_id, region_id, body) replaced; all else stays byte for byte.

    Documents without such a region keep their text. changed tells whether it is another one.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    spans = trace.regions(docs, begin, end).where("problem is null and stop is not null").join(bodies.withColumnRenamed("body", "new"), ["doc_id", "region_id"])
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "new")).alias("spans"))
    inside = F.exists("spans", lambda s: (F.col("pos") > s["start"]) & (F.col("pos") < s["stop"]))
    opening = F.get(F.filter("spans", lambda s: s["start"] == F.col("pos")), 0)["new"]
    kept = lines.join(spans, "doc_id", "left").where(~F.coalesce(inside, F.lit(False)))
    kept = kept.select("doc_id", "pos", F.when(opening.isNotNull(), F.concat("line", F.lit("\n"), opening)).otherwise(F.col("line")).alias("line"))
    text = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("new_text"))
    return docs.join(text, "doc_id", "left").select("doc_id", F.coalesce("new_text", "text").alias("text"), F.coalesce(F.col("new_text") != F.col("text"), F.lit(False)).alias("changed"))
