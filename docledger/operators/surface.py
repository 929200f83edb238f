"""Fingerprints of documented surfaces: digests of symbols, of tiers and of the whole, over canonical JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.functions.canonical import json_bool, json_hash, json_list, json_object, json_text
from docledger.functions.text import is_public, short_hash

#: Audience whose surface has docstrings, and the one that never has bodies (fixed values).
WITH_DOCSTRINGS, WITHOUT_BODIES = "eng-guide", "user-guide"


def symbol_digests(symbols: DataFrame) -> DataFrame:
    """Symbols (doc_id, ord, name, kind, signature, docstring, body_hash) with anchor, digest and the JSON of their tiers.

    The anchor follows from the name, so it survives moves; the digest from name, kind, signature and visibility. Each is a function
    of its symbol alone: where digests are kept, only changed symbols are hashed again.
    """
    base = {"name": json_text(F.col("name")), "kind": json_text(F.col("kind")), "signature": json_text(F.col("signature")), "is_public": json_bool(is_public(F.col("name")))}
    rows = symbols.withColumns({"anchor": short_hash(F.col("name")), "j_sig": json_object(**base)})
    return rows.withColumns({"digest": json_hash(F.col("j_sig")), "j_name": base["name"], "j_doc": json_text(F.col("docstring")), "j_body": json_text(F.col("body_hash"))}).withColumn("j_base", F.expr("substring(j_sig, 2, char_length(j_sig) - 2)"))


def surface_fingerprints(symbols: DataFrame, audiences: DataFrame, records: DataFrame | None = None, include_body: bool = False) -> DataFrame:
    """Per document (doc_id, audience): composite, signature, docstring, body, and digest by anchor in sigs.

    symbols as for symbol_digests; records: (doc_id, kind, name, fields: array of (key, value) in order). The composite is the hash of
    {"audience", "records" if there are any, "symbols"}, with docstrings for eng-guide and, with include_body, bodies for all but
    user-guide; tiers are hashes of their part, null where the audience leaves them out or no symbol has a body. Items are in order of
    name, equal ones in order of ord. A document without symbols has the digest of empty lists. A document's surface is one row.
    """
    rows = symbol_digests(symbols).join(audiences, "doc_id")
    docs, body = F.col("audience") == WITH_DOCSTRINGS, (F.col("audience") != WITHOUT_BODIES) & F.col("body_hash").isNotNull() & F.lit(include_body)
    # keys in order: body_hash, docstring, is_public, kind, name, signature
    item = F.concat(F.lit("{"), F.when(body, F.concat(F.lit('"body_hash":'), "j_body", F.lit(","))).otherwise(""), F.when(docs, F.concat(F.lit('"docstring":'), "j_doc", F.lit(","))).otherwise(""), "j_base", F.lit("}"))
    rows = rows.withColumns({
        "item": item, "doc_item": F.when(docs, json_object(name=F.col("j_name"), docstring=F.col("j_doc"))), "body_item": F.when(body, json_object(name=F.col("j_name"), body_hash=F.col("j_body"))),
    })
    one = F.array_sort(F.collect_list(F.struct("name", "ord", "item", "j_sig", "doc_item", "body_item", "anchor", "digest")))
    own = rows.groupBy("doc_id").agg(one.alias("s"))
    out = audiences.join(own, "doc_id", "left").withColumn("s", F.coalesce("s", F.expr("array()").cast(own.schema["s"].dataType)))
    if records is None:
        out = out.withColumn("records", F.lit(None).cast("string"))
    else:
        pairs = F.transform("fields", lambda f: json_list(F.array(json_text(f["key"]), json_text(f["value"]))))
        listed = F.array_sort(F.collect_list(F.struct("kind", "name", json_object(name=json_text(F.col("name")), kind=json_text(F.col("kind")), fields=json_list(pairs)).alias("j"))))
        out = out.join(records.groupBy("doc_id").agg(json_list(F.transform(listed, lambda r: r["j"])).alias("records")), "doc_id", "left")
    of = lambda f: json_list(F.array_compact(F.transform("s", lambda x: x[f])))
    whole = lambda f: F.concat(F.lit('{"audience":'), json_text(F.col("audience")), F.coalesce(F.concat(F.lit(',"records":'), "records"), F.lit("")), F.lit(',"symbols":'), of(f), F.lit("}"))
    docstring = F.when(F.col("audience") == WITH_DOCSTRINGS, json_hash(F.concat(F.lit('{"docstrings":'), of("doc_item"), F.lit("}"))))
    bodies = F.when(F.exists("s", lambda x: x["body_item"].isNotNull()), json_hash(F.concat(F.lit('{"bodies":'), of("body_item"), F.lit("}"))))
    last = F.transform("s", lambda x: F.struct(x["anchor"].alias("k"), x["digest"].alias("v")))
    sigs = F.aggregate(last, F.expr("map()").cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["k"]), F.create_map(x["k"], x["v"])))
    return out.select("doc_id", json_hash(whole("item")).alias("composite"), json_hash(whole("j_sig")).alias("signature"), docstring.alias("docstring"), bodies.alias("body"), sigs.alias("sigs"))
