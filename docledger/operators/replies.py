"""Replies of a model: prose around a JSON object, to typed results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.operators.documents import json_object

#: Verdicts, and the texts that a fix may hold; the last is always needed (fixed values).
VERDICTS = ("FIX", "INVALIDATE", "ESCALATE")
FIX_FIELDS = ("region_id", "new_region_body", "new_doc_text", "rationale")


def _kind(v: Column) -> Column:
    """Kind of a variant: OBJECT, ARRAY, STRING, VOID for a JSON null and so on; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def results(replies: DataFrame) -> DataFrame:
    """Replies (reply_id, reply) as verdict, cause and fix, or the problem that there is, in this order.

    no_object, unbalanced (the first object never closes), invalid_json (an object that names a key twice too),
    fix_no_object, fix_malformed (an unknown key, a value that is no text, no rationale), missing_key (verdict or
    cause), invalid (an unknown verdict, a cause that is no text). A fix that is null or absent is none; other keys of the reply do
    not count. Texts stay variants until their kind is known, so a number or list is never taken for text. A null reply has no object.
    """
    whole = F.try_parse_json("object")
    at = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    rows = replies.select("reply_id", "reply", json_object(F.col("reply")).alias("object"))
    rows = rows.withColumn("v", whole).withColumns({name: at(F.col("v"), name) for name in ("verdict", "cause", "fix")})
    rows = rows.withColumns({f"fix_{name}": at(F.col("fix"), name) for name in FIX_FIELDS}).withColumn("fix_kind", _kind(F.col("fix")))
    known = F.array(*[F.lit(n) for n in FIX_FIELDS])
    text_or_none = lambda name: F.coalesce(_kind(F.col(name)).isin("STRING", "VOID"), F.lit(True))
    malformed = (
        (F.size(F.array_except(F.json_object_keys(F.to_json("fix")), known)) > 0) | ~F.coalesce(_kind(F.col("fix_rationale")) == "STRING", F.lit(False))
        | ~(text_or_none("fix_region_id") & text_or_none("fix_new_region_body") & text_or_none("fix_new_doc_text"))
    )
    text = lambda name: F.try_variant_get(name, "$", "string")
    has_fix = F.coalesce(F.col("fix_kind") != "VOID", F.lit(False))
    problem = (
        F.when(~F.coalesce(F.col("reply").contains("{"), F.lit(False)), "no_object").when(F.col("object").isNull(), "unbalanced").when(F.col("v").isNull(), "invalid_json")
        .when(has_fix & (F.col("fix_kind") != "OBJECT"), "fix_no_object").when(has_fix & malformed, "fix_malformed")
        .when(F.col("verdict").isNull() | F.col("cause").isNull(), "missing_key")
        .when((_kind(F.col("verdict")) != "STRING") | ~text("verdict").isin(*VERDICTS) | (_kind(F.col("cause")) != "STRING"), "invalid")
    )
    rows = rows.withColumn("problem", problem)
    sound = lambda c: F.when(F.col("problem").isNull(), c)
    fields = [sound(text(f"fix_{n}")).alias(n) for n in FIX_FIELDS]
    return rows.select("reply_id", "problem", sound(text("verdict")).alias("verdict"), sound(text("cause")).alias("cause"), sound(has_fix).alias("has_fix"), *fields)
