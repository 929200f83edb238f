"""Canonical JSON as column functions: sorted keys, no spaces, ASCII escapes, nulls kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.text import short_hash

_SHORT = {"0022": '\\"', "005c": "\\\\", "0008": "\\b", "0009": "\\t", "000a": "\\n", "000c": "\\f", "000d": "\\r"}


def json_text(c: Column) -> Column:
    """A text as a JSON string; null as null. Only texts with other than plain characters are looked at unit by unit."""
    units = F.regexp_extract_all(F.lower(F.hex(F.encode(c, "UTF-16BE"))), F.lit("[0-9a-f]{4}"), F.lit(0))

    def escaped(u: Column) -> Column:
        out = F.when(u == "0022", _SHORT["0022"])
        for code, text in _SHORT.items():
            out = out.when(u == code, text)
        return out.when((u >= "0020") & (u <= "007e"), F.chr(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), u))

    plain = ~c.rlike(r'[^\x20-\x7e]|["\\]')
    return F.coalesce(F.concat(F.lit('"'), F.when(plain, c).otherwise(F.array_join(F.transform(units, escaped), "")), F.lit('"')), F.lit("null"))


def json_bool(c: Column) -> Column:
    return F.coalesce(F.when(c, F.lit("true")).otherwise(F.when(~c, F.lit("false"))), F.lit("null"))


def json_list(items: Column) -> Column:
    """An array of JSON texts as one list."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def json_object(**members: Column) -> Column:
    """An object of JSON texts by name, in order of name."""
    parts = [x for i, name in enumerate(sorted(members)) for x in (F.lit(("," if i else "") + f'"{name}":'), members[name])]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def json_hash(c: Column) -> Column:
    return short_hash(c)
