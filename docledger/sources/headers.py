"""Headers of documents: a subset of YAML, read by an indentation stack over lines. What is outside it is loud."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scalars with a meaning of their own (fixed values of YAML 1.1).
NULLS = frozenset(("", "~", "null", "Null", "NULL"))
TRUE, FALSE = frozenset("yes Yes YES true True TRUE on On ON".split()), frozenset("no No NO false False FALSE off Off OFF".split())
_INT, _FLOAT = re.compile(r"[-+]?(?:0|[1-9][0-9_]*)"), re.compile(r"[-+]?(?:[0-9][0-9_]*)?\.[0-9_]*(?:[eE][-+][0-9]+)?")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#:{}\[\],&*!|>'"%@`-][^:#]*?|-[^\s:#][^:#]*?)\s*:(?:\s+(.*)|)$""")
_PARSED = "problem string, kind string, fields map<string,string>"


class HeaderError(ValueError):
    """A header that this subset does not read."""


def _without_comment(line: str) -> str:
    """line up to a # that begins it or follows a space, outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and line[i - 1] != "\\" else quote
        elif c in "'\"" and (i == 0 or line[i - 1] in " \t[{,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


def _scalar(text: str) -> str | None:
    """A scalar as Python would write it, null as None."""
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        inner = text[1:-1]
        return inner.replace("''", "'") if text[0] == "'" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), inner)
    if text[:1] in tuple("'\"&*!|>%@`"):
        raise HeaderError(f"not read: {text}")
    if re.search(r":(?:\s|$)", text):
        raise HeaderError(f"a mapping within a value: {text}")
    if text in NULLS:
        return None
    if text in TRUE or text in FALSE:
        return str(text in TRUE)
    if _INT.fullmatch(text):
        return str(int(text.replace("_", "")))
    return str(float(text.replace("_", ""))) if _FLOAT.fullmatch(text) and any(c.isdigit() for c in text) else text


class _Flow:
    """A flow mapping or list on one line."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def _skip(self) -> str:
        while self.at < len(self.text) and self.text[self.at] == " ":
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self) -> object:
        c = self._skip()
        if c in ("{", "["):
            return self._group(c, "}" if c == "{" else "]")
        m = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,{}\[\]]*)""").match(self.text, self.at)
        self.at = m.end()
        return _scalar(m[1].strip())

    def _group(self, opening: str, closing: str) -> object:
        self.at += 1
        pairs, items = {}, []
        while (c := self._skip()) != closing:
            if not c:
                raise HeaderError(f"never closed: {self.text}")
            if opening == "{":
                m = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,:{}\[\]]+)\s*(?::(?=[\s,}]|$))?""").match(self.text, self.at)
                if not m:
                    raise HeaderError(f"no key: {self.text}")
                self.at = m.end()
                key = _scalar(m[1].strip())
                pairs[str(key)] = self.value() if m[0].rstrip().endswith(":") else None
            else:
                items.append(self.value())
            if self._skip() == ",":
                self.at += 1
            elif self._skip() != closing:
                raise HeaderError(f"no comma: {self.text}")
        self.at += 1
        return pairs if opening == "{" else items

    def whole(self) -> object:
        out = self.value()
        if self._skip():
            raise HeaderError(f"more behind the value: {self.text}")
        return out


def _value(text: str) -> object:
    return _Flow(text).whole() if text[:1] in ("{", "[") else _scalar(text)


def parsed(header: str) -> object:
    """A header's mapping, list or scalar; raises HeaderError on anything that is not read.

    Read are block and flow mappings and lists, quoted and plain scalars on one line, and comments. Anchors, tags, block scalars
    and values over several lines are not. Of a key given twice the last counts.
    """
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in map(_without_comment, header.split("\n")) if x.strip() and x.strip() != "---"]
    if any("\t" in x[: len(x) - len(x.lstrip())] for x in header.split("\n")):
        raise HeaderError("a tab indents a line")
    root: list = []
    # a frame: its lines' indentation, and the mapping or list that they fill, made when the first of them is seen
    stack: list[tuple[int, object]] = []
    waiting: tuple[object, object] | None = (root, None)
    parent_indent = -1

    def put(holder: object, key: object, value: object) -> None:
        holder.append(value) if isinstance(holder, list) else holder.__setitem__(key, value)

    def line_into(indent: int, text: str) -> None:
        nonlocal waiting, parent_indent
        listed = text == "-" or text.startswith("- ")
        while stack and indent < stack[-1][0]:
            stack.pop()
            waiting = None
        # a list may stand at its key's indentation, and ends where a key follows
        while stack and indent == stack[-1][0] and isinstance(stack[-1][1], list) and not listed:
            stack.pop()
            waiting = None
        if waiting and (indent > parent_indent or (listed and indent == parent_indent)):
            frame: object = [] if listed else {}
            if not listed and not _KEY.fullmatch(text):
                if stack or len(lines) > 1:
                    raise HeaderError(f"not read: {text}")
                put(*waiting, _value(text))
                waiting = None
                return
            holder, key = waiting
            if isinstance(holder, list) and holder and holder[-1] is None and key is ...:
                holder[-1] = frame
            else:
                put(holder, key, frame)
            stack.append((indent, frame))
        elif not stack or indent != stack[-1][0] or listed != isinstance(stack[-1][1], list):
            raise HeaderError(f"indentation: {text}")
        waiting, own = None, stack[-1][1]
        if listed:
            rest = text[1:].strip()
            inner = indent + len(text) - len(text[1:].lstrip()) if rest else indent
            own.append(None)
            if rest and (rest.startswith("- ") or (rest[:1] not in "{[" and _KEY.fullmatch(rest))):
                waiting, parent_indent = (own, ...), indent
                line_into(inner, rest)
            elif rest:
                own[-1] = _value(rest)
            else:
                waiting, parent_indent = (own, ...), indent
            return
        m = _KEY.fullmatch(text)
        if not m:
            raise HeaderError(f"not read: {text}")
        key, rest = str(_scalar(m[1].strip())), (m[2] or "").strip()
        own[key] = _value(rest) if rest else None
        if not rest:
            waiting, parent_indent = (own, key), indent

    for indent, text in lines:
        line_into(indent, text)
    return root[0] if root else None


def _flat(value: object, path: str = "") -> dict[str, str | None]:
    """Scalars by their dotted path; lists count as their length."""
    if isinstance(value, dict):
        return {k: v for key, x in value.items() for k, v in ({f"{path}{key}": ""} | _flat(x, f"{path}{key}.") if isinstance(x, dict) else _flat(x, f"{path}{key}.")).items()}
    return {path[:-1]: str(value) if isinstance(value, list) else value}


def _parsed_headers(headers: pd.Series) -> pd.DataFrame:
    rows = []
    for text in headers:
        try:
            value = parsed(text or "")
        except HeaderError as e:
            rows.append((str(e), None, None))
            continue
        kind = "none" if value is None else "mapping" if isinstance(value, dict) else "other"
        rows.append(("no mapping" if kind == "other" else None, kind, _flat(value) if kind == "mapping" else {}))
    return pd.DataFrame(rows, columns=["problem", "kind", "fields"])


def parsed_header(header: Column) -> Column:
    """Struct of problem (null if it is read), kind (none, mapping) and fields: scalars as text by dotted path, null for a null.

    A mapping is present under its path with an empty text. Headers are small, so their parsing in Arrow batches costs little next to bodies, which stay in the JVM.
    """
    return F.pandas_udf(_parsed_headers, _PARSED)(header)
