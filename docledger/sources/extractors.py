"""Facts of source files by language: a registry of extractors, run as a table function over files."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.sources.logs import spread, symbols_of

FACT = "name string, kind string, signature string, lineno int, end_lineno int, docstring string, fields map<string,string>"
_NAMES = [c.split()[0] for c in FACT.replace("map<string,string>", "map").split(", ")]

#: What a switch looks like, getopts and case labels of shell, the argv block, switches and letter classes of Tcl.
SWITCH = r"^--?[A-Za-z][\w-]*$"
SHELL_GETOPTS = r"getopts\s+\"?:?([A-Za-z:]+)\"?\s+\w+"
SHELL_LABEL = r"(--?[A-Za-z][\w-]*)(?=[)|])"
TCL_BLOCK = r"(?s)switch\s+-regexp\s+--\s+\$arg\s*\{(.*?)\n\s*\}\s*\n\s*\}"
TCL_SWITCH = r"\n\s*\^(-\w[\w-]*)"
TCL_LETTERS = r"regexp\s*\{\s*\^\\?-\+?\[([A-Za-z]+)\]"
#: Names of loop variables that hold an argument, and most characters of an option's action or default (fixed values).
ARGUMENT_NAMES, MOST_OPTION = ("arg", "a", "argv"), 80

_SHELL_FUNCTION = re.compile(r"^\s*(?:function\s+([A-Za-z_]\w*)\s*(?:\(\s*\))?|([A-Za-z_]\w*)\s*\(\s*\))\s*\{")


class ExtractionError(ValueError):
    """A source that cannot be read, or a language that nobody has registered."""


def _parsed(text: str) -> ast.Module:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError) as e:
        raise ExtractionError(f"cannot parse: {e}") from e


# Symbols.


def python_facts(text: str) -> Iterator[dict]:
    _parsed(text)
    yield from ({k: s[k] for k in ("name", "kind", "signature", "lineno", "end_lineno", "docstring")} for s in symbols_of(text))


def _end_of_block(lines: list[str], at: int, depth: int = 0) -> int:
    """The line on which the braces opened from line at on are closed; at itself where they never are."""
    for i in range(at, len(lines)):
        for c in lines[i]:
            depth += (c == "{") - (c == "}")
            if c == "}" and depth == 0:
                return i
    return at


def shell_facts(text: str) -> Iterator[dict]:
    """Functions of a shell script with the comment right above each."""
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if not (m := _SHELL_FUNCTION.match(line)):
            continue
        above = i
        while above and lines[above - 1].lstrip().startswith("#") and not lines[above - 1].lstrip().startswith("#!"):
            above -= 1
        comment = "\n".join(re.sub("^# ?", "", x.lstrip()).rstrip() for x in lines[above:i])
        name = m[1] or m[2]
        yield {"name": name, "kind": "function", "signature": f"{name}()", "lineno": i + 1, "end_lineno": _end_of_block(lines, i) + 1, "docstring": comment or None}


# Switches and options.


class _Switches(ast.NodeVisitor):
    """Option strings of add_argument calls, and those that arguments are compared with."""

    def __init__(self) -> None:
        self.found: set[str] = set()

    def _take(self, node: ast.AST) -> None:
        for x in ast.walk(node) if isinstance(node, (ast.Tuple, ast.List, ast.Set)) else (node,):
            if isinstance(x, ast.Constant) and isinstance(x.value, str) and re.match(SWITCH, x.value):
                self.found.add(x.value)

    def visit_Call(self, node: ast.Call) -> None:  # noqa: N802
        if getattr(node.func, "attr", None) == "add_argument":
            for x in node.args:
                self._take(x)
        self.generic_visit(node)

    def visit_Compare(self, node: ast.Compare) -> None:  # noqa: N802
        sides = [node.left, *node.comparators]
        groups = [x for x in node.comparators if isinstance(x, (ast.Tuple, ast.List, ast.Set))]
        members = [x for g in groups for x in g.elts]
        switches_only = bool(groups) and all(isinstance(x, ast.Constant) and re.match(SWITCH, str(x.value)) for x in members)
        if switches_only or any(self._is_argument(x) for x in sides):
            for x in sides:
                self._take(x)
        self.generic_visit(node)

    def _is_argument(self, node: ast.AST) -> bool:
        while isinstance(node, ast.Subscript):
            node = node.value
        return getattr(node, "attr", None) == "argv" or (isinstance(node, ast.Name) and node.id in ARGUMENT_NAMES)


def python_switches(text: str) -> set[str]:
    visitor = _Switches()
    visitor.visit(_parsed(text))
    return visitor.found


def tcl_switches(text: str) -> set[str]:
    """Switches of the block that matches arguments, of the whole text without one; letters of option classes anywhere."""
    block = re.search(TCL_BLOCK, text)
    letters = "".join(re.findall(TCL_LETTERS, text))
    return {*re.findall(TCL_SWITCH, block[1] if block else text), *(f"-{c}" for c in letters)}


def shell_switches(text: str) -> set[str]:
    """Letters of getopts where it is used, else labels of case branches."""
    options = re.findall(SHELL_GETOPTS, text)
    return {f"-{c}" for c in "".join(options) if c.isalpha()} if options else set(re.findall(SHELL_LABEL, text))


def _one_line(node: ast.expr | None, most: int | None) -> str:
    """A keyword's value on one line, elided beyond most characters; constants as they are, expressions as written."""
    if node is None:
        return ""
    text = " ".join((str(node.value) if isinstance(node, ast.Constant) else ast.unparse(node)).split())
    return text if most is None or len(text) <= most else text[: most - 3] + "..."


def argparse_options(text: str) -> Iterator[dict]:
    """Options of add_argument calls by name, the first long form if there is one; the last of a name in the walk counts."""
    options: dict[str, dict] = {}
    for call in ast.walk(_parsed(text)):
        if not isinstance(call, ast.Call) or getattr(call.func, "attr", None) != "add_argument":
            continue
        forms = [x.value for x in call.args if isinstance(x, ast.Constant) and isinstance(x.value, str) and x.value.startswith("-")]
        if forms:
            given = {k.arg: k.value for k in call.keywords}
            name = min(forms, key=lambda f: not f.startswith("--"))
            options[name] = {"action": _one_line(given.get("action"), MOST_OPTION), "default": _one_line(given.get("default"), MOST_OPTION), "help": _one_line(given.get("help"), None)}
    yield from ({"name": n, "kind": "option", "fields": options[n]} for n in sorted(options))


# Records of JSON files.


def json_facts(text: str, records_key: str = "*", name_field: str = "name") -> Iterator[dict]:
    """Rows of a list in a JSON object, in order of name; rows that are no objects are left out.

    records_key names the list; * takes the only key that holds one. Values are as Python writes them, a row without a name is ?.
    """
    try:
        whole = json.loads(text)
    except ValueError as e:
        raise ExtractionError(f"cannot parse JSON: {e}") from e
    if not isinstance(whole, dict):
        raise ExtractionError("no object at top level")
    lists = {k: v for k, v in whole.items() if isinstance(v, list) and records_key in ("*", k)}
    if len(lists) != 1:
        raise ExtractionError(f"{len(lists)} lists under {records_key!r}, one is needed")
    rows = [x for x in next(iter(lists.values())) if isinstance(x, dict)]
    named = [(str(x.get(name_field, "?")), {str(k): str(v) for k, v in x.items() if k != name_field}) for x in rows]
    yield from ({"name": n, "kind": "record", "fields": dict(sorted(f.items()))} for n, f in sorted(named, key=lambda x: x[0]))


# Registry.

Extractor = Callable[[str], Iterator[dict]]


def _switch_facts(switches: Callable[[str], set[str]]) -> Extractor:
    return lambda text: ({"name": s, "kind": "switch"} for s in sorted(switches(text)))


class Registry:
    """Extractors by language and languages by suffix. A new language is a registration."""

    def __init__(self, default: str | None = None) -> None:
        self.extractors: dict[str, Extractor] = {}
        self.suffixes: dict[str, str] = {}
        self.default = default

    def register(self, language: str, extractor: Extractor, *suffixes: str) -> Registry:
        """Add or replace a language's extractor and the suffixes that stand for it."""
        self.extractors[language] = extractor
        self.suffixes.update(dict.fromkeys(suffixes, language))
        return self

    def of(self, path: str, language: str = "auto") -> Extractor:
        """The extractor of a language, auto goes by suffix; an unknown one is an error."""
        own = self.suffixes.get(path[path.rfind(".") :], self.default) if language == "auto" else language
        if own not in self.extractors:
            raise ExtractionError(f"no extractor for language {own or language!r} of {path}")
        return self.extractors[own]


SYMBOLS = Registry().register("python", python_facts, ".py").register("shell", shell_facts, ".sh", ".bash").register("json", json_facts, ".json")
SWITCHES = Registry("shell").register("python", _switch_facts(python_switches), ".py").register("shell", _switch_facts(shell_switches), ".sh", ".bash").register("tcl", _switch_facts(tcl_switches), ".tcl")
OPTIONS = Registry("python").register("python", argparse_options)


def extracted(files: DataFrame, registry: Registry, language: str = "auto", problems: bool = False) -> DataFrame:
    """Facts (FACT) of files (path, text): a table function takes one file and gives its rows, by the file's language.

    A language without an extractor and a source that does not parse fail the query; with problems they are one row of the
    file with the column problem set. Null texts count as empty. Add a language by registering it.
    """

    class Extract:
        def eval(self, path: str, text: str) -> Iterator[tuple]:
            try:
                for fact in registry.of(path, language)(text or ""):
                    yield (*(fact.get(n) for n in _NAMES), None)
            except ExtractionError as e:
                if not problems:
                    raise ExtractionError(f"{path}: {e}") from e
                yield (*(None for _ in _NAMES), str(e))

    facts = F.udtf(Extract, returnType=f"{FACT}, problem string")
    rows = spread(files.select("path", "text"))
    out = rows.lateralJoin(facts(F.col("path").outer(), F.col("text").outer())).drop("text")
    return out if problems else out.drop("problem")
