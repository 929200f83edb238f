"""Patches of changed documents, and fixes of records applied to their documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.operators import layout

#: Unchanged lines around a change.
CONTEXT = 3
_PATCH = "patch string, added int, removed int"


def _middle(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int, int]:
    """A run of equal lines, perhaps empty, in the middle of a shortest edit from a[alo:ahi] to b[blo:bhi].

    Furthest reaching paths grow from both ends until they meet (the linear-space algorithm of Myers, 1986), so memory is two
    rows as long as the edit, and time is length times edit.
    """
    n, m = ahi - alo, bhi - blo
    delta, half = n - m, (n + m + 1) // 2
    ahead, back = {1: 0}, {1: 0}
    for d in range(half + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1)) else ahead[k - 1] + 1
            y, start = x - k, x
            while x < n and y < m and a[alo + x] == b[blo + y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if delta % 2 and -(d - 1) <= delta - k <= d - 1 and x + back.get(delta - k, -1) >= n:
                return alo + start, blo + start - k, alo + x, blo + y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back[k - 1] + 1
            y, start = x - k, x
            while x < n and y < m and a[ahi - 1 - x] == b[bhi - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if delta % 2 == 0 and -d <= delta - k <= d and x + ahead.get(delta - k, -1) >= n:
                return ahi - x, bhi - y, ahi - start, bhi - (start - k)
    raise AssertionError("no path")


def changes(before: list[str], after: list[str]) -> list[tuple[int, int, int, int]]:
    """Ranges (a from, a to, b from, b to) of lines that differ, by a longest common subsequence of lines, in order."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in lines] for lines in (before, after))
    gone, new = [True] * len(a), [True] * len(b)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            gone[alo] = new[blo] = False
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            gone[ahi] = new[bhi] = False
        if alo == ahi or blo == bhi:
            continue
        x, y, u, v = _middle(a, b, alo, ahi, blo, bhi)
        for i in range(u - x):
            gone[x + i] = new[y + i] = False
        if (u, v) == (alo, blo) or (x, y) == (ahi, bhi):
            continue  # nothing is left in common
        todo += [(alo, x, blo, y), (u, ahi, v, bhi)]
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        s, t = i, j
        while i < len(a) and gone[i]:
            i += 1
        while j < len(b) and new[j]:
            j += 1
        if (s, t) != (i, j):
            out.append((s, i, t, j))
        else:
            i, j = i + 1, j + 1
    return out


def _range(start: int, stop: int) -> str:
    return str(start + 1) if stop - start == 1 else f"{start if stop == start else start + 1},{stop - start}"


def patch_of(path: str, before: str | None, after: str | None, context: int = CONTEXT) -> tuple[str, int, int]:
    """A unified patch of one document, and the numbers of added and removed lines; a document that is not there counts as empty.

    Lines end as Python's do. A last line without an end is told by the usual note, so that the patch applies.
    """
    a, b = ((t or "").splitlines(keepends=True) for t in (before, after))
    found = changes(a, b)
    groups: list[list[tuple[int, int, int, int]]] = []
    for c in found:
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    ended = lambda line: line if line.endswith(("\n", "\r")) else line + "\n\\ No newline at end of file\n"
    out = [f"--- a/{path}\n", f"+++ b/{path}\n"] if groups else []
    for g in groups:
        lead, trail = min(context, g[0][0]), min(context, len(a) - g[-1][1])
        first, last = (g[0][0] - lead, g[0][2] - lead), (g[-1][1] + trail, g[-1][3] + trail)
        out.append(f"@@ -{_range(first[0], last[0])} +{_range(first[1], last[1])} @@\n")
        at = first[0]
        for s, e, t, f in g:
            out += [" " + ended(x) for x in a[at:s]] + ["-" + ended(x) for x in a[s:e]] + ["+" + ended(x) for x in b[t:f]]
            at = e
        out += [" " + ended(x) for x in a[at : last[0]]]
    return "".join(out), sum(f - t for _, _, t, f in found), sum(e - s for s, e, _, _ in found)


def patches(docs: DataFrame, *keys: str) -> DataFrame:
    """Patches of the documents (keys, path, before, after) that changed: keys, path, patch, added, removed. In order of path they are one patch.

    A null before is a new document, a null after a removed one. Equal texts are left out before anything is split; a document is
    compared whole, in one row.
    """

    def run(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([patch_of(*x) for x in zip(path, before, after, strict=True)], columns=["patch", "added", "removed"])

    moved = docs.where(~F.col("before").eqNullSafe(F.col("after")))
    return moved.select(*keys, "path", F.pandas_udf(run, _PATCH)("path", "before", "after").alias("p")).select(*keys, "path", "p.*")


def applied_fixes(records: DataFrame, docs: DataFrame, regions: DataFrame) -> DataFrame:
    """What the fix of each record does to its document alone: record_id, problem, applied, path, patch.

    records: record_id, doc_id, verdict, and the fix: region_id with new_region_body, or new_doc_text; rationale is null where there
    is no fix. docs: doc_id, path, text (null where the file does not exist). regions: (doc_id, region_id, kept) says which ones
    people own or have edited; those keep their body. A record without an applicable fix, of an unknown document or of one without a
    file has a problem and changes nothing; a fix that is there already is not applied again.
    """
    rows = records.join(docs.withColumn("known", F.lit(True)), "doc_id", "left").join(regions.where("kept").select("doc_id", "region_id", "kept").distinct(), ["doc_id", "region_id"], "left")
    problem = F.when((F.col("verdict") != "FIX") | F.col("rationale").isNull(), "no_applicable_fix").when(F.col("known").isNull(), "unknown_document").when(F.col("text").isNull(), "missing_file")
    rows = rows.withColumn("problem", problem)
    sound = rows.where("problem is null").select(F.col("record_id").alias("doc_id"), "path", "text", "region_id", "new_region_body", "new_doc_text", F.coalesce("kept", F.lit(False)).alias("kept"))
    new = sound.where("new_doc_text is null and region_id is not null and not kept").select("doc_id", "region_id", F.col("new_region_body").alias("body"))
    by_region = layout.replaced_regions(sound.select("doc_id", "text"), new).select("doc_id", F.col("text").alias("replaced"))
    after = sound.join(by_region, "doc_id").select(F.col("doc_id").alias("record_id"), "path", F.col("text").alias("before"), F.coalesce("new_doc_text", "replaced").alias("after"))
    told = patches(after, "record_id").select("record_id", "patch")
    out = rows.select("record_id", "problem", "path").join(told, "record_id", "left")
    return out.select("record_id", "problem", F.col("patch").isNotNull().alias("applied"), "path", "patch")
