"""Verdicts on repeated passages and paragraphs, held against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from docledger.llm import paragraph_dedup, shingles


def words(seed=3):
    rng = np.random.default_rng(seed)
    return lambda n: " ".join(f"t{x}" for x in rng.integers(0, 10**6, n))


def left_of(spark, rows, least=30):
    """Words that stay in each document."""
    got = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), least=least).where("removed").collect()
    gone = {(r["doc_id"], p) for r in got for p in range(r["first_word"], r["last_word"] + 1)}
    return {i: [x for p, x in enumerate(t.lower().split()) if (i, p) not in gone] for i, t in rows}


def test_every_repeated_sentence_keeps_one_copy(spark):
    w = words()
    a, b = [". ".join(w(9) for _ in range(6)).split(". ") for _ in range(2)]
    text = lambda *s: ". ".join(s) + "."
    # La stands first in document 1; the sentences of b stand first in document 2, in one run with La
    rows = [(1, text(w(20), *a[:3], "La", *a[3:], w(20))), (2, text(w(30), *b[:3], "La", *b[3:], w(10))), (3, text(w(25), *a[:3], "La", *a[3:], w(12))), (4, text(w(15), *b[:3], "La", *b[3:], w(22)))]
    left = " ".join(" ".join(x) for x in left_of(spark, rows).values())
    assert {s: left.count(f"{s}.") for s in [*a, *b]} == dict.fromkeys([*a, *b], 1)
    assert left.count("la.") == 2  # one in each passage that stays


def test_passages_in_mid_sentence(spark):
    w = words(7)
    p, q = w(51).split(), w(53).split()
    edited = [*q[:26], "changed", *q[27:]]
    wrapped = "  ".join(p[:20]).upper() + "\n" + " ".join(p[20:])
    rows = [(1, f"{w(80)} {' '.join(p)} {w(40)}"), (2, f"{w(33)} {wrapped} {w(90)}"), (3, f"{w(60)} {' '.join(q)} {w(60)}"), (4, f"{w(50)} {' '.join(edited)} {w(70)}")]
    left = left_of(spark, rows, 50)
    assert [len(left[i]) for i in (1, 2, 3, 4)] == [171, 123, 173, 121]
    assert left[4][50] == "changed"
    assert {i: "".join(left[i]).count("".join(x)) for i, x in ((1, p), (2, p), (3, q))} == {1: 1, 2: 0, 3: 1}


def test_passages_of_exactly_the_least_words(spark):
    w = words(17)
    p, q = w(50), w(49)
    rows = [(1, f"{w(9)} {p}"), (2, f"{p} {w(60)}"), (3, f"{w(30)} {q} {w(9)}"), (4, f"{w(8)} {q} {w(50)}")]
    left = left_of(spark, rows, 50)
    assert [len(left[i]) for i in (1, 2, 3, 4)] == [59, 60, 88, 107]


def shared_with_others(text, i, p):
    """Words around place p of text i that another text has in the same order."""
    best = 0
    for j, other in enumerate(text):
        for q in (q for q, v in enumerate(other) if j != i and v == text[i][p]):
            lo, hi = 0, 0
            while min(p, q) > lo and text[i][p - lo - 1] == other[q - lo - 1]:
                lo += 1
            while max(p + hi + 1 - len(text[i]), q + hi + 1 - len(other)) < 0 and text[i][p + hi + 1] == other[q + hi + 1]:
                hi += 1
            best = max(best, lo + hi + 1)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_passages_against_all_pairs_of_words(spark, seed):
    """Words of long equal runs go but for one copy; what goes stands in another document."""
    rng, least = np.random.default_rng(seed), 30
    w = words(seed + 40)
    shared = [w(int(n)).split() for n in rng.integers(20, 90, 6)]
    rows = []
    for i in range(14):
        t = w(int(rng.integers(0, 30))).split()
        for k in rng.integers(0, 6, int(rng.integers(0, 4))):
            a, b = sorted(rng.integers(0, len(shared[k]) + 1, 2))
            t += (shared[k] if rng.random() < 0.5 else shared[k][a:b]) + w(int(rng.integers(0, 9))).split()
        rows.append((i, " ".join(t)))
    text = [t.split() for _, t in rows]
    longest = [[0] * len(t) for t in text]  # the longest run with another place that each word is in
    for x, y in itertools.product(range(len(text)), repeat=2):
        at = {}
        for j, v in enumerate(text[y]):
            at.setdefault(v, []).append(j)
        for i, j in ((i, j) for i, v in enumerate(text[x]) for j in at.get(v, ()) if (x, i) != (y, j) and (i == 0 or j == 0 or text[x][i - 1] != text[y][j - 1])):
            n = 0
            while i + n < len(text[x]) and j + n < len(text[y]) and text[x][i + n] == text[y][j + n]:
                n += 1
            for k in range(i, i + n):
                longest[x][k] = max(longest[x][k], n)
    left = left_of(spark, rows, least)
    got = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), least=least).collect()
    covered = {(r["doc_id"], p) for r in got for p in range(r["first_word"], r["last_word"] + 1)}
    assert all(longest[i][p] >= paragraph_dedup.GRAM for i, p in covered)
    # runs that two documents share are found; ends are those of the first occurrence, which may be shorter
    assert all((i, p) in covered for i, t in enumerate(text) for p in range(len(t)) if shared_with_others(text, i, p) >= least + 2 * paragraph_dedup.CONTEXT)
    counts = lambda texts: {v: sum(v in t for t in texts) for v in {v for t in text for v in t}}
    before, after = counts(text), counts(left.values())
    assert all(after[v] >= 1 for v in before)


def test_passages_survive_their_removed_paragraphs(spark):
    w = words(9)
    # document 2 is removed as a near copy of 1, so the passage that only it shares with 3 stays in 3
    p, tail = w(32), w(400)
    rows = [(1, f"{w(32)} {tail}"), (2, f"{p} {tail}"), (3, f"{w(300)} {p} {w(90)}")]
    got = paragraph_dedup.repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 30).collect()
    assert {(r["doc_id"], r["kind"], r["removed"]) for r in got} == {(1, "paragraph", False), (2, "paragraph", True)}


def test_short_and_wrapped_paragraphs(spark):
    w = words(11)
    near = lambda t, i: " ".join([*t.split()[:i], "changed", *t.split()[i + 1 :]])
    wrap = lambda t: "\n".join(" ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    short, line, wrapped, block = w(3), w(50), w(60), w(70)
    rows = [(1, short), (2, f" {short}"), (3, f"{line}\n{w(9)}"), (4, f"{w(8)}\n\n{near(line, 49)}"), (5, wrapped), (6, f"{w(12)}\n\n{wrap(wrapped)}\n\n{w(7)}"), (7, wrap(block)), (8, wrap(near(block, 35))), (9, "ok"), (10, ""), (11, " "), (12, None)]
    got = paragraph_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {(1, 0, 0, False), (2, 0, 0, True), (3, 0, 0, False), (4, 2, 2, True), (5, 0, 0, False), (6, 2, 8, True), (7, 0, 7, False), (8, 0, 7, True)}
    assert {(r["doc_id"], r["first_line"], r["last_line"], r["removed"]) for r in got} == want


@pytest.mark.parametrize("block", [10**6, 150])
def test_paragraphs_against_all_pairs(spark, block):
    rng, w, least = np.random.default_rng(5), words(21), 8
    base, rows = [w(int(n)).split() for n in rng.integers(4, 60, 12)], []
    for i in range(40):
        lines = []
        for k in rng.integers(0, 12, int(rng.integers(1, 4))):
            t = list(base[k])
            for p in rng.integers(0, len(t), int(rng.integers(0, 3))):
                t[p] = w(1)
            lines.append(" ".join(t).upper() if i % 5 == 0 else "  ".join(t))
        rows.append((i, "\n".join(lines)))
    rows += [rows[0], (None, rows[1][1])]  # a row twice is one document; a null doc_id goes first
    units = {}
    for i, t in dict.fromkeys(rows):
        own = [(n, x.lower().split()) for n, x in enumerate(t.split("\n"))]
        long = [(n, n, x) for n, x in own if len(x) >= least]
        for a, b, x in long or [(0, len(own) - 1, [v for _, x in own for v in x])]:
            units[(i is not None, i or 0, a, b)] = {tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4))}
    root = {u: u for u in units}

    def find(u):
        return u if root[u] == u else find(root[u])

    for a, b in itertools.combinations(sorted(units), 2):
        if 5 * len(units[a] & units[b]) >= 4 * len(units[a] | units[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    classes = {}
    for u in sorted(units):
        classes.setdefault(find(u), []).append(u)
    want = {(u[1] if u[0] else None, u[2], u[3], u != c[0]) for c in classes.values() if len({u[:2] for u in c}) > 1 for u in c}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = paragraph_dedup.repeated_paragraphs(docs, paragraph_dedup.scan(docs, least), block).collect()
    assert {(r["doc_id"], r["first_line"], r["last_line"], r["removed"]) for r in got} == want


def test_bands_find_what_they_promise():
    """Share of pairs just at the threshold that bands bring together."""
    rng, bands = np.random.default_rng(1), paragraph_dedup.Bands()
    found = 0
    for _ in range(1000):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (80, 10, 10))
        sigs = bands.sign(np.concatenate((both, a, both, b)), np.array([0, 90]))
        found += (sigs[0] == sigs[1]).any()
    assert found >= 980


def test_long_paragraphs_are_signed_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(2)
    h, starts = rng.integers(0, 2**63, 500, dtype=np.uint64), np.array([0, 3, 200, 201])
    whole = paragraph_dedup.Bands().sign(h, starts)
    monkeypatch.setattr(paragraph_dedup, "AT_ONCE", 7)
    assert (paragraph_dedup.Bands().sign(h, starts) == whole).all()


def test_texts_beyond_a_piece(spark, monkeypatch):
    w = words(31)
    p = w(60)
    rows = [(1, f"{w(700)}\n{p} {w(500)}"), (2, f"{w(900)} {p}\n{w(400)}"), (3, w(5))]
    want = left_of(spark, rows)
    texts = [t.encode() for _, t in rows]
    monkeypatch.setattr(paragraph_dedup, "GROUP", 300)
    monkeypatch.setattr(shingles, "PIECE", 300)
    monkeypatch.setattr(shingles, "_POWERS", [])
    small = list(paragraph_dedup.pieces(texts))
    monkeypatch.undo()
    (one,) = paragraph_dedup.pieces(texts)
    assert len(small) == 3 and (np.concatenate([x.words for x in small]) == one.words).all()
    assert [len(x.line) for x in small] == np.diff(one.cuts).tolist()
    assert [len(want[i]) for i in (1, 2, 3)] == [1260, 1300, 5]
