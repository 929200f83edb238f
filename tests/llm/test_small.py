"""Edge cases and brute-force comparisons of the training-data operators on small inputs."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docledger.llm import chat, components, decontamination, language, line_dedup, lm_scoring, mixing, ngram_join, paragraph_dedup, quality, sharding, shingles
from docledger.llm.common import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sample(n=60, seed=5):
    """Documents with copies, near copies, repeated lines, nulls, empties and ties."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 120))) for _ in range(n)]
    for i in range(0, n, 4):
        w = texts[i].split()
        w[len(w) // 2] = "edited"
        texts[i + 1] = " ".join(w)
        texts[i + 2] = texts[i] if i % 8 == 0 else texts[i + 2] + "\n" + texts[0]
    texts += [None, "", " \t\n", "One", "ONE", "a\nb\na", texts[0]]
    return [(i, t, "en" if i % 3 else "de", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return stage(spark.createDataFrame(sample(), DOCS), "docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# Mixing.


def test_targets_reshare_what_a_source_cannot_take(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 400), (None, 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, (5, 2, 1), 1.5, 2.0).collect()}
    assert got["a"] == 20 and math.isclose(sum(got.values()), 900)
    assert got["b"] == 200 and got[None] == 180 and got["c"] == 500


def test_mix(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1)], "doc_id long, quality int")
    narrow = mixing.weighted_documents(docs.select("doc_id", "source", "text"), labels)
    got = mixing.mix(narrow).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(narrow).collect()))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(narrow, buckets=2).collect()))
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_mix_of_nothing_and_of_empty_texts(spark, none):
    narrow = lambda d: mixing.weighted_documents(d.select("doc_id", "source", "text"), spark.createDataFrame([], "doc_id long, quality int"))
    assert mixing.mix(narrow(none)).count() == 0
    empty = spark.createDataFrame([(1, "s", None), (None, None, "")], "doc_id long, source string, text string")
    assert [r["taken"] for r in mixing.mix(narrow(empty)).collect()] == [0, 0]


def test_mixed_documents_repeat_rows(spark, docs):
    out = mixing.mixed_documents(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.columns == docs.columns
    assert max(Counter(r["doc_id"] for r in out.collect()).values()) == 2


# Chat.


def test_preference_pairs(spark):
    rows = [(1, True, 10, 0, "user", "hi"), (1, True, 10, 1, "assistant", "good"), (1, False, 11, 0, "user", "hi"), (1, False, 11, 1, "assistant", "bad"), (1, False, 11, 2, None, None), (2, True, 12, 0, "user", "alone"), (3, True, 14, 0, "user", "x"), (3, False, 15, 0, "user", "x"), (None, True, 1, 0, "user", "lost")]
    got = {r["pair_id"]: r for r in chat.preference_pairs(spark.createDataFrame(rows, "pair_id long, chosen boolean, conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 3}
    r = got[1]
    assert (r["n_common"], r["prompt"]) == (1, "<|user|>\nhi<|end|>\n")
    assert [tuple(s) for s in r["chosen"]] == [("<|assistant|>\n", False), ("good<|end|>\n", True)]
    assert [s["train"] for s in r["rejected"]] == [False, True, False, False]
    assert got[3]["n_common"] == 1 and got[3]["chosen"] == [] and got[3]["rejected"] == []
    # what is rendered is all turns
    assert r["prompt"] + "".join(s["text"] for s in r["rejected"]) == "<|user|>\nhi<|end|>\n<|assistant|>\nbad<|end|>\n<|unknown|>\n<|end|>\n"


def test_pairs_share_all_but_the_last_answer(spark):
    rows = [(4, 0, "user", "hi"), (4, 1, "assistant", "good"), (4, 2, "user", "more"), (4, 3, "assistant", "yes"), (4, 4, "user", "bye"), (5, 0, "user", "x"), (5, 1, "assistant", "no"), (6, 0, None, "alone"), (7, 0, "assistant", "a"), (7, 0, "assistant", "a"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat.preference_pairs(chat.against_own_answers(df)).select("pair_id", "n_common", "chosen", "rejected", chat.spans(F.col("rejected")).alias("spans")).collect()}
    assert {i: r["n_common"] for i, r in got.items()} == {4: 3, 5: 1, 6: 1, 7: 0}
    text = lambda s: "".join(x["text"] for x in s)
    assert text(got[4]["rejected"]) == text(got[4]["chosen"]).replace("yes", "no") and got[6]["chosen"] == []
    for r in got.values():
        parts = [text(r["rejected"])[int(a) : int(b)] for a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert parts == [x["text"] for x in r["rejected"] if x["train"]]
    assert chat.preference_pairs(chat.against_own_answers(df.where("false"))).count() == 0


# LM scoring.


def test_scores_do_not_depend_on_blocks_and_base_is_right(spark, docs):
    d = docs.select("doc_id", "text")
    one = by_id(lm_scoring.score(d, lm_scoring.folds()))
    many = by_id(lm_scoring.score(d, lm_scoring.folds(), block_bytes=700, range_bytes=900))
    tokens = {r[0]: [*words(r[1]), None] for r in sample()}
    c = Counter(t for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in w)
    total = sum(c.values())
    for i, w in tokens.items():
        base = sum(math.log10((c[t] + 1) / (total + len(c) + 1)) for t in w)
        assert math.isclose(one[i]["base_score"], base, rel_tol=1e-9)
        assert math.isclose(one[i]["score"], many[i]["score"], rel_tol=1e-9)
        assert (one[i]["n_tokens"], one[i]["n_known"], one[i]["train_tokens"]) == (len(w), sum(c[t] > 0 for t in w), total)


def test_model_is_a_distribution():
    w = lm_scoring.learn_weights(__import__("pandas").DataFrame({"bucket": [0, 3], "two": [-999, 8], "one": [-999, 2], "n": [5, 9]}))
    assert np.allclose(w.sum(1), 1) and (w > 0).all() and w[3, 0] > w[0, 0]


def test_score_of_nothing(none):
    assert lm_scoring.score(none.select("doc_id", "text"), lm_scoring.folds()).count() == 0


def test_large_ids_beside_a_null(spark):
    ids = [2**53 + 2 * i + 1 for i in range(50)]
    rows = [*((i, f"a b {i}") for i in ids), (None, "a b"), (ids[0], f"a b {ids[0]}")]
    out = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(lm_scoring.COUNTED)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    assert len({r["score"] for r in out if r["doc_id"] == ids[0]}) == 1


# Language.


def test_gradients():
    rng = np.random.default_rng(0)
    m = language.new_model(["a", "b"])
    x, y = rng.integers(97, 100, (6, 12)).astype(np.uint8), np.array([0, 1] * 3)
    _, grads = language.loss_and_gradients(m, x, y)
    for p, g in zip(m.parameters, grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = p[i], 1e-2
        p[i] = old + e
        up = language.loss_and_gradients(m, x, y)[0]
        p[i] = old - e
        down = language.loss_and_gradients(m, x, y)[0]
        p[i] = old
        assert math.isclose((up - down) / (2 * e), g[i], rel_tol=0.02, abs_tol=1e-4)


def test_pooling_covers_every_position():
    m = language.new_model(["a", "b", "c"])
    texts = [b"abc", b"", b"x" * 64, bytes(range(32, 127)) * 3]
    assert np.allclose(language.run_states(m, language.cut(texts)[0]), language.states(m, language.cut(texts)[0])[0], atol=1e-5)
    got = language.pooled(m, texts)
    for t, p in zip(texts, got, strict=True):
        each = [language.label_positions(m, np.frombuffer(t[i : i + 64].ljust(64, b"\0"), np.uint8)[None])[: len(t) - i, 0] for i in range(0, len(t), 64)]
        assert np.allclose(p, np.concatenate(each).mean(0) if t else 0, atol=1e-5)


def test_language_of_small_tables(spark, none):
    rows = [(i, ("aba " if i % 2 else "xyx ") * 30, "l1" if i % 2 else "l2", None, 0) for i in range(60)] + [(100, None, None, None, 0), (101, "12 !?", "l1", None, 0), (102, "", None, None, 0), (None, "aba aba", None, None, 0)]
    got = language.identify(spark.createDataFrame(rows, DOCS)).collect()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["language"]["lang_pred"] == by[i]["lang"] for i in range(60))
    assert {by[i]["language"]["lang_pred"] for i in (100, 101, 102)} == {"und"} and by[None]["held_out"] is False
    assert all(0 <= r["language"]["score"] <= 1 for r in got)
    assert language.identify(none).count() == 0


@pytest.mark.parametrize("doc_id", range(1, 6))
def test_sample_of_repeated_rows_is_bounded_and_has_every_language(spark, doc_id):
    rows = [(doc_id, "one text that repeats " * 9, "l1")] * 3000 + [(i + 10, f"other words {i} " * 9, "l2") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = Counter(r["lang"] for r in language.sample_windows(df, F.lit(True), fit_docs=20, fit_windows=60).select("lang").collect())
    assert set(drawn) == {"l1", "l2"} and max(drawn.values()) <= 80


def test_keeping_what_is_likelier_than_chance(spark):
    for n in (1, 2):
        rows = [(i, ("aba " if i % 2 else "xyx ") * 30, f"l{i % n}", None, 0) for i in range(60)] + [(100, "12", "l0", None, 0), (101, None, None, None, 0)]
        kept = {r["doc_id"] for r in language.keep_identified(spark.createDataFrame(rows, DOCS)).collect()}
        assert kept == set(range(60))


# Quality.


def brute_statistics(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    texts = [*(r[1] for r in sample(20)), " ".join(f"w{x}" for x in np.random.default_rng(1).integers(0, 60, 140_000)), "a b c a b c", "x x x x", "é#é\n\n|\n|", "a b c d a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [brute_statistics(t) for t in texts]
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = by_id(quality.statistics(df))
    assert [tuple(got[i][c] for c in columns) for i in range(len(texts))] == want


def test_rules_are_learned_and_ordered(spark):
    rng = np.random.default_rng(3)
    rows = [(bool(a > 0.8 or b < 0.1), float(d), float(a), float(b)) for a, b, d in rng.random((600, 3))]
    df = spark.createDataFrame(rows, "bad boolean, draw double, x double, y double")
    rules = quality.learn_decision_list(df, ("x", "y"))
    kept = df.withColumn("kept", quality.verdict(rules)).where("kept = bad").count()
    assert len(rules) >= 2 and kept <= 12
    assert quality.learn_decision_list(df.where("false"), ("x", "y")) == []
    assert quality.learn_decision_list(df.where("not bad"), ("x", "y")) == []


def test_quality_without_labels(spark, docs):
    out = by_id(quality.quality(docs, spark.createDataFrame([], "doc_id long, quality int")))
    assert all(out[i]["kept"] is not out[i]["base_failed"] for i in out)


# Lines.


def brute_lines(rows):
    lines = []
    for i, t, *_ in rows:
        for n, x in enumerate((t or "").split("\n")):
            if w := WORD.findall(x):
                lines.append(((i, n), w))

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < line_dedup.LEAST_WORDS or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    return {at for k, (at, w) in enumerate(lines) if any(near(w, v) for _, v in lines[:k])}


def test_repeated_lines(spark):
    base = [f"w{i}" for i in range(12)]
    extra = [base, base[:5] + ["x"] + base[6:], base[:3] + base[4:], [*base, "y"], ["z", *base], base[:5] + ["q"] + base[6:], base[1:] + ["y"], base[:7], base[:6]]
    rows = [*sample(24), *[(1000 + k, " ".join(w), None, None, 0) for k, w in enumerate(extra)]]
    got = line_dedup.repeated_lines(spark.createDataFrame(rows, DOCS).select("doc_id", "text")).collect()
    assert {(r["doc_id"], r["line_no"]) for r in got} == brute_lines(rows)


def test_lines_of_nothing(none):
    assert line_dedup.repeated_lines(none.select("doc_id", "text")).count() == 0


# Shards.


def test_shards(docs, none, spark):
    for n in (8, 5):
        got = sharding.shard_documents(docs, n).collect()
        assert len(got) == docs.count()
        per = {s: [r for r in got if r["shard"] == s] for s in range(n)}
        assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in per.values())
        sizes = [sum(r["size"] for r in v) for v in per.values()]
        assert max(sizes) - min(sizes) <= 3 * max(r["size"] for r in got)
    clash = docs.withColumns({c: F.lit(1) for c in ("tie", "node", "shard", "slot", "dim_size")})
    assert sharding.shard_documents(clash).count() == docs.count()
    assert sharding.shard_documents(none).count() == 0
    text = {r[0]: r[1] for r in sample()}
    assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) and r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 for r in got)
    same = spark.createDataFrame([(1, "x")] * 40 + [(None, None)], "doc_id long, text string")
    assert sharding.shard_documents(same).count() == 41


def test_repeated_rows_are_cut_apart(spark):
    rows = [(7, "x" * 1000)] * 400 + [(i, f"{i} " * 200) for i in range(400)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 4 * max(r["size"] for r in got)


def test_shards_by_narrowing(docs, monkeypatch):
    want = sorted(map(tuple, sharding.shard_documents(docs).select("doc_id", "shard").collect()))
    monkeypatch.setattr(sharding, "SORT_ROWS", 1)
    monkeypatch.setattr(sharding, "BINS", 3)
    got = sharding.shard_documents(docs).select("size", "shard").collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(want) == len(got) and max(sizes.values()) - min(sizes.values()) <= 3 * max(r["size"] for r in got)


# Jaccard join.


def brute_components(rows, k=4, num=85, den=100):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [ngram_join.BLOCK_SHINGLES, 120])
def test_link_components(docs, block):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(docs, block_shingles=block).collect()}
    assert got == brute_components(sample())


class Rough(ngram_join.Levels):
    """Signatures that find too little, of sets that are all known to be doubtful."""

    def sign(self, s):
        return np.unique(s)[:1] * np.uint64(3)

    def doubtful(self, s):
        return True


class Lopsided(ngram_join.Levels):
    """Sets whose ranges are all uneven when dealt anew."""

    def doubtful(self, s):
        return False

    def lopsided(self, s):
        return True


def passages(n=90, seed=5):
    """Documents that share passages, so that candidates chain, among them near copies."""
    rng = np.random.default_rng(seed)
    word = lambda m: [f"w{x}" for x in rng.integers(0, 5000, m)]
    shared, rows = [word(30) for _ in range(3)], []
    for i in range(n):
        if i % 3 == 2:
            w = rows[int(rng.integers(len(rows)))][1].split()
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(len(w)))] = "edit"
        else:
            w = word(int(rng.integers(20, 120))) + shared[int(rng.integers(3))] + shared[int(rng.integers(3))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("block", "levels"), [(150, ngram_join.Levels), (2500, ngram_join.Levels), (150, Lopsided)])
def test_large_candidate_components_are_taken_apart(spark, block, levels):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(df, k=5, num=80, den=100, block_shingles=block, levels=levels(80, 100, 2**31)).collect()}
    assert got == brute_components(rows, 5, 80, 100)


def test_uneven_sets_are_joined_by_prefixes(docs):
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_components(docs, levels=Rough(85, 100, 2**31)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(sample()).items()}


def test_huge_sets_are_linked():
    rng = np.random.default_rng(6)
    a = np.unique(rng.integers(0, 2**63, 80_000, dtype=np.uint64))
    b = np.unique(np.concatenate((a[: int(len(a) * 0.95)], rng.integers(0, 2**63, 900, dtype=np.uint64))))
    trie = ngram_join.Trie([a, b])
    assert trie.counts.dtype == np.uint32 and ngram_join.link_sets(np.array([1, 2]), [a, b], 85, 100) == [(1, 2)]


def test_signatures_miss_no_link():
    levels, rng = ngram_join.Levels(85, 100, 2**31), np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(3, 200))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        k = int(rng.integers(0, n // 6 + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[: n - k // 2], rng.integers(0, 2**63, k - k // 2, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and not (ngram_join.uneven(a, levels) or ngram_join.uneven(b, levels)):
            assert len(np.intersect1d(ngram_join.signatures(a, levels), ngram_join.signatures(b, levels)))


@pytest.mark.parametrize(("num", "den"), [(80, 100), (85, 100), (9, 10)])
def test_linked_sets_share_as_many_signatures_as_demanded(num, den):
    levels, rng = ngram_join.Levels(num, den, 2**31), np.random.default_rng(3)
    seen = 0
    for _ in range(2000):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.uint64) * np.uint64(2))
        k = int(rng.integers(0, len(a) * (den - num) // den + 2))
        b = np.unique(np.concatenate((rng.permutation(a)[: max(1, len(a) - int(rng.integers(0, k + 1)))], rng.integers(0, 2**63, k // 2, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if len(a) == len(b) == both or den * both < num * (len(a) + len(b) - both) or ngram_join.uneven(a, levels) or ngram_join.uneven(b, levels):
            continue
        level = max(levels.of(len(a)), levels.of(len(b)))
        shared = len(np.intersect1d(ngram_join.level_signatures(a, levels, level), ngram_join.level_signatures(b, levels, level)))
        filled = max(levels.filled(a, level), levels.filled(b, level))
        assert shared >= levels.common(level, filled, levels.differ(len(a), len(b)))
        for s in (a, b):
            own, *demands = levels.demands(s)
            assert shared >= demands[1 if level == own else 3]
        seen += 1
    assert seen > 500


@pytest.mark.parametrize("size", [1, 3, 50])
def test_rows_of_signatures_by_batches(size):
    levels, rng = ngram_join.Levels(80, 100, 2**31), np.random.default_rng(4)
    sigs = np.repeat(np.arange(60), rng.integers(1, 25, 60))
    rows = sorted({(int(s), int(k)) for s, k in zip(sigs, rng.integers(0, 30, len(sigs)), strict=True)})
    batches = lambda x, names: (pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in x[i : i + size]]) for i in range(0, len(x), size))
    count = Counter(s for s, _ in rows)
    got = [tuple(r.values()) for b in ngram_join._shared(batches(sorted(rows + rows[::3]), ("sig", "key"))) for r in b.to_pylist()]
    assert got == [r for r in rows if count[r[0]] > 1]
    level, filled = levels.of(100), 20
    wide = [(s, k, 100, level, filled, 5) for s, k in rows]
    got = Counter((r["sig"], r["a"], r["b"], r["least"]) for b in ngram_join._buckets(batches(wide, ("sig", "key", "n", "level", "filled", "least")), levels) for r in b.to_pylist())
    need = max(1, filled - levels.differ(100, 100))
    want = Counter((s, k, None, 5) for s, k in rows if count[s] > ngram_join.SMALL_BUCKET)
    want += Counter((s, a, b, need) for (s, a), (t, b) in itertools.combinations(rows, 2) if s == t and count[s] <= ngram_join.SMALL_BUCKET)
    assert got == want


def family(copies=40, others=60, seed=7):
    """Near copies of one text, more than a small bucket holds, and texts that share passages with each other and with them."""
    rng = np.random.default_rng(seed)
    word = lambda m: [f"w{x}" for x in rng.integers(0, 50000, m)]
    parts, rows = [word(40) for _ in range(6)], []
    first = [w for i in rng.permutation(6)[:4] for w in parts[i]] + word(200)
    for _ in range(copies):
        w = list(first)
        for at in rng.integers(len(w), size=int(rng.integers(0, 7))):
            w[int(at)] = f"e{at}"
        rows.append(w)
    rows += [word(60) + [w for i in rng.permutation(6)[:4] for w in parts[i]] + word(60) for _ in range(others)]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_texts_that_share_passages_are_no_candidates(spark):
    rows = family()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(df, k=5, num=80, den=100).collect()}
    assert got == brute_components(rows, 5, 80, 100)
    levels = ngram_join.Levels(80, 100, 2**31)
    named = df.selectExpr("xxhash64(doc_id) row_key", "text", "doc_id").mapInArrow(lambda b: ngram_join._name_sets(b, 5, levels), ngram_join.NAMED).cache()
    ids = {r["key"]: r["doc_id"] for r in named.collect()}
    found = {ids[x] for r in ngram_join._candidates(df, named, 5, levels).collect() for x in r}
    assert found and all(i < 40 for i in found)


def test_keep_one(spark, docs, none):
    rows = sample()
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs).collect()}
    assert kept == {i for i, (n, c) in brute_components(rows).items() if i == c}
    twice = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, None, "y"), (None, "q r s t u", "z")], "doc_id long, text string, row_keys string")
    assert sorted(map(str, ngram_join.keep_one(twice).select("doc_id").collect())) == ["Row(doc_id=1)", "Row(doc_id=2)", "Row(doc_id=None)"]
    assert ngram_join.keep_one(none).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 130)}) == 1 and got[0] != got[100]


def test_word_hashes_are_pieced_together(monkeypatch):
    text = ("ab  Cd\té " * 50 + "x" * 300).encode()
    whole, _ = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "PIECE", 40)
    monkeypatch.setattr(shingles, "_POWERS", [])
    pieces, _ = shingles.word_hashes(text)
    assert (whole == pieces).all() and len(whole) == 151 and len(set(whole.tolist())) == 4


# Paragraphs.


def test_bands_reach_recall():
    b, r = paragraph_dedup.tune_bands(0.8)
    assert 1 - (1 - 0.8**r) ** b >= paragraph_dedup.RECALL


def test_repeated_substrings(spark, none):
    rng = np.random.default_rng(2)
    w = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 10**6, n))
    passage, para = ". ".join(w(9) for _ in range(6)) + ".", w(70)
    edited = para.split()
    edited[30] = "changed"
    rows = [(1, w(20) + ". " + passage + " " + w(20)), (2, w(30) + ". " + passage + " " + w(10)), (3, para), (4, w(50) + "\n" + " ".join(edited)), (5, w(100)), (6, w(60) + "\n" + w(60)), (7, None), (8, ""), (9, w(90)), (9, None)]
    got = paragraph_dedup.repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["kind"], r["class_doc_id"], r["removed"]) for r in got} == {(1, "passage", 1, False), (2, "passage", 1, True), (3, "paragraph", 3, False), (4, "paragraph", 3, True)}
    assert paragraph_dedup.repeated_substrings(none.select("doc_id", "text")).count() == 0


# Decontamination.


def brute_overlaps(docs, items):
    out = {}
    for (d, t), (i, b) in itertools.product(docs, items):
        x, y = words(t), words(b)
        if t is None or b is None or not y:
            continue
        for start in range(-len(y), len(x)):
            agree = [0 <= start + k < len(x) and x[start + k] == y[k] for k in range(len(y))]
            best = max(sum(agree[k : k + 13]) for k in range(max(1, len(y) - 12)))
            if best >= 11 if len(y) >= 13 else best * 5 >= len(y) * 4:
                out[d, i] = max(out.get((d, i), 0), best)
    return out


def test_masks_find_every_placement_of_substitutions():
    def hit(mask, n, off):
        return any(all(s + k not in off for k, c in enumerate(mask) if c == "1") for s in range(n - len(mask) + 1))

    for n in range(5, 14):
        most = n - -(-4 * n // 5)
        masks = decontamination.MASKS[13 if n == 13 else 5]
        assert all(any(hit(m, n, off) for m in masks) for off in itertools.combinations(range(n), most))


@pytest.mark.parametrize("limit", [200_000, 0])
def test_overlaps(spark, none, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", limit)
    rng = np.random.default_rng(4)
    w = lambda n: [f"v{x}" for x in rng.integers(0, 60, n)]
    items = [(k, " ".join(w(n))) for k, n in enumerate((13, 30, 6, 5, 4, 12))] + [(91, "v7 rare v9"), (92, "v8 rare"), (93, "rare"), (94, " "), (90, None)]
    rows = []
    for d in range(40):
        text = w(int(rng.integers(0, 40)))
        b = (items[d % 6][1]).split()
        for at in rng.integers(0, len(b), d % 4):
            b[at] = "sub"
        rows.append((d, " ".join(text + b[: len(b) - d % 3] + w(5)).upper() if d % 2 else " ".join(b)))
    rows += [(None, items[1][1]), (77, None), (78, ""), (79, "x v7 Rare v9"), (80, "v8 x rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.overlaps(df, bench).groupBy("doc_id", "item_id").agg(F.max("n_agree").alias("n")).collect()
    assert {(r["doc_id"], r["item_id"]): r["n"] for r in found} == brute_overlaps(rows, items)
    clean = decontamination.decontaminate(df, bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in brute_overlaps(rows, items)}
    assert decontamination.overlaps(none.select("doc_id", "text"), bench).count() == 0
    assert decontamination.overlaps(df, bench.where("false")).count() == 0
