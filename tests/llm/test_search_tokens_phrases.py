"""Search, token files and phrases against brute force, and their small cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from docledger.llm import block_max, phrases, token_files

DOCS = "doc_id long, text string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# Search.


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, size = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, c in own:
            m = 50 + (50 * sum(c.values()) * n) // max(size, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, doc is not None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "rounds"), [(60, (1, 2)), (400, (2,)), (10**6, (8, 64))])
def test_search_is_that_of_all_documents(spark, block, rounds):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ß1", "日本"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "W1, w1;w1-w2"), (502, "W1, w1;w1-w2"), (None, "w1 w2 w3"), (503, "only \x00 here")]
    items = [(i, " ".join(rng.choices(vocabulary, k=6))) for i in range(8)] + [(20, None), (21, "nothing known"), (22, "w1"), (22, "w2 w2")]
    got = block_max.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), 7, rounds, block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, 7)


def test_search_of_empty_tables_and_other_columns(spark):
    docs, items = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, term int"), spark.createDataFrame([(1, "a", 2), (None, "a", 2)], "item_id long, text string, block int")
    assert [tuple(r)[:3] for r in block_max.search(docs, items).collect()] == [(1, 1, 1)]
    assert block_max.search(docs.limit(0), items).count() == 0 == block_max.search(docs, items.limit(0)).count()


def test_items_in_slices(spark, monkeypatch):
    monkeypatch.setattr(block_max, "SLICE_TERMS", 3)
    docs, items = [(i, f"a{i % 5} b{i % 3} c") for i in range(30)], [(i, f"a{i % 5} b1") for i in range(6)]
    got = block_max.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, 4)


# Token files.


def plain(texts):
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_words_are_encoded_as_in_their_text(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 30)
    rng, parts = random.Random(5), ["a", "B1", "é,", "ß", " ", " ", "  ", "\n", "\t", "'ll", "23", ".", "!", "<|endoftext|>", " ", "日本", "\x1c", "😀", " the", "　"]
    encoder = token_files.Encoder(TOKENIZER)
    for _ in range(20):
        texts = [None, "", " ", "a ", " a", *("".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(100))]
        ids, ends = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == plain(texts)


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_grammar_round_trip(kind):
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.tile(rng.integers(1, 50, 40), 30), np.zeros(3, int), np.full(99, 7), rng.integers(0, 60, 500)]).astype(kind)
    symbols, left, right = token_files.repair(ids, 100, rounds=6, least=2)
    assert len(symbols) < len(ids) / 2 and np.array_equal(token_files.expand(symbols, left, right, 100), ids)
    lengths = token_files.rule_lengths(left, right, 100)
    assert token_files._symbol_lengths(symbols, lengths, 100).sum() == len(ids)
    assert [len(token_files.expand(np.array([100 + i], kind), left, right, 100)) for i in range(len(left))] == lengths.tolist()
    assert (symbols == 0).sum() == (ids == 0).sum()


def test_files_and_random_access(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices(["the", "of", "Größe,", "x\ny", "new  line"], k=rng.randint(0, 60)))) for i in rng.sample(range(1000), 60)]
    docs += [(2000, None), (2001, ""), (None, "z"), (5000, "b"), (5000, "a"), (5000, "a")]
    shards = token_files.encode_shards(spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", seq int").repartition(3), TOKENIZER, shard_bytes=900).cache()
    assert shards.count() > 3
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    want, start = [], 0
    for (doc, _), ids in zip(order, plain([t for _, t in order]), strict=True):
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_files.digests(shards).collect()), key=lambda r: r[1])
    assert got == want
    once = {d: ids for (d, _), ids in zip(order, plain([t for _, t in order]), strict=True) if d is not None and d < 2002}
    spans = [(d, a, a + rng.randint(0, 30)) for d in once for a in (0, rng.randint(0, 20))] + [(2001, 0, 99), (77777, 0, 3), (None, 0, 1)]
    read = token_files.read_spans(shards, spark.createDataFrame(spans, "doc_id long, start int, stop int")).collect()
    assert sorted((r["doc_id"], r["start"], r["stop"], r["ids"]) for r in read) == sorted((d, a, b, once[d][a:b]) for d, a, b in spans if d in once)


def test_no_documents(spark):
    assert token_files.digests(token_files.encode_shards(spark.createDataFrame([], DOCS), TOKENIZER)).count() == 0


# Phrases.


def mined(docs, least, longest, top):
    out, f, total = [], Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {p: n for p, n in f.items() if n >= least and len(p[1]) > 1}
    for (lang, w), a in candidates.items():
        score, _, n_left, n_right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        held = any(x == lang and len(v) > len(w) and 100 * n >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), n in candidates.items())
        if not held:
            out.append((lang, -score, -a, " ".join(w).encode(), n_left, n_right))
    rows = []
    for lang in {x[0] for x in out}:
        rows += [(lang, r, p.decode(), -a, x, y, total[lang], -s) for r, (_, s, a, p, x, y) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1)]
    return sorted(rows)


@pytest.mark.parametrize(("least", "bits", "slice_bytes", "longest"), [(3, 16, 10**6, 4), (2, 6, 150, 4), (5, 12, 60, 3)])
def test_phrases_are_counted_exactly(spark, monkeypatch, least, bits, slice_bytes, longest):
    monkeypatch.setattr(phrases, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(phrases, "FAN_IN", 3)
    rng = random.Random(least)
    parts = ["New York", "new  york", "of\tthe", "the", "of", "a b c d", "a b c", "É", "x,", "y.", "z\n", "日本 語", "!", ""]
    docs = [(rng.choice(["en", "de", None]), " ".join(rng.choices(parts, k=rng.randint(0, 40)))) for _ in range(60)] + [("en", None), (None, ""), ("fr", "one two")]
    got = phrases.collocations(spark.createDataFrame(docs, "lang string, text string").repartition(4), longest, least, 9, bits)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == mined(docs, least, longest, 9)


def test_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string"), bits=10).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None, 1)], "lang string, text string, phrase int"), bits=10).count() == 0
    with pytest.raises(ValueError, match="least"):
        phrases.frequent_phrases(spark.createDataFrame([], "lang string, text string"), least=300)
