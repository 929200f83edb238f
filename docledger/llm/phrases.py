"""Phrase collocations by hashed bucket counts and Apriori pruning, counted exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, stage, table
from .shingles import mix, shingle_hashes, word_hashes

#: Words of a phrase at most, occurrences and percentage of a longer phrase at least, denominators and results as in the operator's contract.
LONGEST, LEAST, COVERED, SCALE, TOP = 4, 30, 80, 2_000_000, 2000
#: Binary logarithm of the number of buckets: 8 MB of bits each for frequent buckets and frequent phrases of a length.
BITS = 26
#: Buckets counted in one row, and rows that one task adds up.
BLOCK_BITS, FAN_IN = 19, 32
#: Bytes whose phrases are hashed at once, documents that a task reads at once.
SLICE_BYTES, BATCH = 4_000_000, 2000
#: Ranges of a language's phrases that are ranked first on their own.
SALTS = 32
#: A-Z lower-cased; sentence marks and line ends part pieces, tabs part words.
_PIECES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
_ROWS = "lang string, phrase string, hash long, n long, part long, block int, size int, buckets binary, counts binary"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("hash", pa.int64()), ("n", pa.int64()), ("part", pa.int64()), ("block", pa.int32()), ("size", pa.int32()), ("buckets", pa.binary()), ("counts", pa.binary())])


def _slices(data: bytes) -> Iterator[bytes]:
    """data in slices of whole pieces."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > SLICE_BYTES:
            cut = data.rfind(b"\n", at, at + SLICE_BYTES)
            cut = cut if cut > at else data.find(b"\n", at + SLICE_BYTES)
            end = cut if cut > at else len(data)
        yield data[at:end]
        at = end


class _Words:
    """Words of a slice, their hashes, places and pieces."""

    def __init__(self, data: bytes, seed: int) -> None:
        b = np.frombuffer(data, np.uint8)
        self.data, self.seed = data, np.uint64(seed)
        self.hashes, self.starts = word_hashes(data, lower=False)
        gap = np.concatenate(((b == 32) | (b == 10), [True]))
        self.ends = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
        self.piece = np.cumsum(b == 10, dtype=np.int32)[self.starts] if len(b) else self.starts
        self.grams: dict[int, np.ndarray] = {}

    def of(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the seed tells languages apart."""
        if k not in self.grams:
            self.grams[k] = mix(shingle_hashes(self.hashes, k) + self.seed) if len(self.hashes) >= k else self.hashes[:0]
        return self.grams[k]

    def within(self, k: int) -> np.ndarray:
        """Whether the k words from each word on stand in one piece."""
        n = max(len(self.hashes) - k + 1, 0)
        return self.piece[:n] == self.piece[k - 1 :]

    def phrase(self, at: int, k: int) -> str:
        raw = self.data[self.starts[at] : self.ends[at + k - 1]]
        return (raw if k == 1 else b" ".join(raw.split(b" ")) if b"  " not in raw else b" ".join(w for w in raw.split(b" ") if w)).decode("utf-8", "surrogatepass")


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - int(len(bits) * 8).bit_length() + 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _candidates(words: _Words, k: int, frequent: np.ndarray | None, buckets: np.ndarray | None) -> np.ndarray:
    """Positions of phrases of k words whose bucket is frequent and whose parts of k - 1 words both are.

    frequent holds hash bits of the phrases of k - 1 words, so it may let pass what is none, and never drops one.
    """
    keep = words.within(k)
    if frequent is not None:
        known = _held(frequent, words.of(k - 1))
        keep = keep & known[:-1] & known[1:]
    at = np.flatnonzero(keep)
    return at if buckets is None else at[_held(buckets, words.of(k)[at])]


def _bucket_rows(hashes: np.ndarray, bits: int, part: int) -> Iterator[pa.RecordBatch]:
    """Occurrences by bucket, at most 255 each, which decides any threshold up to it; a row per block of buckets."""
    at, n = np.unique((hashes >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
    per = min(BLOCK_BITS, bits)
    block = at >> np.uint32(per)
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(at)] if len(at) else [0]
    rows = [(part, int(block[a]), b - a, _planes(at[a:b] & np.uint32((1 << per) - 1)), np.minimum(n[a:b], 255).astype(np.uint8).tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
    if rows:
        yield _batch(dict(zip(("part", "block", "size", "buckets", "counts"), zip(*rows, strict=True), strict=True)))


def _planes(ascending: np.ndarray) -> bytes:
    """Differences of ascending numbers as byte planes, of which the upper ones are mostly zeros."""
    return np.diff(ascending.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel(), dtype=np.uint32)


def _batch(columns: dict) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of a language in slices of about SLICE_BYTES."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            for lang, text in zip(*(batch.column(i).slice(a, 256).to_pylist() for i in (0, 1)), strict=True):
                if text:
                    raw = text.encode("utf-8", "surrogatepass")
                    held.setdefault(lang, []).append(raw)
                    size[lang] = size.get(lang, 0) + len(raw)
                    if size[lang] >= SLICE_BYTES:
                        yield from ((lang, data) for data in _slices(b"\n".join(held.pop(lang)).translate(_PIECES)))
                        size[lang] = 0
    for lang, texts in held.items():
        yield from ((lang, data) for data in _slices(b"\n".join(texts).translate(_PIECES)))


def _pass(batches: Iterator[pa.RecordBatch], k: int, longest: int, bits: int, frequent: np.ndarray | None, buckets: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Counts of phrases of k words that may be frequent, and bucket counts of those of k + 1 words whose parts may be."""
    part = TaskContext.get().partitionId() << 20
    for lang, data in _by_lang(batches):
        words = _Words(data, _seed(lang))
        at = _candidates(words, k, frequent, buckets)
        hashes, first, n = np.unique(words.of(k)[at], return_index=True, return_counts=True)
        if len(hashes):
            yield _batch({"lang": [lang] * len(hashes), "phrase": [words.phrase(a, k) for a in at[first].tolist()], "hash": hashes.view(np.int64), "n": n})
        if k < longest:
            may = np.zeros(len(words.hashes), bool)
            may[at] = True
            longer = np.flatnonzero(words.within(k + 1))
            yield from _bucket_rows(words.of(k + 1)[longer[may[longer] & may[longer + 1]]], bits, part)
            part += 1


def _of_phrases(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 20
    for i, batch in enumerate(batches):
        yield from _bucket_rows(batch.column(0).to_numpy().view(np.uint64), bits, part + i)


def _add_up(pdf: pd.DataFrame, per: int) -> pd.DataFrame:
    """Counts of one block of buckets over up to FAN_IN rows."""
    total = np.zeros(1 << per, np.int32)
    for n, at, c in zip(pdf["size"], pdf["buckets"], pdf["counts"], strict=True):
        total[_numbers(at, n)] += np.frombuffer(c, np.uint8)
    at = np.flatnonzero(total)
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "block": [pdf["block"].iloc[0]], "size": [len(at)], "buckets": [_planes(at)], "counts": [np.minimum(total[at], 255).astype(np.uint8).tobytes()]})


def _bits(rows: DataFrame, bits: int, least: int, name: str) -> np.ndarray:
    """Bits of the buckets with least occurrences; 2 ** (bits - 3) bytes reach the driver, whatever the corpus.

    rows (part, block, size, buckets, counts) are added up in a tree of FAN_IN, so no task holds a block's rows of all parts (a slice of a task's texts each).
    """
    per = min(BLOCK_BITS, bits)
    schema = "part long, block int, size int, buckets binary, counts binary"
    rows = rows.select("part", "block", "size", "buckets", "counts")
    while True:
        groups = -(-rows.select("part").distinct().count() // FAN_IN)
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(max(groups, 1))))
        rows = dealt.groupBy("block", "part").applyInPandas(lambda pdf: _add_up(pdf, per), schema)
        if groups <= 1:
            break
        rows = stage(rows, name)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, at, c in zip(*(batch.column(x).to_pylist() for x in ("block", "size", "buckets", "counts")), strict=True):
                held = np.zeros(1 << per, np.uint8)
                held[_numbers(at, n)] = np.frombuffer(c, np.uint8) >= least
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()])], names=["block", "held"])

    out = np.zeros((1 << (bits - per), max((1 << per) // 8, 1)), np.uint8)
    for row in rows.mapInArrow(frequent, "block int, held binary").collect():
        out[row["block"]] = np.frombuffer(row["held"], np.uint8)
    return out.ravel()


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """All phrases of 1 to longest words with least occurrences or more, per lang, with exact counts.

    Pass k reads the texts, counts phrases of k words exactly and those of k + 1 words by bucket. A phrase is
    counted only if its bucket of the pass before is frequent and both its parts of k - 1 words are (looked up
    in bits of their hashes). Both bit sets have 2 ** bits bits whatever the corpus, are built by tasks in a tree
    and then broadcast. Bits only ever let too much pass: what is counted is summed by the phrase itself.
    Where a corpus fills the buckets they prune less, and more rows are summed, after each task has pre-aggregated.

    docs has lang and text; null langs are und, null and empty texts hold no phrase; a text is cut at piece ends
    only, so a very long piece is hashed at once. Rows that repeat count each. least is 255 at most.
    Empty tables give no rows. Returns lang, phrase, words, n and total, the lang's number of word occurrences.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must lie between 1 and 255")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    levels, totals, frequent, buckets = [], None, None, None
    for k in range(1, longest + 1):
        shared = spark.sparkContext.broadcast((frequent, buckets))
        run: Callable = lambda batches, k=k, shared=shared: _pass(batches, k, longest, bits, *shared.value)
        made = stage(rows.mapInArrow(run, _ROWS), f"phrases-{k}", BATCH)
        shared.unpersist()
        counted = made.where("block is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.min("hash").alias("hash"))
        if k == 1:
            totals = stage(made.where("block is null").groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
        level = stage(counted.where(F.col("n") >= least), f"frequent-{k}")
        levels.append(level.select("lang", "phrase", F.lit(k).alias("words"), "n"))
        if k < longest:
            buckets = _bits(made.where("block is not null"), bits, least, f"buckets-{k}")
            frequent = _bits(level.select("hash").mapInArrow(lambda batches: _of_phrases(batches, bits), _ROWS), bits, 1, f"known-{k}")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return join_small(out, totals, ["lang"])


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """The top phrases of 2 to longest words of each lang by how much their words belong together.

    A phrase with a occurrences, cut after k words into parts with l and r occurrences, scores
    2000000 * a div (l + r); the lowest cut counts, of equal ones the first. A phrase goes if a longer
    candidate holds its words in a row and has 80 percent of its occurrences. Products are decimals, so exact.
    A part of a candidate has as many occurrences at least, so all parts are among the frequent phrases.

    Ties, nulls and empty tables as in frequent_phrases. Returns lang, rank, phrase, a, l, r, n, score.
    """
    phrases = stage(frequent_phrases(docs, longest, least, bits), "phrases")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = phrases.where("words > 1").select("lang", "phrase", "total", F.col("n").alias("a"), F.split("phrase", " ").alias("w"), cut)
    joined = lambda *of: F.array_join(F.slice("w", *of), " ")
    cuts = cuts.select("lang", "phrase", "total", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    big = lambda x, n: F.col(x).cast("decimal(19,0)") * F.lit(n).cast("decimal(10,0)")
    score = F.call_function("div", big("a", SCALE), F.col("l").cast("decimal(19,0)") + F.col("r")).cast("long")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("total").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    longer = phrases.where("words > 2").select("lang", "n", F.split("phrase", " ").alias("w"), "words")
    parts = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " ")))))
    held = longer.select("lang", parts.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.col("most").isNull() | (big("most", 100) < big("a", COVERED)))
    flat = kept.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    first = flat.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
x AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM c),
y AS (SELECT x.lang, x.phrase, x.a, x.cut, l.a AS l, r.a AS r, (2000000 * x.a) // (l.a + r.a) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.cut], ' ') AND l.k = x.cut
    JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:], ' ') AND r.k = x.k - x.cut),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM y),
h AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) AS s(m) WHERE m < k) GROUP BY ALL)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM z JOIN t USING (lang) LEFT JOIN h USING (lang, phrase)
WHERE o = 1 AND (most IS NULL OR 100 * most < 80 * a) QUALIFY rank <= 2000
"""

QUERIES = {"op13_phrases": op13_phrases}
ORACLE = {"op13_phrases": OP13_SQL}
