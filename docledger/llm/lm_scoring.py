"""Language-model scoring by deleted interpolation of n-gram estimates."""

from __future__ import annotations

import zlib
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .shingles import mix, texts_words

#: Bytes of text of a block, and of text whose n-grams one range counts, about. Both bound a task's memory.
BLOCK_BYTES, RANGE_BYTES = 12_000_000, 32_000_000
START, END = (np.uint64(x) for x in mix(np.array([1, 2], np.uint64)))
_CONTEXT, _WORD = (np.uint64(x | 1) for x in mix(np.array([3, 4], np.uint64)).tolist())
#: Folds: n-grams counted for the mixture weights, documents they are learned on, documents outside training.
COUNTED, TUNED, OUTSIDE = 0, 1, 2
#: Context frequencies fall into buckets by their binary logarithm.
BUCKETS = 40
#: Likelihood ratios are told apart in steps of this many per doubling when weights are learned.
GRID = 4
WEIGHTS = np.array([0.5, 0.4, 0.1])


def _pack(x: np.ndarray, plain: int) -> bytes:
    """Integers as byte planes, the lowest plain ones as they are and the others deflated."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return planes[:plain].tobytes() + zlib.compress(planes[plain:].tobytes(), 1)


def _unpack(raw: bytes, n: int, plain: int) -> np.ndarray:
    data = raw[: plain * n] + zlib.decompress(raw[plain * n :])
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view("<u8").ravel()


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of texts in turn, each closed by END; hashes of bigrams with the token before; sizes."""
    docs = [np.append(w, END) for w in texts_words(texts)]
    sizes = np.array([len(d) for d in docs], np.int64)
    if not len(docs):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), sizes
    uni = np.concatenate(docs)
    before = np.empty_like(uni)
    before[1:] = uni[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return uni, mix(before * _CONTEXT + uni * _WORD), sizes


def _ranges(sorted_hashes: np.ndarray, n: int) -> list[slice]:
    cut = np.searchsorted(((sorted_hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32), np.arange(n + 1))
    return [slice(a, b) for a, b in zip(cut, cut[1:], strict=False)]


_REQUEST = "range int, block long, fold int, size int, n long, hashes binary, counts binary"


def _request(pdf: pd.DataFrame, ranges: int) -> pd.DataFrame:
    """Distinct n-grams of a block with their counts, one row per order and range."""
    rows = []
    block, fold = (pdf["block"].iloc[0], pdf["fold"].iloc[0]) if len(pdf) else (0, 0)
    uni, bi, _ = _tokens(pdf["text"].tolist())
    for size, grams in ((1, uni), (2, bi)):
        own, counts = np.unique(grams, return_counts=True)
        for r, s in enumerate(_ranges(own, ranges)):
            if s.stop > s.start:
                rows.append((r, block, fold, size, s.stop - s.start, _pack(np.diff(own[s], prepend=np.uint64(0)), 5), _pack(counts[s], 0)))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _REQUEST.split(", ")])


_REPLY = "block long, range int, size int, n long, counts binary, tuning binary, types long, types_counted long, tokens long, tokens_counted long"


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Training counts of a range's n-grams, for each block in the order in which it has them.

    A row with block -1 has the numbers of types and tokens.
    """
    rows = []
    for size, g in pdf.groupby("size"):
        hashes = [np.cumsum(_unpack(h, n, 5), dtype=np.uint64) for h, n in zip(g["hashes"], g["n"], strict=True)]
        counts = [_unpack(c, n, 0) for c, n in zip(g["counts"], g["n"], strict=True)]
        types, at = np.unique(np.concatenate(hashes), return_inverse=True)
        folds = np.repeat(g["fold"].to_numpy(), g["n"].to_numpy())
        c = np.concatenate(counts).astype(np.float64)
        counted = np.bincount(at, np.where(folds == COUNTED, c, 0), len(types)).astype(np.uint64)
        total = np.bincount(at, np.where(folds != OUTSIDE, c, 0), len(types)).astype(np.uint64)
        ends = np.cumsum(g["n"].to_numpy())
        for block, fold, r, n, end in zip(g["block"], g["fold"], g["range"], g["n"], ends, strict=True):
            own = at[end - n : end]
            rows.append((block, r, size, n, _pack(total[own], 0), _pack(counted[own], 0) if fold == TUNED else None, 0, 0, 0, 0))
        if size == 1:
            rows.append((-1, g["range"].iloc[0], 1, 0, None, None, (total > 0).sum(), (counted > 0).sum(), total.sum(), counted.sum()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _REPLY.split(", ")])


def _known(replies: pd.DataFrame, size: int, column: str) -> np.ndarray:
    """Counts of a block's distinct n-grams of a size, in the order of their hashes."""
    g = replies[replies["size"] == size].sort_values("range")
    return np.concatenate([np.empty(0, np.uint64), *[_unpack(c, n, 0) for c, n in zip(g[column], g["n"], strict=True)]]).astype(np.float64)


def _estimates(texts: list[str | None], replies: pd.DataFrame, column: str, docs: int, tokens: int, types: int) -> tuple[np.ndarray, ...]:
    """Per token: count, bucket of its context's frequency and its bigram, unigram and base estimates; sizes of texts."""
    uni, bi, sizes = _tokens(texts)
    _, at1 = np.unique(uni, return_inverse=True)
    _, at2 = np.unique(bi, return_inverse=True)
    c1, c2 = _known(replies, 1, column)[at1], _known(replies, 2, column)[at2]
    context = np.empty_like(c1)
    context[1:] = c1[:-1]
    context[np.cumsum(sizes) - sizes] = docs
    bucket = np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)
    return c1, bucket, c2 / np.maximum(context, 1), c1 / max(tokens, 1), (c1 + 1) / (tokens + types + 1), sizes


def _tune(docs: pd.DataFrame, replies: pd.DataFrame, n_docs: int, tokens: int, types: int) -> pd.DataFrame:
    """Held-out counts of a block: tokens by bucket and by the ratios of the estimates to the base, on a grid."""
    if not len(docs):
        return pd.DataFrame({"bucket": [], "two": [], "one": [], "n": []}).astype("int64")
    _, bucket, p2, p1, p0, _ = _estimates(docs["text"].tolist(), replies, "tuning", n_docs, tokens, types)
    with np.errstate(divide="ignore"):
        two, one = (np.maximum(np.round(GRID * np.log2(p / p0)), -999).astype(np.int64) for p in (p2, p1))
    return pd.DataFrame({"bucket": bucket, "two": two, "one": one, "n": 1}).groupby(["bucket", "two", "one"], as_index=False)["n"].sum()


def learn_weights(held_out: pd.DataFrame, rounds: int = 60) -> np.ndarray:
    """Weights [BUCKETS, 3] of bigram, unigram and base estimates by expectation-maximisation.

    held_out has (bucket, two, one, n). A bucket that no token fell into takes the weights of all.
    """
    out = np.tile(WEIGHTS, (BUCKETS, 1))

    def em(g: pd.DataFrame) -> np.ndarray:
        grid = g[["two", "one"]].to_numpy(np.float64)
        p = np.column_stack((np.where(grid <= -999, 0, 2.0 ** (grid / GRID)), np.ones(len(g))))
        n, w = g["n"].to_numpy(np.float64), WEIGHTS
        for _ in range(rounds):
            share = p * w
            w = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
        w = np.maximum(w, 1e-6)
        return w / w.sum()

    if len(held_out):
        out[:] = em(held_out.groupby(["two", "one"], as_index=False)["n"].sum())
        for b, g in held_out.groupby("bucket"):
            out[int(b)] = em(g)
    return out


_SCORE = "doc_id long, no_id boolean, fold int, n_tokens long, n_known long, base_score double, score double"


def _score(docs: pd.DataFrame, replies: pd.DataFrame, n_docs: int, tokens: int, types: int, weights: np.ndarray) -> pd.DataFrame:
    names = [c.split()[0] for c in _SCORE.split(", ")]
    if not len(docs):
        return pd.DataFrame({n: [] for n in names})
    c1, bucket, p2, p1, p0, sizes = _estimates(docs["text"].tolist(), replies, "counts", n_docs, tokens, types)
    w = weights[bucket]
    p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0
    first = np.cumsum(sizes) - sizes
    total = lambda x: np.add.reduceat(x, first)
    return pd.DataFrame(dict(zip(names, (docs["doc_id"].to_numpy(), docs["no_id"].to_numpy(), docs["fold"].to_numpy(), sizes, total((c1 > 0).astype(np.int64)), total(np.log10(p0)), total(np.log10(p))), strict=True)))


def folds() -> Column:
    """OUTSIDE where crc32(doc_id as text) mod 7 is 2, TUNED where it is 3, else COUNTED; a null doc_id is OUTSIDE."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return F.when(rest == 3, TUNED).when(rest != 2, COUNTED).otherwise(OUTSIDE)


def score(docs: DataFrame, fold: Column, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """log10 probabilities of whole texts (doc_id, text) under an interpolated bigram model.

    Tokens are words with A-Z lower-cased and an end. Estimates: bigram and unigram relative
    frequencies, and the add-one base. Their weights depend on the bucket of the context's
    frequency and are learned on the TUNED fold against counts of the COUNTED one; scores
    use counts of both.

    Documents are dealt into blocks. A block sends its distinct n-grams, packed, to the ranges of
    their hashes, where training counts are summed; each range answers a block with the
    counts in the order asked. So an n-gram crosses the network once per block, not per
    occurrence, and nothing that grows with the corpus reaches the driver: that gets the numbers
    of types and tokens and a grid of held-out counts.

    A very long text is in one block and makes that larger. Other columns of docs are not read.
    Null and blank texts consist of the end alone. Rows that repeat are scored each. With an
    empty training fold every estimate is the base's. An empty table gives an empty one.
    Returns doc_id, fold, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    # pandas would turn a column of ids with a null into floats
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id")
    rows = docs.select(doc_id, F.col("doc_id").isNull().alias("no_id"), "text", fold.cast("int").alias("fold"))
    sizes = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("docs"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes")).collect()}
    blocks = {f: max(1, -(-r["bytes"] // block_bytes)) for f, r in sizes.items()}
    ranges = max(1, -(-sum(r["bytes"] for r in sizes.values()) // range_bytes))
    many = F.coalesce(*[F.when(F.col("fold") == f, F.lit(n)) for f, n in blocks.items()], F.lit(1))
    rows = rows.withColumn("block", F.col("fold") * F.lit(10**12) + F.pmod(F.xxhash64("doc_id", "text"), many))
    asked = rows.groupBy("block").applyInPandas(lambda pdf: _request(pdf, int(ranges)), _REQUEST)
    replies = stage(asked.groupBy("range").applyInPandas(_count, _REPLY), "lm-counts")
    whole = replies.where("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "types_counted", "tokens", "tokens_counted")]).first()
    answers = replies.where("block >= 0").select("block", "range", "size", "n", "counts", "tuning")
    n_docs = {f: sizes[f]["docs"] if f in sizes else 0 for f in (COUNTED, TUNED, OUTSIDE)}

    def with_answers(side: DataFrame, own: DataFrame, f, schema: str) -> DataFrame:
        return side.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(f, schema)

    counted = (n_docs[COUNTED], whole["tokens_counted"], whole["types_counted"])
    trained = (n_docs[COUNTED] + n_docs[TUNED], whole["tokens"], whole["types"])
    tuned = F.col("fold") == TUNED
    grid = with_answers(rows.where(tuned), answers.where("tuning is not null"), lambda key, a, b: _tune(a, b, *counted), "bucket long, two long, one long, n long")
    weights = learn_weights(grid.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).orderBy("bucket", "two", "one").toPandas())
    out = with_answers(rows, answers.drop("tuning"), lambda key, a, b: _score(a, b, *trained, weights), _SCORE)
    out = out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
    return out.withColumn("train_tokens", F.lit(whole["tokens"]).cast("long"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), folds())
    return out.select("doc_id", (F.col("fold") == OUTSIDE).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op3_lm_scoring": op3_lm_scoring}
ORACLE: dict[str, str] = {}
