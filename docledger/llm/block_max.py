"""Ranked lexical search over a forward index in blocks, pruned by per-term block maxima."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, stage, table
from .shingles import word_hashes

#: Bytes of text of a block, about; a longer text is a block of its own. Its packed arrays are then small enough for the JVM to move.
BLOCK_BYTES = 500_000
#: Blocks that an item scores in the first rounds, by descending bound; the last round takes all whose bound still counts.
ROUNDS = (16, 128)
#: Documents, and blocks, that a task reads at once.
BATCH, BLOCKS = 2000, 16
#: Results per item.
TOP = 50
#: Most (item, term) pairs of 16 bytes that are broadcast; more items are searched in as many slices as it takes.
SLICE_TERMS = 500_000
#: Most (item, block) pairs of 8 bytes that are broadcast to the blocks; beyond it they are joined by shuffle.
BROADCAST_PAIRS = 2_000_000
#: Bytes of terms: ASCII letters (lower-cased), digits and all of UTF-8's longer sequences; the others part terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))

_INT, _LONG = np.dtype("<i4"), np.dtype("<i8")
_INDEX = (
    "block long, n_docs long, n_terms long, doc_ids array<long>, lengths binary, docs binary, at binary, tf binary, "
    "terms binary, df binary, max_tf binary, min_n binary"
)


def _hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of the texts in turn, and the text that it stands in."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, starts = word_hashes(b"\n".join(raw).translate(_TERMS), lower=False)
    return hashes.view(np.int64), np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")


def _block(block: int, doc_ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    hashes, doc = _hashes(texts.to_pylist())
    terms, at = np.unique(hashes, return_inverse=True)
    lengths = np.bincount(doc, minlength=len(texts))
    grams, tf = np.unique(doc * max(len(terms), 1) + at, return_counts=True)
    doc, at = np.divmod(grams, max(len(terms), 1))
    by_term = np.argsort(at, kind="stable")
    first = np.searchsorted(at[by_term], np.arange(len(terms)))
    most = np.maximum.reduceat(tf[by_term], first) if len(terms) else tf
    least = np.minimum.reduceat(lengths[doc[by_term]], first) if len(terms) else tf
    numbers = [pa.array([v], pa.int64()) for v in (block, int((lengths > 0).sum()), int(lengths.sum()))]
    ids = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
    row = [(lengths, _INT), (doc, _INT), (at, _INT), (tf, _INT), (terms, _LONG), (np.diff(first, append=len(at)), _INT), (most, _INT), (least, _INT)]
    return [*numbers, ids, *(pa.array([v.astype(kind).tobytes()]) for v, kind in row)]


def _index(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    names, made = [c.split()[0] for c in _INDEX.split(", ")], TaskContext.get().partitionId() << 32
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
        cuts = np.flatnonzero(np.diff(ends // block_bytes)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(ends)], strict=True):
            yield pa.RecordBatch.from_arrays(_block(made, *(batch.column(i).slice(a, b - a) for i in (0, 1))), names=names)
            made += 1


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Forward index of documents (doc_id, text) in blocks of consecutive rows, one row per block.

    docs, at and tf are the block's entries in document order, packed: position of the document, of the
    term in terms, and occurrences. For each term df, max_tf and min_n hold the documents with it,
    its most occurrences in one and the least length of one, from which a bound follows under any
    corpus statistics: blocks can be added without touching others. A term is a 64-bit hash.

    Null and empty texts have length 0 and no entries. A very long text makes its block larger.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _index(batches, block_bytes), _INDEX)


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term), once each; queries without an id or without terms have no rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, item = _hashes(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item)), pa.array(terms)], names=["item_id", "term"])

    rows = queries.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(of, "item_id long, term long").distinct()


def _impact(tf: Column, n: Column, n_docs: int, n_terms: int) -> Column:
    """Weightless score of a term with tf occurrences in a document of n terms, in 64-bit integers."""
    return F.call_function("div", tf.cast("long") * 1_000_000_000, tf.cast("long") * 1000 + (F.call_function("div", n.cast("long") * (50 * n_docs), F.lit(n_terms)) + 50) * 20)


def _packed(batch: pa.RecordBatch, name: str, r: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[r].as_buffer(), _LONG if name == "terms" else _INT).astype(np.int64)


def _hits(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What blocks hold of the wanted terms, in ascending order: block, term, df, max_tf, min_n."""
    for batch in batches:
        for r in range(batch.num_rows):
            terms = _packed(batch, "terms", r)
            at = np.flatnonzero(np.isin(terms, wanted, assume_unique=True))
            columns = [pa.array(_packed(batch, c, r)[at], pa.int64()) for c in ("terms", "df", "max_tf", "min_n")]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch.column("block")[r].as_py()), pa.int64()), *columns], names=["block", "term", "df", "max_tf", "min_n"])


def _score(batches: Iterator[pa.RecordBatch], items: dict[int, tuple[np.ndarray, np.ndarray]], k: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of each block for each item (terms and weights) that asks for it."""
    for batch in batches:
        for r in range(batch.num_rows):
            lengths, doc, at, tf, terms, df = (_packed(batch, c, r) for c in ("lengths", "docs", "at", "tf", "terms", "df"))
            by_term = np.argsort(at, kind="stable")
            doc, tf = doc[by_term], tf[by_term]
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n_docs * lengths) // n_terms)[doc])
            ends = np.cumsum(df)
            ids = batch.column("doc_ids")[r].values
            order = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, ids.fill_null(0).to_numpy())
            out: list[tuple[np.ndarray, ...]] = []
            for item in batch.column("asked")[r].as_py():
                wanted, weight = items[item]
                place = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
                place, weight = (x[terms[place] == wanted] for x in (place, weight)) if len(terms) else (place[:0], weight[:0])
                many = df[place]
                entries = np.arange(many.sum()) + np.repeat(ends[place] - np.cumsum(many), many)
                score = np.zeros(len(lengths), np.int64)
                np.add.at(score, doc[entries], np.repeat(weight, many) * impact[entries])
                found = np.flatnonzero(score)
                if len(found) > k:
                    found = found[score[found] >= np.partition(score[found], -k)[-k]]
                found = found[np.lexsort((order[found], -score[found]))][:k]
                out.append((np.full(len(found), item), found, score[found]))
            own, found, scores = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), ids.take(pa.array(found)), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"])


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, rounds: Sequence[int] = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents (doc_id, text) of each item (item_id, text) by a saturated term weight.

    Each item bounds each block by the sum over its terms of weight and the impact of (max_tf, min_n),
    and takes blocks in descending order of bound: a few in the first round, more in the second, all
    that are left in the last. After each round the k-th best score is the item's threshold, and only
    blocks whose bound reaches it stay (equal, too: an equal score with a smaller doc_id ranks higher).
    So the result is that of scoring all documents. The (item, block) bounds are the query set against
    the blocks; the documents of a block are scored in one task, and k rows an item leave it.

    Null and empty texts score nothing; items without an id or terms have no rows; rows that repeat an
    item_id are one query of all their terms. Rows that repeat a doc_id rank each; a null doc_id ranks
    before others of equal score. Other columns are not read. Empty tables give no rows.
    Returns item_id, rank (from 1), doc_id, score.
    """
    index = stage(build_index(docs, block_bytes), "block-index", BATCH)
    wanted = stage(query_terms(queries), "query-terms")
    whole = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms")).first()
    n_docs, n_terms = whole["n_docs"], max(whole["n_terms"], 1)
    slices = max(1, -(-wanted.count() // SLICE_TERMS))
    out = None
    for i in range(slices):
        own = wanted if slices == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i)
        found = _search(index, own, k, rounds, n_docs, n_terms)
        out = found if out is None else out.unionByName(found)
    return out.select("item_id", "rank", "doc_id", "score")


def _search(index: DataFrame, wanted: DataFrame, k: int, rounds: Sequence[int], n_docs: int, n_terms: int) -> DataFrame:
    """The k best of each item of wanted (item_id, term), which has SLICE_TERMS rows, about."""
    context = index.sparkSession.sparkContext
    terms = context.broadcast(np.sort(wanted.select("term").distinct().toPandas()["term"].to_numpy(np.int64)))
    held = index.select("block", "terms", "df", "max_tf", "min_n")
    hits = stage(held.mapInArrow(lambda batches: _hits(batches, terms.value), "block long, term long, df long, max_tf long, min_n long"), "block-hits", BLOCKS)
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.sum("df") + 1))).cast("long").alias("weight")
    weighted = stage(wanted.join(hits.groupBy("term").agg(weight), "term"), "weighted-terms")
    items: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for item, g in weighted.toPandas().groupby("item_id"):
        items[item] = (g["term"].to_numpy(np.int64), g["weight"].to_numpy(np.int64))
    shared = context.broadcast(items)
    most = F.sum(F.col("weight") * _impact(F.col("max_tf"), F.col("min_n"), n_docs, n_terms)).alias("bound")
    left = stage(join_small(hits, weighted, ["term"]).groupBy("item_id", "block").agg(most).where("bound > 0"), "block-bounds")
    by_bound = Window.partitionBy("item_id").orderBy(F.col("bound").desc(), "block")
    found = None
    for most_blocks in (*rounds, None):
        asking = left if most_blocks is None else left.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= most_blocks)
        asking = stage(asking.select("item_id", "block"), "block-pairs")
        asked = asking.groupBy("block").agg(F.collect_list("item_id").alias("asked"))
        asked = F.broadcast(asked) if asking.count() <= BROADCAST_PAIRS else asked
        forward = index.select("block", "doc_ids", "lengths", "docs", "at", "tf", "terms", "df")
        scored = forward.join(asked, "block").drop("block").mapInArrow(lambda batches: _score(batches, shared.value, k, n_docs, n_terms), "item_id long, doc_id long, score long")
        found = stage(_best(scored if found is None else found.drop("rank").unionByName(scored), k), "block-found", BLOCKS)
        least = found.where(F.col("rank") == k).select("item_id", F.col("score").alias("least"))
        left = left.join(asking, ["item_id", "block"], "left_anti").join(least, "item_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(1))).drop("least")
    return found


def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term),
r AS (SELECT q.item_id, f.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (50 + (50 * d.n * s.docs) // s.terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN d ON d.doc_id = f.doc_id CROSS JOIN s GROUP BY q.item_id, f.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 50
"""

QUERIES = {"op11_block_max": op11_block_max}
ORACLE = {"op11_block_max": OP11_SQL}
