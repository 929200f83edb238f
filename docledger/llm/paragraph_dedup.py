"""Substring dedup: near copies of paragraphs by MinHash banding, and repeated passages by runs of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, join_small, stage, table
from .components import connected_components
from .ngram_join import BLOCK_SHINGLES, SETS, SLICE, Levels, link_candidates, link_sets, set_rows
from .shingles import mix, shingle_hashes, word_hashes

#: Words of a paragraph and of a passage, at least. Shorter lines are line dedup's matter: boilerplate that clean texts share.
LEAST_WORDS = 50
#: Similarity of near copies, words of a shingle, recall of banding at that similarity, most bands.
NUM, DEN, SHINGLE, RECALL, MOST_BANDS = 80, 100, 5, 0.995, 12
#: Words of a run that is compared, runs of which one at least is sampled, other words within a passage.
GRAM, WINDOW, GAP = 10, 16, 3
#: Words on either side of a sampled run in which the next one must follow if texts go on alike.
CONTEXT = WINDOW - 1
#: Bytes of texts that are handled together.
GROUP = 1 << 18
#: Shingles whose minima are taken at once, sampled runs of a row.
AT_ONCE, RUNS = 20_000, 4096
#: Sets of a component that are compared one by one; more share a prefix tree.
FEW_SETS = 40
#: Most hashes (8 bytes each, or 16 with their class) that are broadcast.
BROADCAST_HASHES = 1_000_000


def tune_bands(threshold: float, recall: float = RECALL, most_bands: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows) with the most rows a band, so the fewest false candidates, that reach recall at the threshold."""
    best = (most_bands, 1)
    for r in range(1, 20):
        b = next((b for b in range(1, most_bands + 1) if 1 - (1 - threshold**r) ** b >= recall), None)
        if b is None:
            break
        best = (b, r)
    return best


class Bands:
    """MinHash banding: sets share a signature if all minima of a band agree."""

    def __init__(self, threshold: float = NUM / DEN):
        self.bands, self.rows = tune_bands(threshold)
        seeds = mix(np.arange(1, self.bands * self.rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.factors = seeds | np.uint64(1)
        self.tags = mix(np.arange(self.bands, dtype=np.uint64) + np.uint64(77))
        self.weights = mix(np.arange(self.rows, dtype=np.uint64) + np.uint64(777)) | np.uint64(1)

    def _minima(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.stack([np.minimum.reduceat(hashes * f, starts) for f in self.factors], 1)

    def sign(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Signatures [sets, bands] of sets that lie one after another in hashes; AT_ONCE hashes at a time."""
        ends = np.append(starts[1:], len(hashes))
        low, at = np.empty((len(starts), len(self.factors)), np.uint64), 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + AT_ONCE, "right")))
            if ends[at] - starts[at] > AT_ONCE:  # one long set, piece by piece
                cuts = np.arange(starts[at], ends[at], AT_ONCE)
                low[at] = np.minimum.reduce([self._minima(hashes[c : min(c + AT_ONCE, ends[at])], np.array([0]))[0] for c in cuts])
            else:
                low[at:to] = self._minima(hashes[starts[at] : ends[to - 1]], starts[at:to] - starts[at])
            at = to
        return mix(self.tags + (low.reshape(-1, self.bands, self.rows) * self.weights).sum(2, dtype=np.uint64))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, text); rows that repeat doc_id and text share a key."""
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("doc_key"), "text")


@dataclass
class Piece:
    """Words of the texts first, first + 1 and so on: hashes, the line of each word, the word and line with which a text begins."""

    first: int
    words: np.ndarray
    line: np.ndarray
    cuts: np.ndarray
    tops: np.ndarray


def pieces(texts: list[bytes]) -> Iterator[Piece]:
    """Texts in groups of about GROUP bytes; a longer one is alone. A blank line lies between two texts."""

    def flush(first: int, group: list[bytes]) -> Piece:
        data = b"\n\n".join(group)
        h, s = word_hashes(data)
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        line = np.repeat(np.arange(len(breaks) + 1), np.diff(np.searchsorted(s, breaks), prepend=0, append=len(s)))
        bounds = np.concatenate(([0], np.cumsum([len(t) + 2 for t in group])))
        return Piece(first, h, line, np.searchsorted(s, bounds), np.searchsorted(breaks, bounds))

    group, size, first = [], 0, 0
    for i, t in enumerate(texts):
        if group and size + len(t) > GROUP:
            yield flush(first, group)
            group, size, first = [], 0, i
        group.append(t)
        size += len(t) + 2
    if group:
        yield flush(first, group)


def paragraphs(x: Piece, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Paragraphs of texts: places of their first words and after their last ones.

    In a block between blank lines these are the lines of least words or more, else the whole block
    if that has as many (hard-wrapped text); the whole text where it has none of those.
    """
    n = len(x.line)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    step = np.diff(x.line)
    lines = np.concatenate(([0], np.flatnonzero(step) + 1, [n]))
    blocks = np.concatenate(([0], np.flatnonzero(step > 1) + 1, [n]))
    long = np.flatnonzero(np.diff(lines) >= least)
    starts, ends = lines[long], lines[long + 1]
    without = lambda bounds, at: np.searchsorted(at, bounds[1:]) == np.searchsorted(at, bounds[:-1])
    whole = np.flatnonzero((np.diff(blocks) >= least) & without(blocks, starts))
    starts, ends = np.concatenate((starts, blocks[whole])), np.concatenate((ends, blocks[whole + 1]))
    bare = np.flatnonzero((np.diff(x.cuts) > 0) & without(x.cuts, np.sort(starts)))
    return np.sort(np.concatenate((starts, x.cuts[bare]))), np.sort(np.concatenate((ends, x.cuts[bare + 1])))


def shingles_of(x: Piece, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of paragraphs one after another, and how many each has."""
    n = np.maximum(ends - starts - SHINGLE + 1, 1)
    if len(x.words) < SHINGLE:
        g = np.zeros(len(x.words), np.uint64)
    else:
        g = np.concatenate((shingle_hashes(x.words, SHINGLE), np.zeros(SHINGLE - 1, np.uint64)))
    for i in np.flatnonzero(ends - starts < SHINGLE):
        g[starts[i]] = shingle_hashes(x.words[starts[i] : ends[i]], SHINGLE)[0]
    inside = np.zeros(len(g) + 1, np.int8)
    inside[starts] = 1
    inside[starts + n] -= 1
    return g[np.cumsum(inside[:-1]).astype(bool)], n


def _sliding(x: np.ndarray, window: int, f: np.ufunc, fill: int) -> np.ndarray:
    """f over every window neighbours, from minima or maxima of blocks read from either side."""
    blocks = np.concatenate((x, np.full(-len(x) % window, fill, np.uint64))).reshape(-1, window)
    before, after = f.accumulate(blocks, 1).ravel(), f.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(x) - window + 1
    return f(after[:n], before[window - 1 : window - 1 + n])


def sampled(x: Piece, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and text numbers of runs that are the least of some WINDOW neighbours of a text of least words or more.

    So texts that share as many runs in a row share one that is sampled.
    """
    width = GRAM + WINDOW - 1
    if len(x.words) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    size = np.diff(x.cuts)
    text = np.repeat(np.arange(len(size)), size)
    g = shingle_hashes(x.words, GRAM)
    whole = (text[: len(text) - width + 1] == text[width - 1 :]) & (size[text[width - 1 :]] >= least)
    low = np.where(whole, _sliding(g, WINDOW, np.minimum, 2**64 - 1), 0)
    edge = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate((edge, low, edge)), WINDOW, np.maximum, 0) == g)
    return at, g[at], text[at]


_SCAN = "doc_id long, doc_key long, first_line int, last_line int, first_word int, n_words int, n long, key long, sigs array<long>, pos array<int>, runs array<long>"


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values, kind))


def _scan(batches: Iterator[pa.RecordBatch], least: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    """(doc_id, doc_key, text) -> a row for each paragraph with its signatures, and rows with a text's sampled runs."""
    longs, ints = ("doc_id", "doc_key"), ("first_line", "last_line", "first_word", "n_words")
    lists = [("sigs", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32())), ("runs", pa.list_(pa.int64()))]
    kinds = [*((c, pa.int64()) for c in longs), *((c, pa.int32()) for c in ints), ("n", pa.int64()), ("key", pa.int64()), *lists]
    schema = pa.schema(kinds)

    def rows(b: pa.RecordBatch, take: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        at = pa.array(take)
        own = {"doc_id": b.column(0).take(at), "doc_key": b.column(1).take(at)} | columns
        return pa.record_batch([own[f.name] if f.name in own else pa.nulls(len(take), f.type) for f in schema], schema=schema)

    for b, x in _batch_pieces(batches, 2):
        starts, ends = paragraphs(x, least)
        if len(starts):
            flat, n = shingles_of(x, starts, ends)
            heads = np.cumsum(n) - n
            # equal paragraphs have equal bags of shingles
            key = mix(np.add.reduceat(mix(flat), heads) + n.astype(np.uint64)).view(np.int64)
            sigs = bands.sign(flat, heads)
            text = np.searchsorted(x.cuts, starts, "right") - 1
            ints = {"first_line": x.line[starts] - x.tops[text], "last_line": x.line[ends - 1] - x.tops[text], "first_word": starts - x.cuts[text], "n_words": ends - starts}
            columns = {c: pa.array(v.astype(np.int32)) for c, v in ints.items()} | {"n": pa.array(n), "key": pa.array(key)}
            yield rows(b, x.first + text, columns | {"sigs": _lists(sigs.ravel().view(np.int64), np.arange(len(n) + 1) * bands.bands, pa.int64())})
        at, g, text = sampled(x, least)
        if len(at):
            # a row holds RUNS runs of a text at most
            nth = np.arange(len(at)) - np.searchsorted(text, text)
            cuts = np.flatnonzero(np.concatenate(([True], (np.diff(text) > 0) | (nth[1:] % RUNS == 0), [True])))
            yield rows(b, x.first + text[cuts[:-1]], {"pos": _lists((at - x.cuts[text]).astype(np.int32), cuts, pa.int32()), "runs": _lists(g.view(np.int64), cuts, pa.int64())})


def _batch_pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Piece]]:
    for whole in batches:
        for b in (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE)):
            for x in pieces(b.column(column).cast(pa.binary()).to_pylist()):
                yield b, x


def scan(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Paragraphs and sampled runs of documents (doc_id, text) in one pass over the texts, staged."""
    return stage(_keyed(docs).mapInArrow(partial(_scan, least=least, bands=Bands()), _SCAN), "paragraphs-scan")


def _unit_sets(batches: Iterator[pa.RecordBatch], levels: Levels) -> Iterator[pa.RecordBatch]:
    """(text, units: array of (key, first_word, n_words, large)) -> rows of SETS of those paragraphs."""
    for b, x in _batch_pieces(batches, 0):
        wanted = [(at, u) for at, us in zip(x.cuts[:-1].tolist(), b.column(1).slice(x.first, len(x.tops) - 1).to_pylist(), strict=True) for u in us]
        sets = [np.unique(shingle_hashes(x.words[at + u["first_word"] : at + u["first_word"] + u["n_words"]], SHINGLE)) for at, u in wanted]
        yield set_rows(pa.array([u["key"] for _, u in wanted], pa.int64()), sets, [u["large"] for _, u in wanted], levels)


def verified(keys: np.ndarray, sets: list[np.ndarray], num: int, den: int, probes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """As ngram_join.link_sets, with the sets of small components compared one by one."""
    if len(sets) > FEW_SETS:
        return link_sets(keys, sets, num, den, probes)
    own, group, out = [set(s.tolist()) for s in sets], list(range(len(sets))), []
    for p in range(len(sets)) if probes is None else probes.tolist():
        for q, other in enumerate(own):
            if group[p] != group[q] and (both := len(own[p] & other)) * den >= num * (len(own[p]) + len(other) - both):
                out.append((int(keys[p]), int(keys[q])))
                group = [group[p] if x == group[q] else x for x in group]
    return out


def _classes(docs: DataFrame, units: DataFrame, block_shingles: int) -> DataFrame:
    """(key, root) of paragraphs that are linked with another one: bands, exact Jaccard similarity, components."""
    sigs = units.select("key", F.explode("sigs").alias("sig"))
    shared = sigs.groupBy("sig").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("sig", "a")
    edges = join_small(sigs, stage(shared, "shared-bands"), ["sig"], rows=BROADCAST_HASHES).where("key <> a").select("a", F.col("key").alias("b"))
    comps = connected_components(edges)
    one = join_small(units.select("key", "n", "doc_key", "first_word", "n_words"), comps.withColumnRenamed("node", "key"), ["key"])
    one = one.groupBy("key", "root", "n").agg(F.min(F.struct("doc_key", "first_word", "n_words")).alias("at")).select("key", "root", "n", "at.*")
    levels = Levels(NUM, DEN, 2**31)

    def sets_of(one: DataFrame) -> DataFrame:
        wanted = one.groupBy("doc_key").agg(F.collect_list(F.struct("key", "first_word", "n_words", "large")).alias("units"))
        texts = join_small(_keyed(docs).select("doc_key", "text"), stage(wanted, "candidate-places"), ["doc_key"])
        return texts.select("text", "units").mapInArrow(partial(_unit_sets, levels=levels), SETS)

    return connected_components(link_candidates(one, sets_of, levels, block_shingles, verified)).withColumnRenamed("node", "key")


def repeated_paragraphs(docs: DataFrame, scanned: DataFrame | None = None, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Paragraphs (see paragraphs) that have a near copy in another document.

    MinHash bands, tuned for RECALL at the threshold, bring paragraphs together; colliding ones are
    verified by exact Jaccard similarity of 5-word shingles, and linked ones form classes by
    components. Of a class the first by doc_id, a hash of the document and place stays.

    Returns doc_id, doc_key, first_line, last_line, first_word, n_words, class_doc_id, removed.
    """
    units = (scan(docs) if scanned is None else scanned).where("key is not null")
    roots = _classes(docs, units, block_shingles)
    at = ["doc_id", "doc_key", "first_line", "last_line", "first_word", "n_words"]
    rows = join_small(units.select("key", *at), roots, ["key"], "left", BROADCAST_HASHES)
    rows = rows.select(*at, F.coalesce("root", "key").alias("root"))
    place = F.struct("doc_id", "doc_key", "first_word")
    shared = rows.groupBy("root").agg(F.min(place).alias("first"), F.min("doc_key").alias("low"), F.max("doc_key").alias("high")).where("low <> high")
    # rows that repeat doc_id and text are one document
    out = join_small(rows, stage(shared.select("root", "first"), "shared-paragraphs"), ["root"]).dropDuplicates(["doc_key", "first_word"])
    return out.select(*at, F.col("first.doc_id").alias("class_doc_id"), (place != F.col("first")).alias("removed"))


_RUNS = "doc_id long, doc_key long, pos int, h long, before binary, after binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, doc_key, text, places) -> rows of _RUNS: each run with hashes of CONTEXT words before and after it, 0 beyond the text."""
    for b, x in _batch_pieces(batches, 2):
        places = b.column(3).slice(x.first, len(x.tops) - 1)
        counts = pc.list_value_length(places).to_numpy()
        text = np.repeat(np.arange(len(counts)), counts)
        pos = places.flatten().to_numpy()
        at = x.cuts[text] + pos
        # words of other texts count as beyond the text
        short, of = x.words.astype(np.uint32) | np.uint32(1), np.repeat(np.arange(len(counts)), np.diff(x.cuts))
        around = at[:, None] + np.concatenate((np.arange(-CONTEXT, 0), GRAM + np.arange(CONTEXT)))
        inside = np.clip(around, 0, len(short) - 1)
        near = np.where((around == inside) & (of[inside] == text[:, None]), short[inside], np.uint32(0))
        raw = [pa.array([y.tobytes() for y in part], pa.binary()) for part in (near[:, :CONTEXT], near[:, CONTEXT:])]
        take = pa.array(x.first + text)
        yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(pos), pa.array(shingle_hashes(x.words, GRAM)[at].view(np.int64)), *raw], names=["doc_id", "doc_key", "pos", "h", "before", "after"])


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words that contexts have in common, counted from the run outwards."""
    return np.logical_and.accumulate((x == y) & (x != 0), axis=1).sum(1)


def _contexts_of(runs: pa.StructArray, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(runs.field(column).to_pylist()), np.uint32).reshape(-1, CONTEXT)


def _cut(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, doc_key, runs of a document) -> (doc_id, doc_key, first_word, last_word, n_words, class_doc_id, removed) of its passages.

    A run has its place, whether it stays, the document that has it first, and the contexts of it and of another one.
    """
    names = ["doc_id", "doc_key", "first_word", "last_word", "n_words", "class_doc_id", "removed"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
        out, runs = [], b.column(2).flatten()
        pos, stays = runs.field("pos").to_numpy(), runs.field("stays").to_numpy(zero_copy_only=False)
        classes = runs.field("class_doc_id").to_pylist()
        low = pos - _alike(_contexts_of(runs, "before")[:, ::-1], _contexts_of(runs, "other_before")[:, ::-1])
        high = pos + GRAM + _alike(_contexts_of(runs, "after"), _contexts_of(runs, "other_after"))
        ends = np.cumsum(pc.list_value_length(b.column(2)).to_numpy())
        for doc_id, doc_key, lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), [0, *ends[:-1]], ends, strict=True):
            order = lo + np.argsort(low[lo:hi], kind="stable")
            top = np.maximum.accumulate(high[order])
            heads = np.flatnonzero(np.concatenate(([True], low[order[1:]] > top[:-1] + GAP)))
            for x, y in zip(heads, [*heads[1:], len(order)], strict=True):
                own, start = order[x:y], int(low[order[x]])
                # 0: no part of the passage, 1: stays, 2: is removed
                state = np.zeros(int(top[y - 1]) - start, np.int8)
                for r in own:
                    part = state[low[r] - start : high[r] - start]
                    np.maximum(part, 1 if stays[r] else 2, out=part)
                for r in own[stays[own]]:
                    state[pos[r] - start : pos[r] - start + GRAM] = 1
                if np.count_nonzero(state) < least:
                    continue
                edges = np.concatenate(([0], np.flatnonzero(np.diff(state)) + 1, [len(state)])).tolist()
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    if state[i]:
                        ids = [classes[r] for r in own[(low[own] - start < j) & (high[own] - start > i)]]
                        out.append((doc_id, doc_key, start + i, start + j - 1, j - i, None if None in ids else min(ids), bool(state[i] == 2)))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _repeated(runs: DataFrame) -> DataFrame:
    """Hashes that stand in two documents at least."""
    return runs.groupBy("h").agg(F.min("doc_key").alias("low"), F.max("doc_key").alias("high")).where("low <> high").select("h")


def repeated_passages(docs: DataFrame, gone: DataFrame | None = None, least: int = LEAST_WORDS, scanned: DataFrame | None = None) -> DataFrame:
    """Passages of least words or more that stand in other documents too, wherever they begin and end.

    Words are compared with A-Z lower-cased, whatever the white space between them. Runs of GRAM
    words are sampled so that equal words of GRAM + WINDOW - 1 in a row always share one. A
    sampled run that other documents have is compared, word by word outwards, with its first
    occurrence, in whichever document (the first with the last one); since the next sampled run lies within reach, this
    gives the ends. Such stretches with at most GAP other words between them form a passage; those
    words are no part of it. The first occurrence of a run by doc_id, a hash of the document and
    place stays; other words of a passage are removed. Passages are cut where this
    changes, so n_words of a part may be below least.

    gone: paragraphs (doc_key, first_word, n_words, removed); what is removed there is not
    compared, so that what repeats it stays.
    Returns doc_id, doc_key, first_word, last_word, n_words, class_doc_id, removed.
    """
    runs = (scan(docs, least) if scanned is None else scanned).where("pos is not null")
    runs = runs.select("doc_key", F.explode(F.arrays_zip("pos", "runs")).alias("x")).select("doc_key", "x.pos", F.col("x.runs").alias("h"))
    known = stage(_repeated(runs), "repeated-runs")
    # these tables grow with the corpus, so the joins are shuffled at every size; adaptive execution splits a frequent run
    runs = runs.join(known.hint("merge"), "h")
    if gone is not None:
        spans = gone.where("removed").groupBy("doc_key").agg(F.collect_set(F.struct(F.col("first_word").alias("a"), (F.col("first_word") + F.col("n_words")).alias("b"))).alias("gone"))
        inside = F.exists("gone", lambda x: (x["a"] < F.col("pos") + GRAM) & (x["b"] > F.col("pos")))
        runs = join_small(runs, stage(spans, "gone-words"), ["doc_key"], "left").where(~F.coalesce(inside, F.lit(False))).drop("gone")
    runs = stage(runs, "runs")
    known = stage(_repeated(runs), "repeated-runs-left")
    places = stage(runs.join(known.hint("merge"), "h").groupBy("doc_key").agg(F.collect_set("pos").alias("places")), "places")
    drop_staged(runs)
    rows = stage(join_small(_keyed(docs), places, ["doc_key"]).select("doc_id", "doc_key", "text", "places").mapInArrow(_contexts, _RUNS), "run-contexts")
    whole = F.struct("doc_id", "doc_key", "pos", "before", "after")
    ends = stage(rows.groupBy("h").agg(F.min(whole).alias("first"), F.max(whole).alias("last")), "first-and-last")
    place = F.struct("doc_id", "doc_key", "pos")
    stays = place == F.struct("first.doc_id", "first.doc_key", "first.pos")
    other = lambda c: F.when(stays, F.col(f"last.{c}")).otherwise(F.col(f"first.{c}")).alias(f"other_{c}")
    run = F.struct("pos", stays.alias("stays"), F.col("first.doc_id").alias("class_doc_id"), "before", "after", other("before"), other("after"))
    by_doc = rows.join(ends.hint("merge"), "h").groupBy("doc_key").agg(F.min("doc_id").alias("doc_id"), F.collect_list(run).alias("runs"))
    return by_doc.select("doc_id", "doc_key", "runs").mapInArrow(partial(_cut, least=least), "doc_id long, doc_key long, first_word int, last_word int, n_words long, class_doc_id long, removed boolean")


def repeated_substrings(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Repeated paragraphs of documents (doc_id, text), and repeated passages of what they leave, in one table.

    least: words of a paragraph or passage. A text none of whose paragraphs has as many is one paragraph.
    Null and empty texts have none. Rows that repeat doc_id and text count as one document, so they
    do not make each other repeat. Ties go by doc_id, a hash of the document and place. A null
    doc_id goes first. An empty table gives an empty result; columns besides doc_id and text are not read.
    A very long text is hashed in pieces and signed AT_ONCE shingles at a time; about 100 bytes a word of one text are held.
    Returns doc_id, kind (paragraph or passage), first, last (line numbers of a paragraph, word
    numbers of a passage), n_words, class_doc_id, removed.
    """
    docs = docs.select("doc_id", "text")
    scanned = scan(docs, least)
    found = stage(repeated_paragraphs(docs, scanned), "repeated-paragraphs")
    a = found.select("doc_id", F.lit("paragraph").alias("kind"), F.col("first_line").alias("first"), F.col("last_line").alias("last"), F.col("n_words").cast("long").alias("n_words"), "class_doc_id", "removed")
    b = repeated_passages(docs, found, least, scanned).select("doc_id", F.lit("passage").alias("kind"), F.col("first_word").alias("first"), F.col("last_word").alias("last"), "n_words", "class_doc_id", "removed")
    return a.unionByName(b)


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_paragraph_dedup": op5_paragraph_dedup}
ORACLE: dict[str, str] = {}
