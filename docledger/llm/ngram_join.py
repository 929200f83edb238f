"""N-gram Jaccard join: signatures, counted, find candidates, prefix trees link them, contraction groups them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, join_small, packed, stage, table, unpacked
from .components import connected_components
from .shingles import mix, shingle_set, texts_words

#: Texts that a worker holds at a time.
SLICE = 500
#: Shingles that the sets of one block hold together, about; bounds a task's memory.
BLOCK_SHINGLES = 1_000_000
#: Ranges that must agree are named together, several at a time, while a set then has at most this many signatures a level.
MOST_SUBSETS = 100
#: Times at most that large candidate components are signed again with other ranges, and the part of
#: their shingles that must leave them for another time.
ROUNDS, LEAST_GAIN = 6, 0.1
#: Sets that share a signature are paired up if they are at most so many.
SMALL_BUCKET = 8


class Levels:
    """Size classes for a Jaccard threshold of num / den.

    Class c holds sizes up to his[c], and linked sets lie in the same class or in neighbours. At
    level L linked sets whose larger one is of class L differ by most[L] shingles at most. Hashes
    are cut into parts[L] ranges. Small sets have most + together ranges, of which that
    many (empty ones included) must agree: each choice of them is a signature. For large ones
    a signature is one filled range, and there are more ranges: where one of the two sets has more than
    most filled ones, some filled range is the same in both.
    """

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        self.his = [1]
        while self.his[-1] < largest:
            self.his.append(max(self.his[-1] + 1, self.his[-1] * den // num))
        self.most = [self.differ(h, h) for h in self.his]
        self.together = [max([m for m in (1, 2, 3, 4) if k and math.comb(k + m, m) <= MOST_SUBSETS], default=1) for k in self.most]
        self.parts = [1 if k == 0 else k + m if m > 1 else int(1.1 * k) + 5 for k, m in zip(self.most, self.together, strict=True)]
        self.subsets = [np.array(list(combinations(range(p), m))) if m > 1 else None for p, m in zip(self.parts, self.together, strict=True)]

    def differ(self, n: int, m: int) -> int:
        """Most that linked sets of n and m shingles can differ by."""
        return (n + m) * (self.den - self.num) // (self.den + self.num)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.his, n))

    def filled(self, s: np.ndarray, level: int) -> int:
        """Ranges of a set that its signatures at a level are made of: all, or the filled ones where each is a signature."""
        return self.parts[level] if self.subsets[level] is not None else len(_parts(s, self.parts[level])[0])

    def common(self, level: np.ndarray, filled: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """Signatures that two linked sets have in common at a level at least, 1 or more.

        A shingle that only one of them has spoils one range. So as many as differ are lost at most of
        the ranges that the one with more of them has filled, and each choice of those left is a signature.
        """
        left, m = np.maximum(filled - differ, 0), np.asarray(self.together)[level]
        count = left.copy()
        for i in (2, 3, 4):
            count = np.where(m >= i, count * np.maximum(left - i + 1, 0) // i, count)
        return np.maximum(count, 1)

    def demands(self, s: np.ndarray) -> tuple[int, int, int, int, int]:
        """Level of a set; its filled ranges and the signatures it shares with any set linked with it at least, there and at the next level."""
        own, n, out = self.of(len(s)), len(s), []
        for level in (own, own + 1):
            filled = self.filled(s, level)
            out += [filled, int(self.common(level, filled, self.differ(n, min(self.his[level], n * self.den // self.num))))]
        return own, *out

    def sign(self, s: np.ndarray) -> np.ndarray:
        """Hashes of which linked sets share one."""
        return signatures(s, self)

    def doubtful(self, s: np.ndarray) -> bool:
        """Whether sign may miss a link of a set, so that it needs the join by prefixes."""
        return self.lopsided(s)

    def lopsided(self, s: np.ndarray) -> bool:
        """Whether signatures by ranges may miss a link of a set."""
        return uneven(s, self)


def set_key(s: np.ndarray) -> int:
    """A 64-bit name of a set of hashes; equal sets share it."""
    total = mix(s).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _parts(s: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Filled ranges of a sorted set cut into p: where each starts, and its number."""
    part = ((s >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return first, part[first]


def signatures(s: np.ndarray, levels: Levels) -> np.ndarray:
    """Signatures of a sorted set at its own level and the next; the lowest bit is that of the level."""
    own = levels.of(len(s))
    return np.concatenate([level_signatures(s, levels, level) & ~np.uint64(1) | np.uint64(level & 1) for level in (own, own + 1)])


def level_signatures(s: np.ndarray, levels: Levels, level: int) -> np.ndarray:
    """Signatures of a sorted set at one level."""
    first, part = _parts(s, levels.parts[level])
    tag = np.uint64(level << 32)
    h = mix(np.add.reduceat(mix(s), first) + mix(part + tag))
    if levels.subsets[level] is not None:
        ranges = np.zeros(levels.parts[level], np.uint64)
        ranges[part] = h
        subsets = levels.subsets[level]
        h = mix(ranges[subsets].sum(1, dtype=np.uint64) + mix(np.arange(len(subsets), dtype=np.uint64) + tag))
    return h


def dealt_anew(s: np.ndarray, seed: int) -> np.ndarray:
    """A set's hashes dealt over the ranges in another way, sorted; one way for each seed."""
    return np.sort(mix(s ^ mix(np.array([seed], np.uint64))))


def uneven(s: np.ndarray, levels: Levels) -> bool:
    """Whether the ranges of a large set are filled too unevenly for a proof that its signatures find all its links."""
    n = len(s)
    for level in (levels.of(n), levels.of(n) + 1):
        if levels.most[level] and levels.subsets[level] is None:
            partner = min(levels.his[level], n * levels.den // levels.num)
            if len(_parts(s, levels.parts[level])[0]) <= min(levels.most[level], levels.differ(n, partner)):
                return True
    return False


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows at most, so that a worker holds few texts and their shingles at a time."""
    for b in batches:
        yield from (b.slice(i, SLICE) for i in range(0, b.num_rows, SLICE))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in _slices(batches):
        yield b, [shingle_set(w, k) for w in texts_words(b.column(1).to_pylist())]


#: Sets of documents; see Levels.doubtful and Levels.demands.
NAMED = "doc_id long, row_key long, n_shingles long, key long, uneven boolean, level int, filled int, least int, filled_next int, least_next int"


def _name_sets(batches: Iterator[pa.RecordBatch], k: int, levels: Levels) -> Iterator[pa.RecordBatch]:
    """(row_key, text, doc_id) -> rows of NAMED."""
    for b, sets in _sets(batches, k):
        columns = [(b.column(2), pa.int64()), (b.column(0), pa.int64()), ([len(s) for s in sets], pa.int64()), ([set_key(s) if len(s) else None for s in sets], pa.int64()), ([len(s) > 0 and levels.doubtful(s) for s in sets], pa.bool_())]
        columns += [(x, pa.int32()) for x in zip(*[levels.demands(s) if len(s) else (None,) * 5 for s in sets], strict=True)]
        yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in columns], names=[c.split()[0] for c in NAMED.split(", ")])


def _sign_sets(batches: Iterator[pa.RecordBatch], k: int, levels: Levels) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (sig, key); sets that a batch repeats are signed once."""
    for _, sets in _sets(batches, k):
        by_key = {set_key(s): s for s in sets if len(s)}
        if by_key:
            sigs = [levels.sign(s) for s in by_key.values()]
            keys = np.repeat(np.array(list(by_key), np.int64), [len(s) for s in sigs])
            yield pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(keys)], names=["sig", "key"])


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, levels: Levels) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (sig, key) of the shingles of which linked sets share one."""
    for _, sets in _sets(batches, k):
        own = [(s[: len(s) - -(-levels.num * len(s) // levels.den) + 1], set_key(s)) for s in sets if len(s)]
        if own:
            keys = np.repeat(np.array([key for _, key in own], np.int64), [len(p) for p, _ in own])
            yield pa.record_batch([pa.array(np.concatenate([p for p, _ in own]).view(np.int64)), pa.array(keys)], names=["sig", "key"])


def _stars(batches: Iterator[pa.RecordBatch], negative: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, key) -> (a, b): the first key of each sig with each other key of it.

    Rows stream by, and only the current sig and its first key are kept. negative: sigs without a
    negative key give nothing.
    """
    sig = first = None
    for b in batches:
        s, key = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(s):
            continue
        new = np.concatenate(([sig is None or s[0] != sig], s[1:] != s[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
        heads = np.where(at >= 0, key[at], first if first is not None else 0)
        sig, first = s[-1], heads[-1]
        pair = (heads != key) & (heads < 0) if negative else heads != key
        if pair.any():
            yield pa.record_batch([pa.array(x) for x in np.unique(np.stack((heads[pair], key[pair])), axis=1)], names=["a", "b"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, key) -> those whose sig has several keys, once each. The last row waits for the next one."""
    sig, key, known = np.empty(0, np.int64), np.empty(0, np.int64), False
    for b in batches:
        sig, key = np.concatenate((sig, b.column(0).to_numpy())), np.concatenate((key, b.column(1).to_numpy()))
        if not len(sig):
            continue
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])))
        sig, key = sig[new], key[new]
        same = sig[1:] == sig[:-1]
        out = np.concatenate(([known], same)) | np.concatenate((same, [False]))
        yield pa.record_batch([pa.array(x[:-1][out[:-1]]) for x in (sig, key)], names=["sig", "key"])
        sig, key, known = sig[-1:], key[-1:], bool(out[-1])
    if known:
        yield pa.record_batch([pa.array(sig), pa.array(key)], names=["sig", "key"])


#: Pairs of sets that share a signature; in a large bucket each set alone, without b. least: what Levels.common and Levels.demands ask for.
BUCKETS = "sig long, a long, b long, level int, least int"


def _bucket_rows(sig: np.ndarray, key: np.ndarray, n: np.ndarray, level: np.ndarray, filled: np.ndarray, least: np.ndarray, large: np.ndarray, levels: Levels) -> pa.RecordBatch:
    at = np.flatnonzero(large)
    out, none = [(sig[at], key[at], np.zeros(len(at), np.int64), level[at], least[at])], len(at)
    rows = np.flatnonzero(~large)
    for d in range(1, SMALL_BUCKET):
        i, j = rows[:-d], rows[d:]
        fit = (sig[i] == sig[j]) & (level[i] == level[j]) & (levels.den * np.minimum(n[i], n[j]) >= levels.num * np.maximum(n[i], n[j]))
        i, j = i[fit], j[fit]
        differ = (n[i] + n[j]) * (levels.den - levels.num) // (levels.den + levels.num)
        out.append((sig[i], key[i], key[j], level[i], levels.common(level[i], np.maximum(filled[i], filled[j]), differ)))
    sig, a, b, level, least = (np.concatenate(x) for x in zip(*out, strict=True))
    columns = [pa.array(sig), pa.array(a), pa.array(b, mask=np.arange(len(b)) < none), pa.array(level, pa.int32()), pa.array(least.astype(np.int32))]
    return pa.record_batch(columns, names=[c.split()[0] for c in BUCKETS.split(", ")])


def _buckets(batches: Iterator[pa.RecordBatch], levels: Levels) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, key) with n, level, filled and least -> rows of BUCKETS. Of the last sig few rows wait, or none if it has many."""
    held, going_on = None, None
    for b in batches:
        columns = [c.to_numpy() for c in b.columns]
        if held:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        sig = columns[0]
        if not len(sig):
            continue
        starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        sizes = np.diff(np.append(starts, len(sig)))
        large = np.repeat(sizes, sizes) > SMALL_BUCKET
        if going_on is not None:
            large |= sig == going_on
        end = len(sig) if large[-1] else int(starts[-1])
        going_on, held = (sig[-1], None) if large[-1] else (None, [c[end:] for c in columns])
        yield _bucket_rows(*(c[:end] for c in columns), large[:end], levels)
    if held:
        yield _bucket_rows(*held, np.zeros(len(held[0]), bool), levels)


def _texts_sets(batches: Iterator[pa.RecordBatch], k: int, levels: Levels) -> Iterator[pa.RecordBatch]:
    """(key, text, large) -> rows of SETS."""
    for b, sets in _sets(batches, k):
        yield set_rows(b.column(0), sets, b.column(2).to_pylist(), levels)


#: Sets of hashes. Bit r of bad is set where a large set is uneven when dealt with seed r.
SETS = "key long, n long, shingles array<long>, bad int"


def set_rows(keys: pa.Array, sets: list[np.ndarray], large: list[bool], levels: Levels) -> pa.RecordBatch:
    bad = [sum(levels.lopsided(dealt_anew(s, r)) << r for r in range(1, ROUNDS + 1)) if x else 0 for s, x in zip(sets, large, strict=True)]
    columns = [keys, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(bad, pa.int32())]
    return pa.record_batch(columns, names=["key", "n", "shingles", "bad"])


def _sign_nodes(batches: Iterator[pa.RecordBatch], levels: Levels, seed: int) -> Iterator[pa.RecordBatch]:
    """(shingles, node and label at the set's own level, node and label at the next one, nulls where there is none) -> (sig, node)."""
    for b in _slices(batches):
        sigs, nodes = [], []
        shingles, *ends = (c.to_pylist() if i else c for i, c in enumerate(b.columns))
        for i, (own, own_label, after, after_label) in enumerate(zip(*ends, strict=True)):
            s = dealt_anew(shingles[i].values.to_numpy().view(np.uint64), seed)
            level = levels.of(len(s))
            for node, label, at in ((own, own_label, level), (after, after_label, level + 1)):
                if node is not None:
                    sigs.append(mix(level_signatures(s, levels, at) + mix(np.array([label], np.int64).view(np.uint64))))
                    nodes.append(np.full(len(sigs[-1]), node, np.int64))
        if sigs:
            yield pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))], names=["sig", "node"])


class Trie:
    """Sets in one global order of shingles as a path-compressed prefix tree.

    The order is descending by frequency in the block, then by hash, so that alike sets share
    long paths. A node is a run of shingles; its sets are neighbours in the sorted order.
    """

    def __init__(self, sets: list[np.ndarray]):
        tokens = np.concatenate(sets)
        vocabulary, codes, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(vocabulary))
        split = np.cumsum([len(s) for s in sets])[:-1]
        self.sets = [np.sort(x) for x in np.split(rank[codes], split)]
        self.size = len(vocabulary)
        self.order = sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">u4").tobytes())
        self.root = self._build(0, len(self.order), 0)
        self.place = np.empty(len(sets), np.int64)
        self.place[self.order] = np.arange(len(sets))
        self._sketch()

    def _sketch(self) -> None:
        """Counts of each set's shingles in a number of bins; sets by size."""
        sizes = np.array([len(s) for s in self.sets])
        bins = 1 << min(10, max(6, int(np.median(sizes) * 4).bit_length()))
        self.by_size = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.by_size]
        # a bin holds a whole set at most
        self.counts = np.zeros((len(sizes), bins), np.uint16 if sizes.max() < 2**16 else np.uint32)
        for row, i in enumerate(self.by_size):
            np.add.at(self.counts[row], self.sets[i] % bins, 1)
        self.row = np.empty(len(sizes), np.int64)
        self.row[self.by_size] = np.arange(len(sizes))

    def _possible(self, probe: int, num: int, den: int, group: np.ndarray) -> np.ndarray:
        """Places in the tree's order of sets of other groups that size and bin counts allow a link with."""
        n = len(self.sets[probe])
        low, high = np.searchsorted(self.sizes, [-(-num * n // den), n * den // num + 1])
        rows = low + np.flatnonzero(group[self.by_size[low:high]] != group[probe])
        overlap = np.minimum(self.counts[rows], self.counts[self.row[probe]]).sum(1, dtype=np.int64)
        return self.place[self.by_size[rows[overlap * (den + num) >= num * (n + self.sizes[rows])]]]

    def _build(self, lo: int, hi: int, depth: int) -> list:
        """Node: [label, children, lo, hi, smallest size, largest size]; built without recursion."""
        root: list = []
        todo = [(lo, hi, depth, root)]
        while todo:
            lo, hi, depth, out = todo.pop()
            a, b = self.sets[self.order[lo]], self.sets[self.order[hi - 1]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:m] != b[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            sizes = [len(self.sets[self.order[i]]) for i in range(lo, hi)]
            node = [a[depth:end], [], lo, hi, min(sizes), max(sizes), end]
            out.append(node)
            at = lo
            while at < hi and len(self.sets[self.order[at]]) == end:
                at += 1
            while at < hi:
                token, to = self.sets[self.order[at]][end], at
                low, high = at, hi
                while high - low > 1:  # sets are sorted, so those that go on with token are neighbours
                    to = (low + high) // 2
                    if self.sets[self.order[to]][end] == token:
                        low = to
                    else:
                        high = to
                todo.append((at, high, end, node[1]))
                at = high
        return root[0]

    def links(self, probe: int, num: int, den: int, group: np.ndarray) -> list[int]:
        """Sets linked with the set probe, among those whose group is another than its own.

        The overlap along a path is computed once for all sets below it. A subtree goes when it
        holds no possible set, or when even if all that remains of the probe and of its longest
        set were common, the overlap would fall short.
        """
        possible = self._possible(probe, num, den, group)
        if not len(possible):
            return []
        below = np.zeros(len(self.sets) + 1, np.int64)
        below[possible + 1] = 1
        below = np.cumsum(below)
        x = self.sets[probe]
        n = len(x)
        has = np.zeros(self.size, bool)
        has[x] = True
        found, todo = [], [(self.root, 0)]
        while todo:
            (label, children, lo, hi, least, most, depth), overlap = todo.pop()
            if below[lo] == below[hi]:
                continue
            overlap += int(np.count_nonzero(has[label]))
            left_x = n - (int(np.searchsorted(x, label[-1], "right")) if len(label) else 0)
            bound = overlap + min(left_x, most - depth) if len(label) else n
            smallest = max(least, -(-num * n // den))
            if bound * (den + num) < num * (n + smallest):
                continue
            for i in range(lo, hi):
                at = self.order[i]
                if len(self.sets[at]) != depth:
                    break
                if below[i] != below[i + 1] and overlap * den >= num * (n + depth - overlap):
                    found.append(at)
            todo += [(c, overlap) for c in children]
        return found


def link_sets(keys: np.ndarray, sets: list[np.ndarray], num: int, den: int, probes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the linked sets: a set is not compared with those it is connected to already.

    probes: the sets that are searched with; all by default.
    """
    if len(sets) < 2:
        return []
    trie, group, out = Trie(sets), np.arange(len(sets)), []
    for p in range(len(sets)) if probes is None else probes:
        for q in trie.links(p, num, den, group):
            if group[q] != group[p]:
                out.append((int(keys[p]), int(keys[q])))
                group[group == group[q]] = group[p]
    return out


def _link_block(pdf: pd.DataFrame, num: int, den: int, link: Callable) -> pd.DataFrame:
    """Rows (part, key, probe, shingles) of a block -> links; each part has a trie of its own (see link_sets)."""
    links: list[tuple[int, int]] = []
    # a set that is there twice is a probe if either is
    rows = pdf.sort_values(["part", "key", "probe"], ascending=[True, True, False]).drop_duplicates(["part", "key"])
    part, keys, probe, sets = (rows[c].to_numpy() for c in ("part", "key", "probe", "shingles"))
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(rows) else []
    for lo, hi in zip(starts, [*starts[1:], len(rows)], strict=True):
        links += link(keys[lo:hi], [np.asarray(s, np.int64).view(np.uint64) for s in sets[lo:hi]], num, den, np.flatnonzero(probe[lo:hi]))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _candidates(docs: DataFrame, named: DataFrame, k: int, levels: Levels) -> DataFrame:
    """Edges (a, b) between keys that connect all sets which may be linked.

    The few sets whose ranges are uneven, if any, are joined by prefix shingles as well.
    """
    rows = docs.mapInArrow(partial(_sign_sets, k=k, levels=levels), "sig long, key long")
    shared = stage(rows.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(_shared, "sig long, key long"), "shared-signatures")
    edges = _counted(shared, named, levels)
    hard = stage(named.where("uneven").select("key").distinct(), "uneven")
    if hard.isEmpty():
        return edges
    rows = docs.mapInArrow(partial(_prefixes, k=k, levels=levels), "sig long, key long")
    mine = stage(join_small(rows, hard, ["key"]).select("sig", F.col("key").alias("a")).distinct(), "uneven-prefixes")
    return edges.union(join_small(rows.select("sig", F.col("key").alias("b")), mine, ["sig"]).where("a <> b").select("a", "b"))


def _counted(shared: DataFrame, named: DataFrame, levels: Levels) -> DataFrame:
    """Edges (a, b) that connect all sets which share as many signatures (sig, key) as linked ones do.

    Texts with a passage in common share a few by chance, which would chain most of a corpus; linked sets share
    more (see Levels.common). So sets that share too few with all others together go first. Where few
    sets have a signature they are paired up and pairs counted, and of the larger buckets a pair is taken to share as many as it
    may. What may be linked by larger buckets only has enough of them, and is linked with the first such set of each.
    """
    bit = F.col("sig").bitwiseAND(F.lit(1)).cast("int").alias("bit")
    classes = named.where("key is not null").dropDuplicates(["key"]).withColumnRenamed("n_shingles", "n")
    sides = classes.select("key", "n", "level", "filled", "least").union(classes.select("key", "n", F.col("level") + 1, "filled_next", "least_next")).withColumn("bit", F.col("level").bitwiseAND(F.lit(1)))
    enough = stage(shared.groupBy("key", bit).count().join(sides, ["key", "bit"]).where("count >= least").drop("count"), "signed-enough")
    live = join_small(shared.select("sig", "key", bit), enough, ["key", "bit"]).select("sig", "key", "n", "level", "filled", "least")
    found = stage(live.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(partial(_buckets, levels=levels), BUCKETS), "buckets")
    drop_staged(shared)
    large = found.where("b is null").select("sig", F.col("a").alias("key"), "level", "least")
    most = stage(large.groupBy("key", "level").agg(F.count("*").alias("most"), F.first("least").alias("least")), "large-buckets")
    pairs = found.where("b is not null").groupBy("a", "b", "level").agg(F.count("*").alias("both"), F.first("least").alias("least"))
    for end in ("a", "b"):
        pairs = pairs.join(most.select(F.col("key").alias(end), "level", F.col("most").alias(f"most_{end}")), [end, "level"], "left")
    pairs = pairs.where("both + least(coalesce(most_a, 0), coalesce(most_b, 0)) >= `least`").select("a", "b")
    many = stage(most.where("most >= `least`").select("key", "level"), "many-large")
    heavy = join_small(large.select("sig", "key", "level"), many, ["key", "level"])
    edges = pairs.union(heavy.select("sig", "key").repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(_stars, "a long, b long"))
    edges = stage(edges.distinct(), "candidates")
    drop_staged(enough, found, most, many)
    return edges


def link_rows(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, block_shingles: int = BLOCK_SHINGLES, levels: Levels | None = None) -> DataFrame:
    """Components of documents (doc_id, text, perhaps row_key) under Jaccard similarity of word k-shingles, num / den or more.

    Texts with A-Z lower-cased give sets of distinct shingles, as 64-bit hashes. Equal sets are
    one class. Signatures (see Levels), of which linked classes share a number, bring every two classes that may be linked into one
    candidate component (see _counted). Sets of these classes only are gathered into blocks, and a prefix tree
    in each finds links. A candidate component beyond block_shingles is taken apart by size, where a set
    goes with those of its class and with those of the next, and by further signatures (see _refined). What is still beyond is dealt over
    several blocks that share one set, its hub; whatever is not connected to the hub afterwards meets all others in
    blocks of pairs of parts. Classes that are connected already are not compared again, so
    components are exact without a list of all links.

    Texts without words and nulls have no set and are alone. A null doc_id is never the smallest
    one unless it is alone. Rows that repeat a doc_id or a text are rows of their own. An empty
    table gives an empty one.
    Returns doc_id, row_key (a hash of doc_id and text), n_shingles, root (of the component, null
    without a set) and component_id (the smallest doc_id of the component).
    """
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    row_key = F.col("row_key") if "row_key" in docs.columns else F.xxhash64(doc_id, "text").alias("row_key")
    rows = docs.select(row_key, "text", doc_id)
    docs = docs.select(doc_id, "text")
    levels = levels or Levels(num, den, 2**31)
    named = stage(rows.mapInArrow(partial(_name_sets, k=k, levels=levels), NAMED), "sets")
    classes = named.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"))
    comps = connected_components(_candidates(docs, named, k, levels))
    one = named.join(comps.withColumnRenamed("node", "key"), "key").groupBy("key", "root").agg(F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n"))

    def sets_of(one: DataFrame) -> DataFrame:
        texts = join_small(rows.select("row_key", "text"), one.select("row_key", "key", "large"), ["row_key"]).select("key", "text", "large")
        return texts.mapInArrow(partial(_texts_sets, k=k, levels=levels), SETS)

    links = link_candidates(one, sets_of, levels, block_shingles)
    roots = connected_components(links)
    labelled = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    ids = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    by_key = stage(labelled.join(ids, "root").select("key", "root", "component_id"), "components")
    out = named.join(by_key, "key", "left")
    return out.select("doc_id", "row_key", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def link_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; see link_rows."""
    return link_rows(docs.select("doc_id", "text"), **options).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component of link_rows: the first by doc_id, then by a hash of doc_id and text.

    Rows without words all stay, but of rows that repeat doc_id and text one stays. What goes is
    joined, not what stays; only rows whose doc_id and text repeat are brought together.
    """
    linked = stage(link_rows(docs.select("doc_id", "text"), **options), "linked")
    first = linked.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    gone = stage(linked.join(first.select("root", F.col("first.row_key").alias("stays")), "root").where("row_key <> stays").select("row_key").distinct(), "gone")
    twice = stage(linked.groupBy("row_key").count().where("count > 1").select("row_key"), "twice")
    kept = join_small(packed(docs, F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key")), gone, ["row_key"], "left_anti")
    if not twice.isEmpty():
        kept = join_small(kept, twice, ["row_key"], "left_anti").union(join_small(kept, twice, ["row_key"], "left_semi").dropDuplicates(["row_key"]))
    return unpacked(kept)


def _refined(sets: DataFrame, large: DataFrame, levels: Levels, block_shingles: int) -> DataFrame:
    """Candidate components beyond block_shingles (key, n, root), taken apart: key, n, root, probe.

    A set is a node at its own level and one at the next, where it meets larger sets only, so
    probe holds at its own. Linked sets share a signature at the level of the larger one however
    hashes are dealt over ranges. So components that are too large are signed again, each within
    itself and with the hashes dealt anew, and what no longer shares a signature parts, time after
    time. Components in which some set would be uneven are left as they are that time.
    """
    if large.isEmpty():
        return large.select("key", "n", "root", F.lit(True).alias("probe"))
    own = F.size(F.filter(F.array(*[F.lit(h) for h in levels.his]), lambda h: h < F.col("n")))
    name = F.xxhash64("key", "probe")
    nodes = large.join(sets.select("key", "bad"), "key").select("key", "n", "bad", "root", own.alias("own"), F.explode(F.array(F.lit(True), F.lit(False))).alias("probe"))
    node = F.when(F.col("probe"), name.bitwiseOR(F.lit(-(2**63)))).otherwise(name.bitwiseAND(F.lit(2**63 - 1)))
    label = F.xxhash64("root", F.col("own") + F.when(F.col("probe"), 0).otherwise(1))
    nodes, before = stage(nodes.select("key", "n", "bad", "probe", node.alias("node"), label.alias("label")), "nodes"), None
    for seed in range(1, ROUNDS + 1):
        sizes = nodes.groupBy("label").agg(F.sum("n").alias("total"), F.bit_or("bad").alias("bad"))
        big = stage(sizes.where((F.col("total") > block_shingles) & (F.getbit("bad", F.lit(seed)) == 0)).select("label", "total"), "big-labels")
        total = big.agg(F.sum("total")).first()[0]
        if not total or before and total > (1 - LEAST_GAIN) * before:
            break
        before, big = total, big.select("label")
        again = join_small(nodes, big, ["label"])
        at = lambda probe: F.max(F.when(probe, F.struct("node", "label")))
        wide = stage(again.groupBy("key").agg(at(F.col("probe")).alias("own"), at(~F.col("probe")).alias("next")), "nodes-of-sets")
        ends = [F.col(c).alias(c.replace(".", "_")) for c in ("own.node", "own.label", "next.node", "next.label")]
        rows = join_small(sets, wide, ["key"]).select("shingles", *ends).mapInArrow(partial(_sign_nodes, levels=levels, seed=seed), "sig long, node long")
        edges = rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(partial(_stars, negative=True), "a long, b long")
        parted = again.drop("label").join(connected_components(edges).withColumnRenamed("root", "label"), "node")
        nodes = stage(join_small(nodes, big, ["label"], "left_anti").unionByName(parted), "nodes")
    return nodes.select("key", "n", F.col("label").alias("root"), "probe")


def link_candidates(one: DataFrame, sets_of: Callable[[DataFrame], DataFrame], levels: Levels, block_shingles: int = BLOCK_SHINGLES, link: Callable = link_sets) -> DataFrame:
    """Links (a, b) that connect all linked sets within candidate components; link finds those of a part in memory.

    one: key, n (shingles, at least as many as there are) and root of each candidate set, and what sets_of needs to
    give key, n (exactly), shingles and bad (see _texts_sets) of rows of one with a flag large.
    """
    first = one = stage(one, "candidate-sets")
    whole = one.groupBy("root").agg(F.sum("n").alias("whole"))
    one = stage(one.join(whole, "root").withColumn("large", F.col("whole") > block_shingles), "candidate-sizes")
    sets = stage(sets_of(one), "candidate-shingles")
    # rows that repeat a text give its set as often
    one = stage(one.select("key", "root", "large").join(sets.select("key", "n").distinct(), "key"), "candidate-counts")
    out = _linked(one, sets, levels, block_shingles, link)
    drop_staged(first, one, sets)
    return out


def _linked(one: DataFrame, sets: DataFrame, levels: Levels, block_shingles: int, link: Callable) -> DataFrame:
    """Links of sets (key, n, shingles, bad) within the components of one (key, n, root, large), staged."""
    num, den = levels.num, levels.den
    one = one.where("not large").select("key", "n", "root", F.lit(True).alias("probe")).union(_refined(sets, one.where("large"), levels, block_shingles))
    sizes = one.groupBy("root").agg(F.sum("n").alias("total"), F.min("key").alias("hub"))
    total = sizes.agg(F.sum("total")).first()[0] or 0
    bins = max(1, -(-2 * total // block_shingles))
    place = stage(one.join(sizes, "root").select("key", "root", "probe", "hub", F.ceil(F.col("total") / block_shingles).cast("int").alias("parts")), "places")
    sets = join_small(sets.select("key", "shingles"), place, ["key"])
    schema = "a long, b long"
    linker = lambda pdf: _link_block(pdf, num, den, link)
    small = sets.where("parts = 1").select(F.pmod(F.xxhash64("root"), F.lit(bins)).alias("block"), F.col("root").alias("part"), "key", "probe", "shingles")
    links = small.groupBy("block").applyInPandas(linker, schema)
    if place.where("parts > 1").isEmpty():
        return stage(links, "links")
    large = sets.where("parts > 1")
    of = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    every = F.when(F.col("key") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(of))
    dealt = large.select("root", F.explode(every).alias("of"), "key", "probe", "shingles").withColumn("part", F.col("root"))
    first = stage(links.union(dealt.groupBy("root", "of").applyInPandas(_drop_keys(linker, ["root", "of"]), schema)), "links-1")
    roots = connected_components(first)
    state = large.select("key", "root", "hub", "parts", "shingles", of.alias("of")).join(roots.select(F.col("node").alias("key"), F.col("root").alias("mine")), "key", "left").withColumn("mine", F.coalesce("mine", "key"))
    hubs = roots.select(F.col("node").alias("hub"), F.col("root").alias("main"))
    state = stage(join_small(state, hubs, ["hub"], "left").withColumn("main", F.coalesce("main", "hub")), "links-state")
    rest = state.where("mine <> main")
    if rest.isEmpty():
        return first
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    probes = rest.select("root", F.col("of").alias("i"), F.explode(others).alias("j"), "key", F.lit(True).alias("probe"), "shingles")
    meet = rest.select("root", F.col("of").alias("i")).distinct()
    against = state.select("root", F.col("of").alias("j"), "key", F.lit(False).alias("probe"), "shingles").join(meet, "root")
    pairs = probes.unionByName(against).withColumn("part", F.col("root"))
    second = pairs.groupBy("root", "i", "j").applyInPandas(_drop_keys(linker, ["root", "i", "j"]), schema)
    return stage(first.union(second), "links-2")


def _drop_keys(f, keys: list[str]):
    return lambda pdf: f(pdf.drop(columns=[k for k in keys if k != "part"]))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(d, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
SELECT d AS doc_id, n.n AS n_shingles, min(c) AS component_id FROM r JOIN n ON n.doc_id = r.d GROUP BY d, n.n
"""

QUERIES = {"op9_ngram_join": op9_ngram_join}
ORACLE = {"op9_ngram_join": OP9_SQL}
