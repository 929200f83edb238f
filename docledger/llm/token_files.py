"""Token ids of documents in shards of a Re-Pair grammar, and their random-access decoding."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, stage, table

#: Bytes of text of a shard, about: what one grammar covers and a task holds at once. A longer document is a shard of its own.
SHARD_BYTES = 6_000_000
#: Rounds of replacement, pairs replaced in one, least occurrences of a pair.
ROUNDS, PAIRS, LEAST = 3, 5200, 32
#: Symbols of a shard at most, so that two bytes hold one where the vocabulary allows it.
SYMBOLS = 1 << 16
#: Binary logarithm of the slots in which a round looks pairs up.
SLOT_BITS = 17
#: Ids that end documents, and pieces of text whose ids a task remembers.
END, REMEMBERED = 0, 800_000
#: Bytes of text given to the tokenizer in one call.
CALL_BYTES = 20_000
#: Characters around a space at which a byte-level tokenizer surely parts, whatever else stands there. The others stay together.
_SURE = "!-~À-ɏ"
_PLAIN = re.compile(f"[{_SURE}](?:.*[{_SURE}])?", re.DOTALL)
_MARKS = ".,;:!?"
_MARKED = re.compile(f"[A-Za-zÀ-ÖØ-öø-ɏ][{_MARKS}]$(?!\n)")
_PLAIN_END = re.compile(f"[{_SURE}]$(?!\n)")

SHARDS = (
    "part int, seq int, n_ids long, doc_ids array<long>, ends array<long>, symbol_ends array<long>, width int, first_rule int, "
    "left binary, right binary, lengths array<int>, symbols binary"
)


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library, each closed by END.

    A tokenizer on bytes parts a text before a space between two plain characters, so what stands between
    such places is encoded once and remembered. Distinct words are encoded in a row, and the numbers of bytes
    of their ids part them again. A text with other places around a space is encoded as it is.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= SYMBOLS else "<u4")
        self.bytes_of = np.zeros(self.size, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]  # one character stands for one byte
        self.known: dict[str, bytes] = {}
        self.marks = {m: ids.tobytes() for m, ids in zip(_MARKS, self._encoded(list(_MARKS)), strict=True)}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words with a space before each; words begin and end in a plain character."""
        sizes = np.array([len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass")) for w in words], np.int64) + 1
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // CALL_BYTES)) + 1), len(words)]
        out: dict[str, bytes] = {}
        spans = list(zip(cuts, cuts[1:], strict=False))
        for (a, b), ids in zip(spans, self._encoded([" " + " ".join(words[a:b]) for a, b in spans]), strict=True):
            at = ((np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes[a:b])) + 1) * self.kind.itemsize).tolist()
            raw = ids.tobytes()
            out.update(zip(words[a:b], (raw[s:e] for s, e in zip([0, *at], at, strict=False)), strict=True))
        return out

    def _of_words(self, words: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of words with a space before each, and which of them are odd, so that what stands around them must stay with them."""
        found = list(map(self.known.get, words))
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        marked, plain = [], []
        for w in new:
            if _MARKED.search(w):  # a tokenizer on bytes always parts between a letter and a mark
                marked.append(w)
            elif _PLAIN.fullmatch(w):
                plain.append(w)
        wanted = list({*plain, *(w[:-1] for w in marked if w[:-1] not in self.known and _PLAIN.fullmatch(w[:-1]))})
        learnt = self._learn(wanted) if wanted else {}
        for w in marked:
            if (own := self.known.get(w[:-1]) or learnt.get(w[:-1])) is not None:
                learnt[w] = own + self.marks[w[-1]]
        found = [learnt.get(w, b"") if ids is None else ids for w, ids in zip(words, found, strict=True)]
        if (room := REMEMBERED - len(self.known)) > 0:
            self.known.update(itertools.islice(learnt.items(), room))
        return found, np.array([not f for f in found], bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, each closed by END, and the end of each; null and empty texts have the end alone.

        Words are split and numbered by Arrow, so Python sees each distinct one once, and ids are put together by their numbers.
        """
        rows = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), " ")
        numbered = rows.values.dictionary_encode()
        offsets, code = rows.offsets.to_numpy(), numbered.indices.to_numpy().astype(np.int64)
        first, size = offsets[:-1], np.diff(offsets)
        words = numbered.dictionary.to_pylist()
        table, odd = self._of_words(words)
        heads, head = np.unique(code[first], return_inverse=True)
        loose = np.array([not _PLAIN_END.search(words[h]) for h in heads.tolist()], bool)
        is_odd = odd[code]
        is_odd[first] = loose[head] & (size > 1)
        whole = np.flatnonzero(np.logical_or.reduceat(is_odd, first)) if len(first) else first
        code[first] = len(words) + head
        table = table + [ids.tobytes() for ids in self._encoded([words[h] for h in heads.tolist()])]
        if len(whole):  # these texts are encoded as they are, in place of their first word
            code[np.repeat(np.isin(np.arange(len(size)), whole), size)] = len(table)
            code[first[whole]] = len(table) + 1 + np.arange(len(whole))
            table += [b"", *(ids.tobytes() for ids in self._encoded(texts.take(pa.array(whole)).to_pylist()))]
        code = np.insert(code, offsets[1:], len(table))
        table.append(np.array([END], self.kind).tobytes())
        lengths = np.array([len(t) for t in table], np.int64) // self.kind.itemsize
        flat, start = np.frombuffer(b"".join(table), self.kind), np.cumsum(lengths) - lengths
        own = lengths[code]
        ends = np.cumsum(own)
        return flat[np.repeat(start[code] - (ends - own), own) + np.arange(own.sum())], ends[offsets[1:] + np.arange(len(size))]


def _pairs(x: np.ndarray) -> np.ndarray:
    """Each symbol with its successor as one number; 0 where one of them ends a document."""
    wide = x.astype(np.uint32 if x.itemsize == 2 else np.uint64)
    pairs = (wide[:-1] << wide.dtype.type(x.itemsize * 8)) | wide[1:]
    ends = np.flatnonzero(x == END)
    pairs[ends[ends < len(pairs)]] = 0
    pairs[ends[ends > 0] - 1] = 0
    return pairs


def repair(ids: np.ndarray, first_rule: int, rounds: int = ROUNDS, pairs: int = PAIRS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of ids under a grammar of pairs, and left and right sides of its rules, numbered from first_rule on.

    Each round counts all pairs and gives the most frequent ones a nonterminal each. Where chosen pairs overlap the
    more frequent one is replaced; the other may be chosen again in the next round. Pairs with an END are left alone,
    so documents keep their bounds. The number of symbols stays within the type of ids.
    """
    left, right, x, room = [], [], ids, int(min(np.iinfo(ids.dtype).max, (1 << 31) - 1)) - first_rule + 1
    for _ in range(rounds):
        if len(x) < 2 or room <= 0:
            break
        at = _pairs(x)
        ordered = np.sort(at)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        n = np.diff(first, append=len(ordered))
        frequent = np.flatnonzero((n >= least) & (ordered[first] != 0))
        if not len(frequent):
            break
        frequent = frequent[np.argsort(-n[frequent], kind="stable")][: min(pairs, room)]
        chosen = ordered[first[frequent]]
        spread = at.dtype.type(0x9E3779B1)
        slot = lambda p: (((p ^ (p >> p.dtype.type(15))) * spread) & p.dtype.type(0xFFFFFFFF)) >> p.dtype.type(32 - SLOT_BITS)
        _, own = np.unique(slot(chosen), return_index=True)  # the most frequent pair of a slot; others wait for another round
        chosen = chosen[np.sort(own)]
        held, rank = np.zeros(1 << SLOT_BITS, at.dtype), np.zeros(1 << SLOT_BITS, np.int32)
        held[slot(chosen)], rank[slot(chosen)] = chosen, np.arange(len(chosen))
        where = slot(at)
        r = np.where((held[where] == at) & (at != 0), rank[where], len(chosen)).astype(np.int32)
        r = np.concatenate(([len(chosen)], r, [len(chosen)]))
        taken = np.flatnonzero((r[1:-1] < r[:-2]) & (r[1:-1] <= r[2:]) & (r[1:-1] < len(chosen)))
        y = x.copy()
        y[taken] = (first_rule + len(left) + r[taken + 1]).astype(x.dtype)
        keep = np.ones(len(x), bool)
        keep[taken + 1] = False
        x = y[keep]
        low = at.dtype.type((1 << (x.itemsize * 8)) - 1)
        left += (chosen >> at.dtype.type(x.itemsize * 8)).tolist()
        right += (chosen & low).tolist()
        room -= len(chosen)
    return x, np.array(left, ids.dtype), np.array(right, ids.dtype)


def rule_lengths(left: np.ndarray, right: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that each rule stands for; a rule names earlier ones only."""
    out = np.ones(len(left), np.int64)
    length = lambda s: int(out[s - first_rule]) if s >= first_rule else 1
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        out[i] = length(a) + length(b)
    return out


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids behind symbols, level by level of the grammar."""
    x = symbols
    while len(rules := np.flatnonzero(pairs := x >= first_rule)):
        which = x[rules].astype(np.int64) - first_rule
        out = np.repeat(x, pairs.view(np.int8) + np.int8(1))
        at = rules + np.arange(len(rules))
        out[at], out[at + 1] = left[which], right[which]
        x = out
    return x


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder per worker, so that what it remembers serves its later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _symbol_lengths(symbols: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    out = np.ones(len(symbols), np.int64)
    rules = np.flatnonzero(symbols >= first_rule)
    out[rules] = lengths[symbols[rules].astype(np.int64) - first_rule]
    return out


def _shard(part: int, seq: int, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray, encoder: Encoder) -> pa.RecordBatch:
    symbols, left, right = repair(ids, encoder.size)
    lengths = rule_lengths(left, right, encoder.size)
    symbol_ends = np.searchsorted(np.cumsum(_symbol_lengths(symbols, lengths, encoder.size)), ends) + 1
    row = (part, seq, len(ids), doc_ids.to_pylist(), ends, symbol_ends, encoder.kind.itemsize, encoder.size, left.tobytes(), right.tobytes(), lengths, symbols.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=_COLUMNS)


_COLUMNS = [c.split()[0] for c in SHARDS.split(", ")]
_TYPES = [
    pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary(),
]


def _encode(batches: Iterator[pa.RecordBatch], path: str, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    encoder, part, seq = _encoder(path), TaskContext.get().partitionId(), 0
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(size // shard_bytes)) + 1), len(size)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own, texts = (batch.column(i).slice(a, b - a) for i in (0, 1))
            yield _shard(part, seq, own, *encoder.encode(texts), encoder)
            seq += 1


def encode_shards(docs: DataFrame, tokenizer: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of the ids of documents (doc_id, text) in ascending doc_id order, one row per shard.

    tokenizer is the path of a byte-level tokenizer's file, on every executor. Documents are dealt into ranges of
    doc_id and sorted within them; a task cuts its range into shards of shard_bytes of text, so it holds one shard at
    a time. (part, seq) orders shards. A shard has the grammar's rules with their expansion lengths, its
    symbols in width bytes each, and for each document its last id and symbol, counted from the shard's first.

    Null doc_ids come first, rows that repeat one in order of their text. Null and empty texts have the
    end alone. A text longer than a shard is one of its own, held whole. Other columns are not read. Empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return rows.mapInArrow(lambda batches: _encode(batches, tokenizer, shard_bytes), SHARDS)


def _grammar(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, ...]:
    kind = np.dtype(f"<u{batch.column('width')[r].as_py()}")
    return tuple(np.frombuffer(batch.column(c)[r].as_py(), kind) for c in ("symbols", "left", "right"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            symbols, left, right = _grammar(batch, r)
            raw = memoryview(expand(symbols, left, right, batch.column("first_rule")[r].as_py()).astype("<u4").tobytes())
            ends = batch.column("ends")[r].values.to_numpy()
            starts = np.concatenate(([0], ends[:-1]))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(ends)
            columns = [pa.array([batch.column(c)[r].as_py()] * n, pa.int32()) for c in ("part", "seq")]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("doc_ids")[r].values, pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"])


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, base): ids of all shards before each; a part's shards are summed first, so no window has all of them."""
    sizes = shards.select("part", "seq", "n_ids")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before.alias("part_base"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("part", "seq", within.alias("within")).join(parts, "part").select("part", "seq", (F.col("part_base") + F.col("within")).alias("base"))


def digests(shards: DataFrame) -> DataFrame:
    """Per document of written shards, decoded whole: doc_id, start (ids before it), n_tokens, ids_crc32."""
    read = shards.mapInArrow(_digest, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    placed = join_small(read, stage(shard_starts(shards), "shard-starts"), ["part", "seq"])
    return placed.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def _slice(symbols: np.ndarray, lengths: np.ndarray, left: np.ndarray, right: np.ndarray, first_rule: int, a: int, b: int) -> np.ndarray:
    """Ids a to b of symbols: only the symbols that cover them are expanded."""
    ends = np.cumsum(_symbol_lengths(symbols, lengths, first_rule))
    first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b)
    skipped = int(ends[first - 1]) if first else 0
    return expand(symbols[first : last + 1], left, right, first_rule)[a - skipped : b - skipped]


def read_spans(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of spans (doc_id, start, stop) of documents, counted within each: random access without decoding a shard.

    A span reads its document's symbols and expands those that cover it by the rules' expansion lengths. Spans are
    gathered by shard. Spans are cut at the document's end, empty ones give no ids, unknown or null doc_ids no rows.
    Returns doc_id, start, stop, ids (array of int).
    """
    entry = F.explode(F.arrays_zip("doc_ids", F.sequence(F.lit(0), F.size("doc_ids") - 1).alias("at")))
    places = shards.select("part", "seq", entry.alias("e")).select("part", "seq", F.col("e.doc_ids").alias("doc_id"), F.col("e.at").alias("at"))
    asked = wanted.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    by_shard = asked.join(places, "doc_id").groupBy("part", "seq").agg(F.collect_list(F.struct("at", "doc_id", "start", "stop")).alias("asked"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                (symbols, left, right), first_rule = _grammar(batch, r), batch.column("first_rule")[r].as_py()
                lengths, ends, symbol_ends = (batch.column(c)[r].values.to_numpy() for c in ("lengths", "ends", "symbol_ends"))
                rows = batch.column("asked")[r].as_py()
                found = []
                for x in rows:
                    at = x["at"]
                    n, own = int(ends[at] - (ends[at - 1] if at else 0)), symbols[symbol_ends[at - 1] if at else 0 : symbol_ends[at]]
                    a, b = max(x["start"], 0), min(x["stop"], n)
                    found.append(_slice(own, lengths, left, right, first_rule, a, b).tolist() if a < b else [])
                yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in rows], pa.int64()) for c in ("doc_id", "start", "stop")), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "start", "stop", "ids"])

    columns = ("ends", "symbol_ends", "width", "first_rule", "left", "right", "lengths", "symbols")
    return shards.select("part", "seq", *columns).join(by_shard, ["part", "seq"]).drop("part", "seq").mapInArrow(decode, "doc_id long, start long, stop long, ids array<int>")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = encode_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return digests(stage(shards, "token-shards"))


QUERIES = {"op12_token_files": op12_token_files}
ORACLE: dict[str, str] = {}
