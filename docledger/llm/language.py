"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small, packed, stage, table, unpacked

#: Bytes that the network reads as one sequence; texts are cut into such windows and every byte is labelled.
WINDOW = 64
#: Units of each direction.
HIDDEN = 8
#: Bounds of the sample that the network is trained on, per language: documents, and windows of them together.
FIT_DOCS, FIT_WINDOWS = 300, 2400
#: Steps of training, of as many windows each, and the first rate.
STEPS, BATCH, RATE = 180, 256, 0.01
#: Texts that a worker cuts into windows at a time.
SLICE = 500
#: Windows that run through the network together.
LANES = 1024
UNKNOWN = "und"
#: Least score of a kept document, from 0 for chance to 1 for certainty.
LEAST_LIFT = 0.2


@dataclass
class Model:
    """Per direction (axis 0) input rows x [2, 256, 3H] by byte, recurrent u [2, H, 3H]; output v [2H, C], b [C].

    Gates are reset, update, candidate in thirds. Squashing of gates is (1 + tanh) / 2.
    """

    langs: list[str]
    x: np.ndarray
    u: np.ndarray
    v: np.ndarray
    b: np.ndarray

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.v, self.b]


def new_model(langs: list[str], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    h = HIDDEN
    return Model(langs, draw(0.3, 2, 256, 3 * h), draw(0.5 / h**0.5, 2, h, 3 * h), draw(0.3, 2 * h, len(langs)), np.zeros(len(langs), np.float32))


def _both(windows: np.ndarray) -> np.ndarray:
    """[B, L] bytes -> [L, 2, B]: step t reads byte t forward and byte L - 1 - t backward."""
    return np.ascontiguousarray(np.stack((windows.T, windows.T[::-1]), axis=1)).astype(np.intp)


def states(m: Model, windows: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """Hidden states [L, 2, B, H] of both directions by step, with what backpropagation needs."""
    steps, h2, h = _both(windows), 2 * HIDDEN, HIDDEN
    length, _, lanes = steps.shape
    out = np.empty((length, 2, lanes, h), np.float32)
    flat = m.x.reshape(512, 3 * h)
    steps[:, 1] += 256
    last = np.zeros((2, lanes, h), np.float32)
    kept = []
    for t in range(length):
        a = flat[steps[t]]
        w = last @ m.u
        g = (np.tanh(a[..., :h2] + w[..., :h2]) + 1) * 0.5
        r, z = g[..., :h], g[..., h:]
        c = np.tanh(a[..., h2:] + r * w[..., h2:])
        kept.append((last, r, z, c, w[..., h2:]))
        last = out[t] = c + z * (last - c)
    return out, kept, steps


def run_states(m: Model, windows: np.ndarray) -> np.ndarray:
    """The hidden states of states, in place: half of 1 + tanh is folded into the candidate's weights and the last step."""
    steps, h2, h = _both(windows), 2 * HIDDEN, HIDDEN
    length, _, lanes = steps.shape
    steps[:, 1] += 256
    flat, u = np.ascontiguousarray(m.x.reshape(512, 3 * h)), m.u.copy()
    u[..., h2:] *= 0.5
    out = np.zeros((length + 1, 2, lanes, h), np.float32)
    a, w = (np.empty((2, lanes, 3 * h), np.float32) for _ in range(2))
    c, d = (np.empty((2, lanes, h), np.float32) for _ in range(2))
    g = np.empty((2, lanes, h2), np.float32)
    for t in range(length):
        last = out[t]
        np.take(flat, steps[t], axis=0, out=a, mode="clip")
        np.matmul(last, u, out=w)
        np.add(a[..., :h2], w[..., :h2], out=g)
        np.tanh(g, out=g)
        g += 1
        np.multiply(g[..., :h], w[..., h2:], out=c)
        c += a[..., h2:]
        np.tanh(c, out=c)
        np.subtract(last, c, out=d)
        d *= g[..., h:]
        d *= 0.5
        np.add(c, d, out=out[t + 1])
    return out[1:]


def _aligned(out: np.ndarray) -> np.ndarray:
    """[L, 2, B, H] by step -> [L, B, 2H] by position."""
    return np.concatenate((out[:, 0], out[::-1, 1]), axis=2)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def loss_and_gradients(m: Model, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
    h, h2 = HIDDEN, 2 * HIDDEN
    out, kept, steps = states(m, windows)
    length, _, lanes, _ = out.shape
    hidden = _aligned(out)
    p = _softmax(hidden @ m.v + m.b)
    each = np.arange(lanes)
    loss = -float(np.log(p[:, each, labels] + 1e-9).mean())
    d = p
    d[:, each, labels] -= 1
    d /= length * lanes
    gv = np.tensordot(hidden, d, ([0, 1], [0, 1]))
    gb = d.sum((0, 1))
    dh = d @ m.v.T
    by_step = np.stack((dh[..., :h], dh[::-1, :, h:]), axis=1)
    gx, gu = np.zeros((512, 3 * h), np.float32), np.zeros_like(m.u)
    after = np.zeros((2, lanes, h), np.float32)
    ut = m.u.transpose(0, 2, 1)
    for t in range(length - 1, -1, -1):
        last, r, z, c, wn = kept[t]
        g = after + by_step[t]
        dc = g * (1 - z) * (1 - c * c)
        dr, dz = dc * wn * 2 * r * (1 - r), g * (last - c) * 2 * z * (1 - z)
        da = np.concatenate((dr, dz, dc), axis=2)
        dw = np.concatenate((dr, dz, dc * r), axis=2)
        gu += last.transpose(0, 2, 1) @ dw
        at = steps[t].ravel()
        flat = da.reshape(-1, 3 * h)
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) != 0)))
        gx[at[order][first]] += np.add.reduceat(flat[order], first, axis=0)
        after = g * z + dw @ ut
    return loss, [gx.reshape(m.x.shape), gu, gv, gb]


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = 7) -> Model:
    """Train on [N, WINDOW] bytes with a language number each, by Adam with gradients clipped in norm."""
    m = new_model(langs, seed)
    if len(langs) < 2 or not len(windows):
        return m
    rng = np.random.default_rng(seed)
    first, second = [np.zeros_like(p) for p in m.parameters], [np.zeros_like(p) for p in m.parameters]
    step, epochs = 0, -(-steps // -(-len(windows) // BATCH))
    total = epochs * -(-len(windows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            _, grads = loss_and_gradients(m, windows[own], labels[own])
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for p, g, a, b in zip(m.parameters, grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows [N, WINDOW] of whole texts, zero-padded at a text's end; text number and used bytes of each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // WINDOW)
    data = np.frombuffer(b"".join(t + b"\0" * (-len(t) % WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    used = np.full(len(owner), WINDOW, np.int64)
    ends = np.cumsum(counts)[counts > 0] - 1
    used[ends] = ((sizes - 1) % WINDOW + 1)[counts > 0]
    return data, owner, used


def label_positions(m: Model, windows: np.ndarray) -> np.ndarray:
    """Language probabilities [L, B, C] at every position."""
    hidden = _aligned(run_states(m, windows))
    p = hidden.reshape(-1, 2 * HIDDEN) @ m.v
    p += m.b
    np.exp(p, out=p)  # states are within 1, so this cannot overflow
    p /= p @ np.ones((p.shape[1], 1), np.float32)
    return p.reshape(*hidden.shape[:2], -1)


def pooled(m: Model, texts: list[bytes]) -> np.ndarray:
    """Mean over all positions of each text of their language probabilities [len(texts), C]; 0 for empty ones."""
    windows, owner, used = cut(texts)
    out = np.zeros((len(texts), len(m.langs)))
    inside = np.arange(WINDOW)[:, None]
    for i in range(0, len(windows), LANES):
        own = slice(i, i + LANES)
        p = label_positions(m, windows[own])
        sums = p.sum(0) if (used[own] == WINDOW).all() else np.where((inside < used[own])[..., None], p, 0).sum(0)
        np.add.at(out, owner[own], sums)
    return out / np.maximum(np.array([len(t) for t in texts]), 1)[:, None]


_PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(m: Model, text: Column) -> Column:
    """Struct (lang_pred, score) of whole texts; `und` with score 0 where text is null or has no letter."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            texts = (s.iloc[i : i + SLICE] for i in range(0, len(s), SLICE))
            p = np.concatenate([np.empty((0, len(m.langs))), *(pooled(m, [t.encode("utf-8", "surrogatepass") if t else b"" for t in x]) for x in texts)])
            best = p.argmax(1)
            yield pd.DataFrame({"lang_pred": np.array(m.langs, object)[best], "score": np.clip(p[np.arange(len(p)), best], 0, 1)})

    udf = F.pandas_udf(run, _PREDICTED, F.PandasUDFType.SCALAR_ITER).asNondeterministic()
    named = udf(F.when(text.rlike(r"\p{L}"), text))
    return F.when(text.rlike(r"\p{L}"), named).otherwise(F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")))


def _draw_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h, lang, text, per_doc) -> (h, lang, window): windows at places drawn from the whole text."""
    for pdf in frames:
        rows = []
        for h, lang, text, per_doc in zip(pdf["h"], pdf["lang"], pdf["text"], pdf["per_doc"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            rng = np.random.default_rng(int(h) & (2**63 - 1))
            starts = range(0, len(raw), WINDOW) if len(raw) <= WINDOW * per_doc else sorted(rng.integers(0, len(raw) - WINDOW, per_doc))
            rows += [(h, lang, raw[s : s + WINDOW].ljust(WINDOW, b"\0")) for s in starts]
        yield pd.DataFrame(rows, columns=["h", "lang", "window"])


def sample_windows(docs: DataFrame, learn: Column, fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS, seed: int = 7) -> DataFrame:
    """Windows (h, lang, window) of a bounded sample of rows where learn holds, and lang, doc_id and text are not null.

    fit_docs documents a language at most, the first by a hash of doc_id and text, share fit_windows windows,
    so that languages weigh alike. Rows that repeat doc_id, text and lang are one document. At most fit_docs - 1 windows
    more are drawn, since a document gives a whole number of them.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"), "text")
    # the hash reads whole texts, so it is taken once
    distinct = stage(rows.select("lang", "h").distinct(), "sample-keys")
    counts = distinct.groupBy("lang").count()
    # of many documents a share is ordered that has fit_docs of them for certain; of few all are
    share = (F.shiftrightunsigned("h", 11) / float(2**53)) * F.col("count") <= 3 * fit_docs + 20
    chosen = join_small(distinct, counts, ["lang"]).where(share).withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("at") <= fit_docs)
    per_doc = F.ceil(fit_windows / F.count("*").over(Window.partitionBy("lang"))).cast("int")
    chosen = stage(chosen.select("h", "lang", per_doc.alias("per_doc")), "sample")
    texts = join_small(rows, chosen, ["h", "lang"]).groupBy("h", "lang", "per_doc").agg(F.first("text").alias("text"))
    return texts.mapInPandas(_draw_windows, "h long, lang string, window binary")


def fit(docs: DataFrame, learn: Column, fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS, seed: int = 7) -> Model:
    """Train on sample_windows. What reaches the driver is bounded by the number of languages times fit_windows + fit_docs."""
    drawn = sample_windows(docs, learn, fit_docs, fit_windows, seed).collect()
    drawn.sort(key=lambda r: (r["lang"], r["h"], r["window"]))
    langs = sorted({r["lang"] for r in drawn})
    windows = np.frombuffer(b"".join(bytes(r["window"]) for r in drawn), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([langs.index(r["lang"]) for r in drawn], np.int64), langs or [UNKNOWN], seed=seed)


def held_out() -> Column:
    """Documents that nothing is learned from; a null doc_id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang and more) with held_out and the struct language (lang_pred, score).

    Trained on rows that are not held out; only the text enters a prediction. Every byte of every
    text is labelled, LANES windows at a time, so a very long text needs no more memory than its bytes. Of languages
    with equal probability the first by name is predicted. Repeated rows get equal results; null, empty and letterless texts `und`
    with score 0; no labelled rows give `und` everywhere; an empty table an empty one.
    """
    model = fit(docs, ~held_out())
    return docs.withColumn("held_out", held_out()).withColumn("language", predict(model, F.col("text")))


def keep_identified(docs: DataFrame, least_lift: float = LEAST_LIFT) -> DataFrame:
    """docs without those that have no language, or one that is hardly likelier than chance.

    The score must lie least_lift of the way from 1 / languages to 1, so the bound means the same for any number of languages.
    """
    rows = packed(docs, "doc_id", "text", "lang")
    model = fit(rows, ~held_out())
    chance = 1 / len(model.langs)
    least = min(chance + least_lift * (1 - chance), 0.99)
    out = rows.withColumn("language", predict(model, F.col("text")))
    return unpacked(out.where((F.col("language.lang_pred") != UNKNOWN) & (F.col("language.score") >= least)))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "language.lang_pred", "language.score")


QUERIES = {"op4_language": op4_language}
ORACLE: dict[str, str] = {}
