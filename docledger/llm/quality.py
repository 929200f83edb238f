"""Quality rules: text statistics and decision lists learned from labels. DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, stage, table, words

#: Most labelled rows that a decision list is fitted on, the first in the order of a hash of doc_id.
FIT_ROWS = 50_000
#: Quantiles of each class from which thresholds are drawn.
QUANTILES = 24


def _covered(starts: Column) -> Column:
    """Words covered by 3-word windows at these ascending starts."""
    steps = F.transform(starts, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - x, F.lit(3)).cast("int")))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def _with_repeats(df: DataFrame) -> DataFrame:
    """Add n_words and n_repeat_words of a column w of words.

    Windows are hashed to 64 bits, sorted with their positions, and those that equal a neighbour repeat.
    Each step is a column of its own, so that no lambda computes another one anew.
    """
    pairs = F.col("pairs")
    alike = lambda x, j, i: F.coalesce(F.get(pairs, j + i)["h"] == x["h"], F.lit(False))
    window = lambda i: F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1), F.get("hashes", i + 2))
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.col("n_words").cast("int") - 3))
    df = df.withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n_words", F.size("hashes").cast("long")).drop("w")
    df = df.withColumn("pairs", F.sort_array(F.transform(starts, lambda i: F.struct(window(i).alias("h"), i.alias("i"))))).drop("hashes")
    df = df.withColumn("found", F.transform(F.filter(pairs, lambda x, j: alike(x, j, -1) | alike(x, j, 1)), lambda x: x["i"]))
    df = df.drop("pairs").withColumn("repeats", F.sort_array("found")).drop("found")
    return df.withColumn("n_repeat_words", F.coalesce(_covered(F.col("repeats")), F.lit(0))).drop("repeats")


def _size(c: Column) -> Column:
    return F.char_length(c).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """Statistics of whole texts: the base's counts and the ratios that rules are learned from.

    Null and blank texts count 0 everywhere and have ratios of 0. docs keeps all columns but text.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    df = docs.withColumn("text", t).withColumns({
        "w": words(F.col("text")),
        "word_chars": _size(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")),
        "n_symbols": _size(F.regexp_replace("text", r"[^#*$%&|<>]+", "")),
        "n_upper": _size(F.regexp_replace("text", r"\P{Lu}+", "")),
        "n_marks": _size(F.regexp_replace("text", r"[^!?]+", "")),
        "n_digits": _size(F.regexp_replace("text", r"[^0-9]+", "")),
        "lines": lines,
    }).drop("text")
    df = df.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines"))).drop("lines")
    df = _with_repeats(df)
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return df.withColumns({
        "r_word": ratio("word_chars", "n_words"), "r_symbol": ratio("n_symbols", "n_words"), "r_upper": ratio("n_upper", "word_chars"),
        "r_mark": ratio("n_marks", "n_words"), "r_digit": ratio("n_digits", "word_chars"), "r_dup_line": ratio("n_dup_lines", "n_lines"),
        "r_repeat": ratio("n_repeat_words", "n_words"), "r_line": ratio("n_words", "n_lines"),
    })


FEATURES = ("r_word", "r_symbol", "r_upper", "r_mark", "r_digit", "r_dup_line", "r_repeat", "r_line")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all its conditions."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _thresholds(rows: DataFrame, features: tuple[str, ...]) -> dict[str, list[float]]:
    """Midpoints between neighbours among the quantiles of either class."""
    qs = [i / QUANTILES for i in range(QUANTILES + 1)]
    got = rows.groupBy("bad").agg(*[F.percentile_approx(f, qs, 10_000).alias(f) for f in features]).collect()
    out = {}
    for f in features:
        v = sorted({x for r in got for x in r[f] or ()})
        out[f] = [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]
    return out


def learn_decision_list(rows: DataFrame, features: tuple[str, ...] = FEATURES, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.97, least_share: float = 0.002) -> list[Rule]:
    """Ordered rules that recognise bad rows, by sequential covering.

    rows has a boolean bad, a double draw in [0, 1) and the features. Two thirds of the rows by
    draw grow rules, the others prune them. A rule grows by the condition of the greatest FOIL gain
    until it covers no good row; then the number of leading conditions that is most precise
    on the pruning rows stays. It joins the list if it is precise enough there and covers
    least_share of the rows, and the rows it covers leave. Each step is one aggregate: every row
    gives its bin per feature, and only counts by (feature, bin, class) reach the driver.

    Null features meet no condition. No rows or one class only give an empty list.
    """
    thresholds = _thresholds(rows, features)
    if not any(thresholds.values()):
        return []

    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(t) for t in thresholds[f]]), lambda t: F.col(f) > t))

    bins = [F.struct(F.lit(i).alias("f"), bin_of(f).alias("b")) for i, f in enumerate(features) if thresholds[f]]
    used = ("bad", "draw", *features)
    rows = stage(rows.select(*used).withColumn("bins", F.array(*bins)), "labelled")
    total = rows.count()
    rules: list[Rule] = []

    def grow(left: DataFrame) -> tuple[Condition, ...]:
        chosen: tuple[Condition, ...] = ()
        while len(chosen) < max_conditions:
            inside = reduce(lambda d, c: d.where(c.column()), chosen, left)
            counts = inside.select("bad", F.explode("bins").alias("x")).groupBy("x.f", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            by = {i: {} for i in range(len(features))}
            for r in counts:
                by[r["f"]][r["b"]] = (r["p"], r["n"])
            best, gain = None, 0.0
            for i, f in enumerate(features):
                p0, n0 = (sum(x[k] for x in by[i].values()) for k in (0, 1))
                if not p0:
                    continue
                p = n = 0
                for b, t in enumerate(thresholds[f]):
                    p, n = p + by[i].get(b, (0, 0))[0], n + by[i].get(b, (0, 0))[1]
                    for above, (a, c) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        g = a * (math.log2(a / (a + c)) - math.log2(p0 / (p0 + n0))) if a else 0.0
                        if g > gain * (1 + 1e-9) + 1e-9:
                            best, gain, pure = Condition(f, above, t), g, c == 0
            if best is None:
                break
            chosen += (best,)
            if pure:
                break
        return chosen

    while len(rules) < max_rules:
        left = reduce(lambda d, r: d.where(~r.column()), rules, rows)
        conditions = grow(left.where("draw < 0.6666"))
        if not conditions:
            break
        prefixes = [Rule(conditions[: k + 1]) for k in range(len(conditions))]
        counts = left.where("draw >= 0.6666").agg(*[F.count_if(r.column() & (F.col("bad") == bad)).alias(f"{k}{int(bad)}") for k, r in enumerate(prefixes) for bad in (True, False)]).first()
        scored = [((counts[f"{k}1"] + 1) / (counts[f"{k}1"] + counts[f"{k}0"] + 2), -k) for k in range(len(prefixes))]
        k = -max(scored)[1]
        p, n = counts[f"{k}1"], counts[f"{k}0"]
        if not p or p / (p + n) < precision or 3 * (p + n) < least_share * total:
            break
        rules.append(prefixes[k])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: true keeps."""
    out = F.lit(True)
    for r in reversed(rules):
        out = F.when(r.column(), F.lit(False)).otherwise(out)
    return out


def label_rows(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Statistics of at most about fit_rows labelled documents, by a hash of doc_id; bad: quality is 0.

    A document labelled more than once counts as bad if its mean quality is below a half.
    """
    judged = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    n = labels.select("doc_id").distinct().count()
    unit = lambda seed: (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / float(2**53))
    judged = judged.where(unit(1) < min(1.0, fit_rows / max(n, 1))).withColumn("draw", unit(2))
    if n <= BROADCAST_ROWS or fit_rows <= BROADCAST_ROWS:
        judged = F.broadcast(judged)
    return stats.join(judged, "doc_id")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of documents, the base rules' verdict and that of a list learned from labels.

    The list is learned on labelled rows that pass the base, and decides on those only.
    """
    stats = statistics(docs.select("doc_id", "text"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stage(stats.withColumn("base_failed", base), "quality")
    rules = learn_decision_list(label_rows(stats.where("not base_failed"), labels))
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op6_quality": op6_quality}
ORACLE: dict[str, str] = {}
