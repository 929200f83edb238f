"""Sharding by a k-d tree of distributed weighted medians. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_staged, few, stage, table, values

#: Bins into which an interval of positions is cut at each refinement of a median.
BINS = 4096
#: Rows of a node's median interval below which it is sorted instead of refined again.
SORT_ROWS = 50_000
#: A cut moves to the edge of a group of equal texts if no more than this share of its node's bytes moves.
SNAP = 0.001
#: Bits of a position: a dimension's code above, the text's hash below.
CODE_BITS, HASH_BITS = 19, 43
#: Bits of a tie: a hash of doc_id above, one of the row below.
DOC_BITS, ROW_BITS = 38, 24
#: Hash ranges of a shard in which slots are numbered independently.
SLOT_BUCKETS = 512


def text_dimensions(text: Column) -> dict[str, Column]:
    """Metadata dimensions that follow from the text alone, so that equal texts share a point.

    Size on a log scale, bytes a character (script) and characters a word, each a non-negative
    integer below 2**19. Null counts as an empty text.
    """
    t = F.coalesce(text, F.lit(""))
    size, chars = F.octet_length(t).cast("double"), F.char_length(t).cast("double")
    spaces = chars - F.char_length(F.translate(t, " \n\t\r\x0b\x0c", "")).cast("double")
    top = F.lit(2**CODE_BITS - 1)
    return {
        "dim_size": F.least(F.floor(F.log2(size + 1) * 4096), top).cast("long"),
        "dim_script": F.least(F.floor(size / F.greatest(chars, F.lit(1.0)) * 65536), top).cast("long"),
        "dim_word": F.least(F.floor(chars / (spaces + 1) * 256), top).cast("long"),
    }


def _state(spark: SparkSession, open_: dict[int, dict]) -> DataFrame:
    rows = [(n, s["col"] == "tie", s["lo"], s["hi"], s["base"], s["goal"], s["atom"]) for n, s in open_.items()]
    return values(spark, rows, "node long, on_tie boolean, lo long, hi long, base long, goal double, atom long")


def _medians(rows: DataFrame, nodes: dict[int, dict]) -> dict[int, tuple[int, int]]:
    """For each node (id -> goal: bytes of its left part) the cut (pos, tie).

    Intervals of positions are histogrammed by size and narrowed to the bin that holds the goal,
    all nodes in one job. A narrow one is sorted; if its rows all share a position, because they
    are copies of a text, ties are narrowed the same way. What reaches the driver is one bin a node.
    """
    spark = rows.sparkSession
    cuts: dict[int, tuple[int, int]] = {}
    open_ = {n: {"goal": x["goal"], "tol": SNAP * x["total"], "col": "pos", "lo": 0, "hi": 2 ** (CODE_BITS + HASH_BITS) - 1, "base": 0, "atom": 0, "abase": 0} for n, x in nodes.items()}
    while open_:
        state = _state(spark, open_)
        inside = rows.join(few(state, len(open_)), "node").withColumn("key", F.when(F.col("on_tie"), F.col("tie")).otherwise(F.col("pos")))
        inside = inside.where(~F.col("on_tie") | (F.col("pos") == F.col("atom"))).where(F.col("key").between(F.col("lo"), F.col("hi")))
        width = F.expr(f"(hi - lo) div {BINS} + 1")
        bins = inside.withColumn("bin", F.expr(f"(key - lo) div ((hi - lo) div {BINS} + 1)")).groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.first("base").alias("base"), F.first("goal").alias("goal"))
        run = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        hit = bins.withColumn("upto", F.col("base") + F.sum("bytes").over(run)).where(F.col("upto") >= F.col("goal"))
        hit = hit.groupBy("node").agg(F.min(F.struct("bin", "upto", "bytes", "n")).alias("h"))
        found = {r["node"]: r["h"] for r in hit.collect()}
        sort = []
        for n, s in list(open_.items()):
            h = found[n]
            step = (s["hi"] - s["lo"]) // BINS + 1
            s["lo"] += h["bin"] * step
            s["hi"] = min(s["hi"], s["lo"] + step - 1)
            s["base"] = h["upto"] - h["bytes"]
            if s["col"] == "pos" and s["lo"] == s["hi"]:
                if s["goal"] - s["base"] <= s["tol"]:
                    cuts[n] = (s["lo"], 0)
                elif h["upto"] - s["goal"] <= s["tol"]:
                    cuts[n] = (s["lo"] + 1, 0)
                else:
                    s |= {"col": "tie", "atom": s["lo"], "lo": 0, "hi": 2**62, "abase": s["base"]}
                    if h["n"] <= SORT_ROWS:
                        sort.append(n)
                if n in cuts:
                    del open_[n]
            elif h["n"] <= SORT_ROWS or s["lo"] == s["hi"]:
                sort.append(n)
        if sort:
            state = _state(spark, {n: open_[n] for n in sort})
            inside = rows.join(few(state, len(sort)), "node").where(F.when(F.col("on_tie"), (F.col("pos") == F.col("atom")) & F.col("tie").between(F.col("lo"), F.col("hi"))).otherwise(F.col("pos").between(F.col("lo"), F.col("hi"))))
            order = Window.partitionBy("node").orderBy("pos", "tie")
            group = Window.partitionBy("node", "pos")
            runs = inside.withColumn("upto", F.col("base") + F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, 0))).withColumn("below", F.col("upto") - F.sum("size").over(Window.partitionBy("node", "pos", "tie")))
            runs = runs.withColumn("from", F.min("below").over(group)).withColumn("to", F.max("upto").over(group))
            at = runs.where(F.col("upto") >= F.col("goal")).groupBy("node").agg(F.min(F.struct("pos", "tie", "from", "to", "below", "upto")).alias("h"))
            for r in at.collect():
                n, h, s = r["node"], r["h"], open_.pop(r["node"])
                if s["col"] == "pos" and s["goal"] - h["from"] <= s["tol"]:
                    cuts[n] = (h["pos"], 0)
                elif s["col"] == "pos" and h["to"] - s["goal"] <= s["tol"]:
                    cuts[n] = (h["pos"] + 1, 0)
                else:
                    cuts[n] = (h["pos"], h["tie"] + (h["upto"] - s["goal"] <= s["goal"] - h["below"]))
    return cuts


def kd_shards(docs: DataFrame, dims: Mapping[str, Column], n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Shards of near equal bytes: the leaves of a k-d tree over metadata dimensions.

    docs has doc_id, size and text_hash (long) next to what dims reads; dims are non-negative
    integers below 2**19. The tree has n_shards leaves, or as many as target_bytes asks for. A
    node of k leaves is cut along its widest dimension (the largest weighted standard deviation
    relative to the whole table's) at the weighted quantile of its bytes that k // 2 leaves take.
    Ties of a dimension go by the text's hash, and those by the document's, so a cut misses
    its goal by one document at most, or by SNAP of its node where that keeps equal texts together.

    Per level the table is read for spreads and for the narrowing histograms; one row per node
    reaches the driver. The number of nodes is that of the shards.

    Null doc_id hashes as any value; rows that repeat doc_id and text differ by their number only,
    so a cut may go between them. Texts are not read here, however long. An
    empty table gives an empty one. Returns the columns of docs (none of them tie, node, shard
    or a name of dims) and shard, int from 0.
    """
    spark = docs.sparkSession
    names = list(dims)
    # a hash of doc_id above, of the row's number below: repeated rows can be cut apart, and whichever goes is the same
    row = F.xxhash64(F.monotonically_increasing_id())
    tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - DOC_BITS), ROW_BITS).bitwiseOR(F.shiftrightunsigned(row, 64 - ROW_BITS))
    rows = stage(docs.withColumns({**dims, "tie": tie, "node": F.lit(1).cast("long")}), "kd-0")
    total = rows.agg(F.sum("size").alias("bytes"), *[F.stddev_pop(n).alias(n) for n in names]).first()
    if not total["bytes"]:
        return rows.drop(*names, "tie", "node").withColumn("shard", F.lit(0))
    leaves = n_shards or max(1, -(-total["bytes"] // target_bytes))
    first = {1: (0, leaves)}  # node -> its first leaf, its number of leaves
    level = 0
    while any(k > 1 for _, k in first.values()):
        w = F.col("size").cast("double")
        inner = [(n,) for n, (_, k) in first.items() if k > 1]
        stats = rows if len(inner) == len(first) else rows.join(few(values(spark, inner, "node long"), len(inner)), "node", "left_semi")
        stats = stats.groupBy("node").agg(F.sum("size").alias("bytes"), *[F.sum(w * F.col(n)).alias(f"{n}_1") for n in names], *[F.sum(w * F.col(n) * F.col(n)).alias(f"{n}_2") for n in names]).collect()
        plan, goals = {}, {}
        for r in stats:
            spread = {n: max(0.0, r[f"{n}_2"] / r["bytes"] - (r[f"{n}_1"] / r["bytes"]) ** 2) ** 0.5 / (total[n] or 1.0) for n in names}
            plan[r["node"]] = max(names, key=lambda n: (round(spread[n], 9), -names.index(n)))
            k = first[r["node"]][1]
            goals[r["node"]] = {"goal": r["bytes"] * (k // 2) / k, "total": r["bytes"]}
        dim = few(values(spark, [(n, names.index(d)) for n, d in plan.items()], "node long, dim int"), len(plan))
        code = F.array(*[F.col(n) for n in names])[F.col("dim")]
        placed = rows.join(dim, "node", "left").withColumn("pos", F.shiftleft(code, HASH_BITS).bitwiseOR(F.shiftrightunsigned(F.col("text_hash"), 64 - HASH_BITS)))
        cuts = _medians(placed.where("dim is not null").select("node", "pos", "tie", "size"), goals)
        cut = few(values(spark, [(n, p, t) for n, (p, t) in cuts.items()], "node long, cut_pos long, cut_tie long"), len(cuts))
        left = (F.col("pos") < F.col("cut_pos")) | ((F.col("pos") == F.col("cut_pos")) & (F.col("tie") < F.col("cut_tie")))
        node = F.when(F.col("cut_pos").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 0).otherwise(1))
        level += 1
        old, rows = rows, stage(placed.join(cut, "node", "left").withColumn("node", node).drop("dim", "pos", "cut_pos", "cut_tie"), f"kd-{level}")
        drop_staged(old)
        nodes = {}
        for n, (at, k) in first.items():
            if n in plan:
                nodes |= {2 * n: (at, k // 2), 2 * n + 1: (at + k // 2, k - k // 2)}
            else:
                nodes[n] = (at, 1)
        first = nodes
    shard = few(values(spark, [(n, at) for n, (at, _) in first.items()], "node long, shard int"), len(first))
    return rows.join(shard, "node").drop(*names, "tie", "node")


def with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Rows fall into SLOT_BUCKETS hash ranges a shard; each range is numbered alone and starts
    where the counts of those before it end, so no task sorts a whole shard, nor all rows that
    repeat one. The staged input keeps both passes alike.
    """
    rows = stage(rows.withColumn("slot_bucket", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SLOT_BUCKETS)).cast("int")), "shards")
    counts = rows.groupBy("shard", "slot_bucket").count()
    run = Window.partitionBy("shard").orderBy("slot_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slot_bucket", F.coalesce(F.sum("count").over(run), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "slot_bucket").orderBy("doc_id", "text_hash", "size")
    numbered = rows.withColumn("place", F.row_number().over(order))
    return numbered.join(starts, ["shard", "slot_bucket"]).withColumn("slot", F.col("start") + F.col("place") - 1).drop("slot_bucket", "start", "place")


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Shard and slot of documents (doc_id, text): law `bytes`.

    Size is the text's UTF-8 bytes plus 1; null counts as an empty text, whose crc32 is 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    dims = text_dimensions(F.col("text"))
    size = (F.octet_length(text) + 1).cast("long")
    narrow = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), *[c.alias(n) for n, c in dims.items()])
    out = with_slots(kd_shards(narrow, {n: F.col(n) for n in dims}, n_shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_sharding": op8_sharding}
ORACLE: dict[str, str] = {}
