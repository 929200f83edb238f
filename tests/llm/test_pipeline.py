"""The pipeline's stages on a small table with clashing columns, held against brute force."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from docledger.llm.common import stage
from tests.llm.test_small import DOCS, brute_components, brute_overlaps, sample

CLASHES = ("row", "row_key", "doc_key", "size", "weight", "tie", "skey", "es_key", "key", "held_out", "language", "copies", "root", "a.b")


def test_stages(spark, tmp_path):
    # with one language every letter is certain; which of several is too doubtful to keep has a test of its own
    rows = [(i, t, "en", *rest) for i, t, _, *rest in (*sample(40), (500, "12 34 !!", "en", "s1", 8))]
    item = " ".join(rows[3][1].split()[:20])
    for name, schema, values in (("documents", DOCS, rows), ("benchmark", "item_id long, text string", [(1, item)]), ("labels", "doc_id long, quality int, toxic int", [(1, 1, 0)])):
        df = spark.createDataFrame(values, schema)
        if name == "documents":
            df = df.withColumns({c: F.lit("x") for c in CLASHES})
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        assert docs.where(" or ".join(f"`{c}` <> 'x'" for c in CLASHES)).count() == 0
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(seen[0]) - set(seen[1]) == {i for i, t in seen[0].items() if not any(c.isalpha() for c in t or "")}
    assert set(seen[2]) == {i for i, (_, c) in brute_components(list(seen[1].items()), 5, 80, 100).items() if i == c}
    assert set(seen[2]) - set(seen[3]) == {d for d, _ in brute_overlaps(list(seen[2].items()), [(1, item)])}
    assert set(seen[4]) <= set(seen[3])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in docs.collect())


def test_whole_run(spark):
    folder = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "shard", "slot"} <= set(out.columns)
    known = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{folder}/documents.parquet'").fetchall()}
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert ids and ids <= known
