import json

from docledger.streaming import ingest


def test_request_cap_and_log(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"ts": f"2026-01-01T00:00:{s:02d}", "client": c} for c, n in (("a", 4), ("b", 2)) for s in range(n)] + [{"ts": "2026-01-01T01:00:00", "client": "z"}]
    (folder / "1.json").write_text("\n".join(map(json.dumps, lines)))
    stream = ingest.log_stream(spark, str(folder), "ts timestamp, client string")
    q = ingest.write_log(ingest.over_limit(stream, 3), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [(r["client"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 4)]


def test_send_delivers_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"a": 1}\n{"a": 2}\n')
    got = []
    ingest.send(ingest.log_stream(spark, str(folder), "a int"), lambda df, _: got.extend(r["a"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(got) == [1, 2]
