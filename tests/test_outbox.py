"""Delivery through an outbox, with a transport that fails in the middle."""

import json
import os
from pathlib import Path

import pytest

from docledger.streaming import ingest
from docledger.streaming.outbox import Outbox


class Post:
    """Appends to a file per key; fails for payloads that a file lists as many times as it says."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, key, payload):
        down = Path(self.folder) / f"down-{payload}"
        if down.exists():
            n = int(down.read_text()) - 1
            down.write_text(str(n)) if n else down.unlink()
            raise OSError("down")
        with (Path(self.folder) / f"sent-{key}").open("a") as f:
            f.write(payload + "\n")


def sent(folder, key):
    at = Path(folder) / f"sent-{key}"
    return at.read_text().split() if at.exists() else []


def waiting(box, spark):
    return sorted((r["key"], r["seq"]) for r in box.waiting(spark).collect())


SCHEMA = "repo string, seq long, body string"


def test_stops_at_the_first_failure_and_goes_on_in_order(spark, tmp_path):
    box = Outbox(f"file://{tmp_path}/box", Post(tmp_path), "repo", "seq", "body")
    batch = lambda i, *rows: box(spark.createDataFrame(list(rows), SCHEMA), i)
    (tmp_path / "down-a2").write_text("9")
    batch(0, ("a", 1, "a1"), ("a", 3, "a3"), ("a", 2, "a2"), ("b", 1, "b1"))
    assert (sent(tmp_path, "a"), sent(tmp_path, "b"), waiting(box, spark)) == (["a1"], ["b1"], [("a", 2), ("a", 3)])
    batch(1, ("a", 4, "a4"), ("b", 2, "b2"))
    assert (sent(tmp_path, "a"), sent(tmp_path, "b"), waiting(box, spark)) == (["a1"], ["b1", "b2"], [("a", 2), ("a", 3), ("a", 4)])
    (tmp_path / "down-a2").unlink()
    (tmp_path / "down-a4").write_text("1")
    batch(2, ("b", 3, "b3"))
    assert (sent(tmp_path, "a"), waiting(box, spark)) == (["a1", "a2", "a3"], [("a", 4)])
    batch(3, ("a", 5, "a5"))
    assert (sent(tmp_path, "a"), waiting(box, spark)) == (["a1", "a2", "a3", "a4", "a5"], [])


def test_new_records_have_several_attempts_and_queued_ones_one(spark, tmp_path):
    box = Outbox(f"file://{tmp_path}/box", Post(tmp_path), "repo", "seq", "body", attempts=2)
    (tmp_path / "down-x").write_text("1")
    (tmp_path / "down-y").write_text("3")
    box(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], SCHEMA), 0)
    assert (sent(tmp_path, "a"), waiting(box, spark)) == (["x"], [("a", 2)])
    box(spark.createDataFrame([("a", 3, "z")], SCHEMA), 1)
    assert (sent(tmp_path, "a"), waiting(box, spark)) == (["x"], [("a", 2), ("a", 3)])


def test_a_batch_that_runs_again_starts_from_the_same_queue(spark, tmp_path):
    box = Outbox(f"file://{tmp_path}/box", Post(tmp_path), "repo", "seq", "body")
    (tmp_path / "down-x").write_text("99")
    box(spark.createDataFrame([("a", 1, "x")], SCHEMA), 0)
    box(spark.createDataFrame([("a", 2, "y")], SCHEMA), 1)
    box(spark.createDataFrame([("a", 2, "y")], SCHEMA), 1)
    assert waiting(box, spark) == [("a", 1), ("a", 2)]
    with pytest.raises(Exception, match="key of a record is null"):
        box(spark.createDataFrame([(None, 3, "z")], SCHEMA), 2)


def test_stream_with_an_outage(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    box = Outbox(f"file://{tmp_path}/box", Post(tmp_path), "repo", "seq", "body")
    run = lambda: ingest.send(ingest.log_stream(spark, str(folder), SCHEMA, files_per_batch=1), box, str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "down-2").write_text("99")
    for i in (1, 2, 3):
        (folder / f"{i}.json").write_text(json.dumps({"repo": "a", "seq": i, "body": str(i)}))
        os.utime(folder / f"{i}.json", (i, i))
    run()
    assert (sent(tmp_path, "a"), waiting(box, spark)) == (["1"], [("a", 2), ("a", 3)])
    (tmp_path / "down-2").unlink()
    (folder / "4.json").write_text(json.dumps({"repo": "a", "seq": 4, "body": "4"}))
    run()
    assert (sent(tmp_path, "a"), waiting(box, spark)) == (["1", "2", "3", "4"], [])
