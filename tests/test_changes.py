"""Changes of one key give what one after the other gives."""

from docledger.operators import documents, edits, store

DOC = "doc_id string, path string, audience string, owner string, team string, dri string, refs array<struct<path:string,symbols:array<string>>>, context array<string>"


def edit(seq, doc, action, path=None, audience=None, refs=None, context=None, owner=None, team=None, dri=None):
    return (seq, doc, action, path, audience, refs, context, owner, team, dri)


def folded(spark, docs, *staged):
    out = edits.applied(spark.createDataFrame(docs, DOC), spark.createDataFrame(list(staged), edits.EDIT))
    return {r["doc_id"]: r for r in out.collect()}


ONE = [("d", "d.md", "eng-guide", "a", None, None, [("p", [])], ["c"])]


def test_two_owner_edits_keep_what_is_not_set(spark):
    got = folded(spark, ONE, edit(1, "d", "reassign_owner", owner="b"), edit(2, "d", "reassign_owner", team="t"))["d"]
    assert (got["owner"], got["team"], got["problem"]) == ("b", "t", None)


def test_references_are_added_once_and_removed_in_turn(spark):
    add, remove = (lambda s, p, *of: edit(s, "d", "add_code_ref", refs=[(p, list(of))])), (lambda s, p: edit(s, "d", "remove_code_ref", p))
    got = folded(spark, ONE, add(1, "q"), add(2, "q"), add(3, "q", "S"), remove(4, "p"), add(5, "p"))["d"]
    assert [(r["path"], r["symbols"]) for r in got["refs"]] == [("q", []), ("q", ["S"]), ("p", [])]
    got = folded(spark, ONE, remove(1, "p"), remove(2, "p"), add(3, "z"))["d"]
    assert (got["refs"], got["failed_seq"], got["problem"]) == ([], 2, "no code_ref with path p to remove")


def test_documents_are_created_replaced_and_must_be_known(spark):
    got = folded(spark, ONE, edit(1, "n", "create_doc", "n.md", "user-guide", refs=[("x", [])]), edit(2, "n", "reassign_owner", dri="z"), edit(3, "d", "create_doc", "e.md", "eng-guide"), edit(4, "u", "reassign_owner", owner="o"), edit(5, None, "create_doc"))
    assert (got["n"]["path"], got["n"]["dri"], got["n"]["known"]) == ("n.md", "z", True)
    assert (got["d"]["path"], got["d"]["owner"], got["d"]["refs"], got["d"]["context"]) == ("e.md", None, [], [])
    assert (got["u"]["known"], got["u"]["problem"]) == (False, "unknown document") and None not in got


def test_context_is_replaced_and_names_no_path_twice(spark):
    got = folded(spark, ONE, edit(1, "d", "set_context_refs", context=["x", "y"]), edit(2, "d", "set_context_refs", context=["x", "x"]))["d"]
    assert (got["context"], got["problem"], got["failed_seq"]) == (["x", "y"], "duplicate context_refs", 2)
    assert folded(spark, ONE, edit(1, "d", "rename"))["d"]["problem"] == "unknown action rename"
    assert folded(spark, [], *[edit(1, "d", "create_doc", "d.md")])["d"]["path"] == "d.md"


def test_owner_edits(spark):
    docs = spark.createDataFrame([("d", "a", ["r"]), ("e", "a", [])], "doc_id string, owner string, refs array<string>")
    staged = spark.createDataFrame([(1, "d", "b", ["x"]), (2, "d", None, ["y"]), (3, "d", None, None)], "seq long, doc_id string, owner string, add_refs array<string>")
    assert sorted(map(tuple, edits.edited_owners(docs, staged).collect())) == [("d", "b", ["r", "x", "y"]), ("e", "a", [])]


def test_a_token_that_is_left_out_stays(spark):
    table = spark.createDataFrame([(1, "r", "n", "old")], "seq long, repo_id string, name string, token_hash string")
    new = spark.createDataFrame([(5, "r", "m", "secret"), (6, "r", "l", None), (7, "s", "k", None)], "seq long, repo_id string, name string, auth_token string")
    got = {r["repo_id"]: tuple(r) for r in store.register(table, new).select("repo_id", "seq", "name", "token_hash").collect()}
    assert got == {"r": ("r", 1, "l", "2bb80d537b1da3e38bd30361aa855686bde0eacd7162fef6a25fe97bf527a25b"), "s": ("s", 7, "k", None)}


def test_roster(spark):
    roster = spark.createDataFrame([(1, "a", "person", True, None), (2, "b", "person", True, None)], "ord long, name string, kind string, active boolean, departed_at string")
    changes = [(1, "a", "team", None), (2, "a", None, "day"), (3, "new", "person", None), (4, "new", None, "day"), (5, "who", None, "day"), (6, "back", None, "day"), (7, "back", "team", None), (8, "b", None, "day"), (9, "b", "team", None)]
    got = edits.roster_after(roster, spark.createDataFrame(changes, "seq long, name string, kind string, departed_at string"))
    assert sorted(map(tuple, got.select("name", "kind", "active", "departed_at").collect())) == [("a", "team", False, "day"), ("b", "team", True, None), ("back", "team", True, None), ("new", "person", False, "day")]


def test_first_style_counts(spark):
    docs = spark.createDataFrame([("d",), ("e",)], "doc_id string")
    own = spark.createDataFrame([(2, "d", "b", "b", "b", "b"), (1, "d", "a", None, "a", "a")], "ord int, doc_id string, document_type string, tone string, writing_style string, vocabulary string")
    got = documents.styles(docs, own, dict.fromkeys(documents.STYLE, "z"))
    assert sorted(map(tuple, got.collect())) == [("d", "a", None, "a", "a"), ("e", "z", "z", "z", "z")]
