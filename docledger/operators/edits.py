"""Changes of one key applied in the order in which they were made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A reference of a document to code, and a staged edit. Columns that an action does not use are null.
REF = "struct<path:string,symbols:array<string>>"
EDIT = f"seq long, doc_id string, action string, path string, audience string, refs array<{REF}>, context array<string>, owner string, team string, dri string"
#: Actions of staged edits (fixed values).
ACTIONS = ("create_doc", "add_code_ref", "remove_code_ref", "set_context_refs", "reassign_owner")

_STATE = f"struct<known:boolean,path:string,audience:string,owner:string,team:string,dri:string,refs:array<{REF}>,context:array<string>,problem:string,failed_seq:bigint>"
_FIELDS = ("path", "audience", "owner", "team", "dri", "refs", "context")


def _step(s: Column, e: Column) -> Column:
    """State of a document after one more edit; after a problem nothing changes any more."""
    action, path, first = e["action"], e["path"], F.get(e["refs"], 0)
    none = F.array().cast(f"array<{REF}>")
    is_ = {a: action == a for a in ACTIONS}
    kept = F.filter(s["refs"], lambda r: ~r["path"].eqNullSafe(path))
    problem = (
        F.when(~action.isin(*ACTIONS), F.concat(F.lit("unknown action "), action))
        .when(~is_["create_doc"] & ~s["known"], F.lit("unknown document"))
        .when(is_["add_code_ref"] & first.isNull(), F.lit("no code_ref to add"))
        .when(is_["remove_code_ref"] & (F.size(kept) == F.size(s["refs"])), F.concat(F.lit("no code_ref with path "), F.coalesce(path, F.lit("null")), F.lit(" to remove")))
        .when((is_["set_context_refs"] | is_["create_doc"]) & (F.size(F.array_distinct(e["context"])) < F.size(e["context"])), F.lit("duplicate context_refs"))
    )
    refs = (
        F.when(is_["create_doc"], F.coalesce(e["refs"], none))
        .when(is_["remove_code_ref"], kept)
        .when(is_["add_code_ref"] & ~F.exists(s["refs"], lambda r: r.eqNullSafe(first)), F.concat(s["refs"], F.array(first)))
        .otherwise(s["refs"])
    )
    whole = lambda f: F.when(is_["create_doc"], e[f]).otherwise(s[f])
    own = lambda f: F.when(is_["create_doc"], F.lit(None)).when(is_["reassign_owner"], F.coalesce(e[f], s[f])).otherwise(s[f])
    context = F.when(is_["create_doc"] | is_["set_context_refs"], F.coalesce(e["context"], F.array().cast("array<string>"))).otherwise(s["context"])
    new = F.struct(F.lit(True).alias("known"), whole("path").alias("path"), whole("audience").alias("audience"), *[own(f).alias(f) for f in ("owner", "team", "dri")], refs.alias("refs"), context.alias("context"), F.lit(None).cast("string").alias("problem"), F.lit(None).cast("long").alias("failed_seq"))
    stopped = F.struct(*[s[f].alias(f) for f in ("known", *_FIELDS)], problem.alias("problem"), e["seq"].alias("failed_seq"))
    return F.when(s["problem"].isNotNull(), s).when(problem.isNotNull(), stopped.cast(_STATE)).otherwise(new.cast(_STATE))


def applied(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents after their staged edits (EDIT), each document's in order of seq.

    docs: doc_id, path, audience, owner, team, dri, refs (array of REF), context (array of paths). create_doc adds a document or
    replaces all of it; add_code_ref appends a reference unless it is there already, so applying edits twice changes
    nothing; remove_code_ref drops every reference with a path; set_context_refs replaces; reassign_owner sets what
    is not null. An edit that cannot be applied (unknown document or action, a reference that is not there, a path given twice)
    stops its document: problem and failed_seq name it, and the state is the one before.

    A document's edits are sorted into one array and folded, so this holds the edits of a document at once: they are those
    staged since the last run. Documents without edits are not shuffled into arrays. Edits without doc_id are left out.
    """
    payload = [c.split()[0] for c in ("action _", "path _", "audience _", "context _", "owner _", "team _", "dri _")]
    one = F.struct("seq", *[F.col(c) for c in payload], "refs")
    staged = edits.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("edits"))
    rows = docs.withColumn("known", F.lit(True)).join(staged, "doc_id", "full")
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    start = F.struct(
        F.coalesce("known", F.lit(False)).alias("known"), *[F.col(f) for f in ("path", "audience", "owner", "team", "dri")],
        empty("refs", f"array<{REF}>").alias("refs"), empty("context", "array<string>").alias("context"), F.lit(None).cast("string").alias("problem"), F.lit(None).cast("long").alias("failed_seq"),
    ).cast(_STATE)
    folded = F.when(F.col("edits").isNull(), start).otherwise(F.aggregate("edits", start, _step))
    return rows.select("doc_id", folded.alias("s")).select("doc_id", "s.*")


def edited_owners(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Owner and references (doc_id, owner, refs: paths) after edits (seq, doc_id, owner, add_refs), one after the other.

    A null owner keeps the one before, references are added once. Both follow from the last owner that is set and the
    union of all references, which combine before the shuffle: no document's edits are gathered.
    """
    last = edits.groupBy("doc_id").agg(F.max_by("owner", F.when(F.col("owner").isNotNull(), F.col("seq"))).alias("new_owner"))
    added = edits.select("doc_id", F.explode("add_refs").alias("ref")).groupBy("doc_id").agg(F.collect_set("ref").alias("more"))
    refs = F.array_sort(F.array_union("refs", F.coalesce("more", F.array().cast("array<string>"))))
    return docs.join(last, "doc_id", "left").join(added, "doc_id", "left").select("doc_id", F.coalesce("new_owner", "owner").alias("owner"), refs.alias("refs"))


def roster_after(roster: DataFrame, changes: DataFrame, behind: int = 10**12) -> DataFrame:
    """Roster (ord, name, kind, active, departed_at) after changes (seq, name, kind, departed_at), one after the other.

    A change without departed_at adds the name, behind all others (ord: behind plus its first seq), or replaces
    its kind and makes it active. A departure of a name that is known by then makes it inactive and keeps its kind;
    of an unknown one it changes nothing. So what holds is the last update, and the last departure if it came later.
    """
    update, at = F.col("departed_at").isNull(), F.col("seq")
    what = changes.groupBy("name").agg(
        F.max(F.when(update, at)).alias("updated"), F.min(F.when(update, at)).alias("added"), F.max_by("kind", F.when(update, at)).alias("new_kind"),
        F.max(F.when(~update, at)).alias("left"), F.max_by("departed_at", F.when(~update, at)).alias("gone"),
    )
    both = roster.join(what, "name", "full").where(F.col("ord").isNotNull() | F.col("added").isNotNull())
    new, gone = F.col("updated").isNotNull(), F.col("left").isNotNull() & (F.col("updated").isNull() | (F.col("left") > F.col("updated")))
    return both.select(
        F.coalesce("ord", F.lit(behind) + F.col("added")).alias("ord"), "name", F.when(new, F.col("new_kind")).otherwise(F.col("kind")).alias("kind"),
        F.when(gone, F.lit(False)).when(new, F.lit(True)).otherwise(F.col("active")).alias("active"),
        F.when(gone, F.col("gone")).when(~new, F.col("departed_at")).alias("departed_at"),
    )
