"""Mutations of entity tables as pure plans, and their Parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, key: str, keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Table after rows by key, one after the other by seq: each replaces the one before, and a row keeps its first seq.

    Columns in keep_if_null take the last value that is set, so one that is set and then left out stays. Both are
    aggregates, so a key with many rows is combined before the shuffle.
    """
    rest = [c for c in table.columns if c not in (key, "seq")]
    set_last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"set_{c}") for c in keep_if_null]
    new = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("n"), F.min("seq").alias("new_seq"), *set_last)
    old = table.select(key, "seq", F.struct(*rest).alias("o"))
    both = old.join(new, key, "full")
    pick = [F.coalesce(f"set_{c}", f"o.{c}").alias(c) if c in keep_if_null else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest]
    return both.select(F.coalesce("seq", "new_seq").alias("seq"), key, *pick)


def register(table: DataFrame, registrations: DataFrame, key: str = "repo_id") -> DataFrame:
    """Table (seq, key, token_hash and more) after registrations (the same with auth_token), one after the other.

    Of a token only its hash is kept. A registration with a token rotates the hash, one without leaves it.
    """
    hashed = registrations.withColumn("token_hash", F.sha2("auth_token", 256)).drop("auth_token")
    return upsert(table, hashed, key, keep_if_null=("token_hash",))


def replace_scope(table: DataFrame, rows: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """The rows of every scope that rows has take the place of those in table; other scopes stay."""
    return table.join(rows.select(*scope).distinct(), list(scope), "left_anti").select(*table.columns).unionByName(rows)


def write_scope(rows: DataFrame, path: str, scope: tuple[str, ...]) -> None:
    """replace_scope on a partitioned Parquet table: only the partitions of rows are overwritten, at once."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append to a log of JSON lines; lines are never rewritten."""
    rows.write.mode("append").json(path)


def changed_only(rows: DataFrame, existing: DataFrame, key: str, content: str) -> DataFrame:
    """Rows whose content differs from what exists: the ones worth writing."""
    same = existing.select(key, F.xxhash64(content).alias("h"), F.col(content).alias("_old"))
    return rows.withColumn("h", F.xxhash64(content)).join(same, [key, "h"], "left_anti").drop("h")


def mark_edits(edits: DataFrame, ids: DataFrame, status: str, at: str) -> DataFrame:
    """Set the status of pending edits whose id is chosen; no ids change nothing."""
    chosen = ids.select("edit_id").distinct().withColumn("chosen", F.lit(True))
    rows = edits.join(chosen, "edit_id", "left")
    hit = F.coalesce("chosen", F.lit(False)) & (F.col("status") == "pending")
    return rows.withColumn("applied_at", F.when(hit, F.lit(at)).otherwise(F.col("applied_at"))).withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status"))).drop("chosen")
