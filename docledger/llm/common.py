"""Shared helpers of the training-data operators: text conventions, staged tables and checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Spark's own setting that removes shuffle files of a query as soon as it has ended.
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's own settings for the most rows of an Arrow batch and of a batch that the Parquet reader decodes.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")

#: Most rows that a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as a long, without keeping the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters untouched."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is set only where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="docledger-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stage(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    batch_rows bounds the rows that are decoded and that reach Python at once while it is written, for long texts and large arrays.

    A written table survives the loss of any executor and is read with column pruning and
    filter pushdown, which an RDD checkpoint is not. Once it is written, nothing needs the
    shuffle files behind it, so their disk is given back at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    own = {RELEASE_SHUFFLES: "true"} | (dict.fromkeys(BATCH_ROWS, str(batch_rows)) if batch_rows else {})
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Remove staged tables that nothing reads any more, to give their disk back."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs as one struct column row next to some of its columns, so that helper columns clash with none of its names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of numbers as a table of SQL literals, which takes no Python on the executors; many as any local data."""
    if not rows or len(rows) > 1000:
        return spark.createDataFrame(rows, schema)
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    text = ", ".join("(" + ", ".join(f"CAST('{v}' AS {t})" for v, t in zip(r, types, strict=True)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(names)})")


def few(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, whose number of rows is known, marked for broadcast if they are most at most."""
    return F.broadcast(df) if rows <= most else df


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a side that is expected to be small: broadcast only where a count proves it small.

    Beyond rows it is an ordinary shuffled join, whose skewed partitions adaptive
    execution splits. small should be staged, since it is counted first.
    """
    if small.limit(rows + 1).count() <= rows:
        small = F.broadcast(small)
    return big.join(small, on, how)
