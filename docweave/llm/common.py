"""Helpers that the corpus operators share: reading, scratch tables in the shared folder, skew-safe lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.session import prepare, remove, scratch, shared_dir

__all__ = ["NO_ID", "drop_scratch", "few_files", "heavy_from", "id_back", "id_key", "lookup", "packed", "partitions", "pick_rows", "scratch", "session", "shared_dir", "table", "texts", "unpacked", "whole_row"]

#: Stands for a null id in comparisons: a null id sorts after every other one.
NO_ID = 2**63 - 1
#: A key with at least one row in HEAVY_PARTS of all rows is heavy, so there are HEAVY_PARTS heavy keys at most.
HEAVY_PARTS = 1024
#: In large tables so many rows make a key heavy already, as long as no more than MOST_HEAVY keys can have them.
HEAVY_ROWS, MOST_HEAVY = 1 << 20, 1 << 17
#: Rows of a few longs that are worth a file, and a task, of their own.
FILE_ROWS = 1 << 13
#: Rows in an Arrow batch: long texts must not add up in a Python worker.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def id_back(key: str, name: str) -> Column:
    """The id for a key of id_key()."""
    return F.when(F.col(key) != NO_ID, F.col(key)).alias(name)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that are needed, so that others can't clash: doc_id long, text (null: empty), more."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more
    )


def whole_row(df: DataFrame) -> Column:
    """All columns in one struct, whatever their names."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a struct ``row`` of all other columns, whatever their names: what Python functions can pass on."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*others).alias("row"))


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, text from df (n_chars, where there is one, follows it)."""
    cols = []
    for f in docs.schema.fields:
        own = {"text": F.col("text"), "n_chars": F.length("text").cast(f.dataType)}.get(f.name, F.col("row").getField(f.name))
        cols.append(own.alias(f.name))
    return df.select(*cols)


def session(df: DataFrame) -> SparkSession:
    """The table's session, made ready for Python workers: they find this package, and batches are of BATCH_ROWS rows at most.

    A smaller setting of the caller's stays; a larger one is lowered for good, as plans read it only when they run.
    """
    spark, name = prepare(df.sparkSession), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drop_scratch(df: DataFrame) -> None:
    """Remove a scratch table that no later plan reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """A table of ``rows`` rows at most, each a few longs, whose last shuffle spreads them evenly: written in no more tasks than they are worth.

    Every file costs a local file system three processes for its permissions, which outweighs a few rows. Only the tasks after the last
    shuffle get fewer, and of more than FILE_ROWS rows a partition none."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def heavy_from(total: int) -> int:
    """Rows that make a key heavy: at most MOST_HEAVY keys (HEAVY_PARTS, up to HEAVY_PARTS * HEAVY_ROWS rows) can have so many of
    ``total`` rows."""
    return max(2, min(-(-total // HEAVY_PARTS), max(HEAVY_ROWS, -(-total // MOST_HEAVY))))


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with one row of groups per key, where groups.size counts the rows of a key.

    Heavy keys number MOST_HEAVY at most, so they are broadcast and their rows stay where they are; all other keys, each
    of HEAVY_ROWS rows or few more at most, are shuffled to a join, which holds one row a key and lets the others stream.
    """
    least = heavy_from(total)
    heavy = F.broadcast(groups.filter(F.col(size) >= least))
    light = groups.filter(F.col(size) < least)
    near = rows.join(heavy, key, "inner")
    far = rows.join(heavy.select(key), key, "left_anti").join(light, key, "left")
    return near.unionByName(far)


def pick_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents, same columns, each as often as wanted says.

    wanted: key (id_key), version (xxhash64 of the text, null as empty), times: rows to give for all rows of that key and
    version together. Repeated rows share the times evenly; null ids are one key, null and empty texts one version; columns
    of any name and texts of any length are passed on; rows without a wanted key, and an empty table, give nothing.
    """
    version = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(whole_row(docs).alias("row"), id_key().alias("row_key"), version.alias("row_version"))
    wanted = wanted.filter("times > 0").select(F.col("key").alias("k"), F.col("version").alias("v"), "times")
    met = rows.join(wanted.hint("shuffle_hash"), (F.col("row_key") == F.col("k")) & (F.col("row_version") == F.col("v"))).drop("k", "v")
    # The rows of a key and version are the same text: number them without sorting by more than the key.
    w = Window.partitionBy("row_key", "row_version")
    met = met.withColumn("copies", F.count(F.lit(1)).over(w)).withColumn("at", F.row_number().over(w.orderBy("row_key")))
    own = F.floor(F.col("times") / F.col("copies")) + F.when(F.col("at") <= F.col("times") % F.col("copies"), 1).otherwise(0)
    return met.withColumn("own", own.cast("int")).filter("own > 0").select(F.explode(F.array_repeat("row", F.col("own"))).alias("row")).select("row.*")
