"""Mixing sources to target weights: hash-random order, range buckets, distributed prefix sums, exact cuts.

Every document gets a random key by hashing its id. Keys are uniform, so ranges of equal width are even ranges: they
cut each source, a hot one too, into buckets of about as many documents as a fraction of a partition, which sort and sum
independently. Prefix sums of buckets, in blocks of BLOCK buckets and over blocks, give the sum of all earlier ones, and each
source is cut where its budget ends. Targets are worked out on a table with a row per source, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, partitions, pick_rows, scratch, session

#: Documents in a bucket, at most about: what one task sorts at once. Smaller tables have FINE buckets a partition.
BUCKET_ROWS, FINE = 1 << 18, 8
#: Buckets (a power of two) whose sums one task adds up; their blocks are added up in turn.
BLOCK_BITS = 10
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(name: str = "text"):
    return F.regexp_count(F.coalesce(F.col(name), F.lit("")), F.lit(WORD)).cast("long")


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources: mix__source and more, a row per source. Adds weight: ``weights`` by turns in code point order, null last.

    Ranges of sources are sorted on their own; the driver adds up a row per range.
    """
    count = partitions(sources.sparkSession)
    ranged = sources.repartitionByRange(count, F.col("mix__source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = scratch(ranged, "ranges")
    at, starts = 0, []
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts += [F.lit(part), F.lit(at)]
        at += n
    if not starts:
        return ranged.withColumn("weight", F.lit(weights[0])).drop("part")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("mix__source").asc_nulls_last())) - 1
    rank = F.element_at(F.create_map(*starts), F.col("part")).cast("long") + inside
    return ranged.select("*", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).alias("weight")).drop("part")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources: mix__source, source_size. Adds weight, target (double) and budget (the target, floored).

    Targets share the sum of all sizes by weight; none is above max_epochs times its source's size, and what it would have
    been above goes to the others by weight, until none is above. A share only rises as sources reach their
    limit, so each turn is one aggregate over all sources; it is kept as a fraction, and comparisons are exact.
    """
    table = scratch(weighted(sources, weights), "weighted")
    size, most = F.col("source_size").cast("decimal(38,0)"), F.lit(max_epochs).cast("decimal(10,0)")
    total = table.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
    left, by, full = total["s"] or 0, total["w"] or 1, -1
    while True:
        limited = F.col("weight") * F.lit(left).cast("decimal(20,0)") > most * size * F.lit(by).cast("decimal(14,0)")
        found = table.agg(
            F.sum(F.when(limited, F.col("source_size"))).alias("s"), F.sum(F.when(~limited, F.col("weight"))).alias("w"), F.count(F.when(limited, 1)).alias("n")
        ).first()
        if found["n"] == full:
            break
        full, left, by = found["n"], (total["s"] or 0) - max_epochs * (found["s"] or 0), found["w"] or 1
    share = F.col("weight") * F.lit(left).cast("long")
    return table.select(
        "*", F.when(limited, (F.lit(max_epochs) * F.col("source_size")).cast("double")).otherwise(share.cast("double") / float(by)).alias("target"),
        F.when(limited, F.lit(max_epochs) * F.col("source_size")).otherwise(F.floor(share.cast("decimal(38,0)") / F.lit(by).cast("decimal(14,0)")).cast("long")).cast("long").alias("budget"),
    )


def _starts(sums: DataFrame) -> DataFrame:
    """sums: mix__source, mix__bucket, sum. Returns s, b, start: the sum of a source's earlier buckets."""
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("block", F.shiftrightunsigned("mix__bucket", BLOCK_BITS))
    inner = cut.select("mix__source", "mix__bucket", "block", F.coalesce(F.sum("sum").over(before("mix__source", "block", "mix__bucket")), F.lit(0)).alias("inner"))
    blocks = cut.groupBy(F.col("mix__source").alias("s"), F.col("block").alias("k")).agg(F.sum("sum").alias("sum"))
    outer = blocks.select("s", "k", F.coalesce(F.sum("sum").over(before("s", "k")), F.lit(0)).alias("outer"))
    met = inner.join(outer, F.col("mix__source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")))
    return met.select("s", F.col("mix__bucket").alias("b"), (F.col("outer") + F.col("inner")).alias("start"))


def mix(docs: DataFrame, size, cols: list[str], seed: int = 20, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Take documents of each source, in hash-random order, until the source's target is met.

    ``size`` is a Column giving a document's size; ``cols`` are columns to keep. Returns cols and size, source_size,
    target, before (sizes ahead of the document in its source), budget (the target, floored) and taken: the whole size
    for each full epoch and, in the last epoch, what the cut leaves of it. Whole sources sum up to their budget
    exactly. Null texts have size 0 and are never taken; a very long text counts whole and may be taken in part; null
    doc_ids hash like an id of their own, with their text; repeated rows are rows like any other, in any order among themselves. An empty table
    gives an empty result.

    No row per source or document reaches the driver or is broadcast by force: targets travel with the sums of buckets.
    """
    session(docs)
    # rows without an id are told apart by their texts, so that many of them don't fill one bucket
    nameless = [F.when(F.col("doc_id").isNull(), F.col("text"))] if "text" in docs.columns else []
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), *nameless)
    rows = docs.select(*cols, F.col("source").cast("string").alias("mix__source"), size.alias("size"), key.alias("mix__key"))
    rows = scratch(rows, "sizes")
    sources = scratch(rows.groupBy("mix__source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    counted = sources.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    each = min(BUCKET_ROWS, max(1, (counted["n"] or 0) // (FINE * partitions(rows.sparkSession))))
    bits = ((counted["most"] or 0) // each).bit_length()
    # An unsigned 64-bit key's highest bits: ranges of equal width.
    bucket = F.shiftrightunsigned("mix__key", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("mix__bucket", bucket)
    goals = with_targets(sources.drop("n"), weights, max_epochs).withColumnRenamed("mix__source", "mix__of")
    starts = _starts(rows.groupBy("mix__source", "mix__bucket").agg(F.sum("size").alias("sum")))
    starts = starts.join(goals, F.col("s").eqNullSafe(F.col("mix__of"))).select("s", "b", "start", "source_size", "target", "budget")
    unsigned = F.col("mix__key").bitwiseXOR(F.lit(-(2**63)))
    inside = Window.partitionBy("mix__source", "mix__bucket").orderBy(unsigned, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("mix__source").eqNullSafe(F.col("s")) & (F.col("mix__bucket") == F.col("b")))
    before = F.col("start") + F.col("inside")
    whole = F.when(F.col("source_size") > 0, F.floor(F.expr("budget div source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - whole * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return placed.select(
        *cols, "size", "source_size", "target", "budget", before.alias("before"), (whole * F.col("size") + last).cast("long").alias("taken")
    )


def op9_mix_sources(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, size, source_size, target, taken."""
    return mix(docs, word_count(), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def take_documents(docs: DataFrame, seed: int = 20) -> DataFrame:
    """The mixed documents, same columns: each row once per epoch that takes at least half of its words.

    Null and empty texts have no words and are left out; a very long text is taken whole or not at all; repeated rows share
    what is taken of them evenly; nulls in other columns, clashing names of extra columns and an empty table are as in mix().
    """
    version = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("version")
    small = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"), version)
    mixed = mix(small, word_count(), ["doc_id", "version"], seed)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("long")
    wanted = mixed.groupBy(id_key().alias("key"), "version").agg(F.sum(times).alias("times"))
    return pick_rows(docs, wanted)
