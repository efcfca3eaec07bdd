"""Whether two schemas belong together, by vocabulary alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.shortlist import _packed, compare, dest_tokens, source_tokens
from docweave.sources.knowledge import Knowledge, default_pack

# Weights of the affinity, where a column counts as placed, and the verdicts' boundaries.
WEIGHTS = {"lexical": 0.45, "fuzzy": 0.25, "comment": 0.30}
PLACED, ALIGNED, UNRELATED, TABLE_ALIGNED = 0.30, 0.45, 0.38, 0.45


def field_affinities(source: DataFrame, dest: DataFrame, pack: Knowledge | None = None) -> DataFrame:
    """Best affinity of every column in every collection: table, table_ord, name, collection, coll_ord, affinity.

    All columns meet all paths, which is the question asked: both sides are schemas, a row per column or path, not data. Spark
    broadcasts one by its size.
    """
    pack = pack or default_pack()
    s, d = _packed(source_tokens(source, pack), "s"), _packed(dest_tokens(dest, pack), "d")
    pairs = compare(s.crossJoin(d))
    affinity = F.least(F.lit(1.0), sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0)))
    keys = [F.col(c).alias(c.partition(".")[2]) for c in ("s.table", "s.table_ord", "s.name", "d.collection", "d.coll_ord")]
    return pairs.groupBy(*keys).agg(F.max(affinity).alias("affinity"))


def table_pairings(affinities: DataFrame) -> DataFrame:
    """Per table the collection that places most columns, then the highest mean, then the earlier: one row per table."""
    means = affinities.groupBy("table", "table_ord", "collection", "coll_ord").agg(
        F.avg("affinity").alias("affinity"), F.count_if(F.col("affinity") >= PLACED).alias("placed_fields"), F.count(F.lit(1)).alias("fields")
    )
    order = F.struct("placed_fields", "affinity", (-F.col("coll_ord")).alias("early"))
    best = means.groupBy("table", "table_ord").agg(F.max_by(F.struct("collection", "affinity", "fields", "placed_fields"), order).alias("best"))
    return best.select("table", "table_ord", "best.*")


def assess(pairings: DataFrame) -> DataFrame:
    """One row: score (weighted by columns), verdict, placed_fields, total_fields, forced tables, headline."""
    total = pairings.agg(
        (F.sum(F.col("affinity") * F.col("fields")) / F.sum("fields")).alias("score"), F.sum("placed_fields").alias("placed_fields"),
        F.sum("fields").alias("total_fields"), F.count_if(F.col("affinity") < TABLE_ALIGNED).alias("forced"), F.count(F.lit(1)).alias("tables"),
    ).withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.when((F.col("score") >= ALIGNED) & (F.col("forced") == 0), "aligned").when(F.col("score") >= UNRELATED, "weak").otherwise("unrelated")
    headline = F.when(F.col("verdict") == "aligned", "The schemas look like two halves of one pair.").when(
        F.col("verdict") == "weak", "The schemas overlap only in part."
    ).otherwise("The schemas look unrelated.")
    return total.withColumn("verdict", verdict).withColumn("headline", headline)


def assess_pair(source: DataFrame, dest: DataFrame, pack: Knowledge | None = None) -> tuple[DataFrame, DataFrame]:
    """The assessment (one row) and the pairings (a row per table)."""
    pairings = table_pairings(field_affinities(source, dest, pack))
    return assess(pairings), pairings
