"""How well retrieval and pair verdicts do against known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(truth: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """truth: table, name, path; candidates: with rank and total. One row: pairs, recall_at_k, rank_at_1, mean_rank, min_true_score."""
    found = truth.join(candidates.select("table", "name", "path", "rank", "total"), ["table", "name", "path"], "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return found.agg(
        F.count(F.lit(1)).alias("pairs"), share(F.col("rank") <= k).alias("recall_at_k"), share(F.col("rank") == 1).alias("rank_at_1"),
        F.avg("rank").alias("mean_rank"), F.min("total").alias("min_true_score"),
    )


def separation(scored: DataFrame, truth_column: str = "is_true", score: str = "score") -> DataFrame:
    """Least and greatest score of true and of other pairs, and how many pairs lie on the wrong side of the midpoint."""
    side = {"true": F.col(truth_column), "other": ~F.col(truth_column)}
    ends = scored.agg(*(f(F.when(is_, F.col(score))).alias(f"{name}_{end}") for name, is_ in side.items() for end, f in (("min", F.min), ("max", F.max))))
    cut = (F.col("true_min") + F.col("other_max")) / 2
    wrong = scored.select(truth_column, score).crossJoin(ends).agg(F.count_if(F.col(truth_column) != (F.col(score) >= cut)).alias("misplaced"))  # one row of ends
    return ends.crossJoin(wrong)
