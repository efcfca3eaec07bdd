"""Similarity of token sets, as Columns, and of strings, by the one function that Spark has no expression for."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def containment_of(shared: Column, a: Column, b: Column) -> Column:
    """Of two sets of sizes a and b that share some members: what part of the smaller one they are."""
    return F.when(F.least(a, b) > 0, shared / F.least(a, b)).otherwise(0.0)


def jaccard_of(shared: Column, a: Column, b: Column) -> Column:
    return F.when(F.least(a, b) > 0, shared / (a + b - shared)).otherwise(0.0)


def overlap_of(shared: Column, a: Column, b: Column) -> Column:
    return 0.7 * containment_of(shared, a, b) + 0.3 * jaccard_of(shared, a, b)


def _sizes(a: Column, b: Column) -> tuple[Column, Column, Column]:
    return F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))


def containment(a: Column, b: Column) -> Column:
    return containment_of(*_sizes(a, b))


def overlap(a: Column, b: Column) -> Column:
    return overlap_of(*_sizes(a, b))


def lexical(s_core: Column, s_concepts: Column, d_core: Column, d_concepts: Column) -> Column:
    """Shared words, and a share of the rest for words that only mean the same."""
    core = overlap(s_core, d_core)
    shared = lambda a, b: F.size(F.array_intersect(a, b))
    hits = shared(s_concepts, d_core) + shared(s_core, d_concepts) + 0.5 * shared(s_concepts, d_concepts)
    concept = F.least(F.lit(1.0), hits / F.greatest(F.lit(1), F.least(F.size(s_core), F.size(d_core))))
    return F.least(F.lit(1.0), core + 0.35 * concept * (1 - core))


def ratio(a: str, b: str) -> float:
    """Share of characters in matching blocks; which string comes first matters."""
    return SequenceMatcher(None, a or "", b or "").ratio()


@F.pandas_udf(T.DoubleType())
def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def with_ratio(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds ratio(a, b), computed once per distinct pair of strings."""
    found = pairs.select(F.col(a).alias("ratio__a"), F.col(b).alias("ratio__b")).distinct().withColumn(name, _ratios("ratio__a", "ratio__b"))
    return pairs.join(found, (pairs[a] == found["ratio__a"]) & (pairs[b] == found["ratio__b"])).drop("ratio__a", "ratio__b")
