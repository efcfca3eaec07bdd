"""Paths and types of JSON documents in a column of any size."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.sources.json_schema import _nested, value_type


def _walk(document: dict, parents: tuple[str, ...] = ()):
    for key, value in document.items():
        if key.startswith("_comment"):
            continue
        if _nested(value):
            yield from _walk(value, (*parents, key))
        else:
            yield ".".join((*parents, key)), value_type(value)


def _paths(batches):
    for batch in batches:
        out = []
        for order, text in zip(batch.column("place").to_pylist(), batch.column("document").to_pylist(), strict=True):
            try:
                document = json.loads(text) if text else None
            except json.JSONDecodeError:
                document = None
            if isinstance(document, dict):
                out += [(order, k, p, t) for k, (p, t) in enumerate(_walk(document))]
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
        yield pa.record_batch([pa.array([x[k] for x in out], kinds[k]) for k in range(4)], names=["place", "at", "path", "type"])


def infer_paths(documents: DataFrame, column: str, order: str) -> DataFrame:
    """Leaf paths of JSON texts: path, type (of the first document with a value), documents, first (place of that document).

    ``order`` is a long column that orders the documents. Texts that are no JSON objects count for nothing. Partial
    aggregation leaves a row per path and partition to shuffle.
    """
    rows = documents.select(F.col(order).cast("long").alias("place"), F.col(column).alias("document"))
    found = rows.mapInArrow(_paths, "place long, at int, path string, type string")
    typed = F.when(F.col("type") != "Null", F.struct("place", "at"))
    return found.groupBy("path").agg(
        F.coalesce(F.min_by("type", typed), F.lit("Null")).alias("type"), F.count(F.lit(1)).alias("documents"), F.min("place").alias("first"),
        F.min(F.struct("place", "at")).alias("rank"),
    )
