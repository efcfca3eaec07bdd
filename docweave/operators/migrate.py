"""Whole-table migration: a mapping becomes one projection, without a shuffle or a Python function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.values import Field, convert, rule


def _nest(tree: dict) -> Column:
    return F.struct(*((_nest(v) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()))


def _place(tree: dict, path: str, value: Column) -> None:
    *parents, leaf = path.split(".")
    for p in parents:
        tree = tree.setdefault(p, {})
        if not isinstance(tree, dict):
            raise ValueError(f"{path}: {p} is a value and an object at once")
    tree[leaf] = value


def migrate(df: DataFrame, pairs: list[Field], keep: list[str] | None = None) -> DataFrame:
    """Every row as ``document`` (nested struct) and ``annotations``, an array of path, rule, manual and detail.

    Pairs whose column the table lacks are left out; of two pairs for one path the later holds. ``keep`` are columns to
    carry along.
    """
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    tree: dict = {}
    notes: dict[str, Column] = {}
    for f in pairs:
        if f.name not in kinds:
            continue
        made = convert(f, F.col(f"`{f.name}`"), kinds[f.name])
        _place(tree, f.path, made.value)
        notes[f.path] = F.struct(F.lit(f.path).alias("path"), F.lit(rule(f)).alias("rule"), made.manual.alias("manual"), made.detail.alias("detail"))
    if not tree:
        raise ValueError("no column of the table is mapped")
    kept = [F.col(f"`{c}`") for c in keep or ()]
    return df.select(*kept, _nest(tree).alias("document"), F.array(*notes.values()).alias("annotations"))


def manual_count(annotations: str = "annotations") -> Column:
    return F.size(F.filter(annotations, lambda x: x["manual"])).cast("long")


def flatten(df: DataFrame, column: str = "document") -> DataFrame:
    """A nested document back to one column per leaf, named by its dot path."""

    def walk(schema, at: str, name: str):
        for f in schema.fields:
            path, full = f"{at}.`{f.name}`", f"{name}{f.name}"
            if hasattr(f.dataType, "fields"):
                yield from walk(f.dataType, path, f"{full}.")
            else:
                yield F.col(path).alias(full)

    return df.select(*walk(df.schema[column].dataType, column, ""))


def preview(df: DataFrame, pairs: list[Field], rows: int = 1) -> DataFrame:
    """Documents of a few rows, with the number of values that a person must look at."""
    return migrate(df.limit(rows), pairs).withColumn("manual_count", manual_count())


def denormalize(df: DataFrame, fk: str, parent: DataFrame, parent_key: str, copies: dict[str, str]) -> DataFrame:
    """Extension: adds copies of the referenced row's columns (source column -> new column) by a join on the key."""
    cols = [F.col(parent_key).alias("ref__key"), *(F.col(a).alias(b) for a, b in copies.items())]
    return df.join(parent.select(*cols), F.col(fk) == F.col("ref__key"), "left").drop("ref__key")
