"""Coverage and contract checks: anti-joins and predicates that yield diagnostics rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import needs_repair


def difference(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of expected whose keys present lacks."""
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")


def _lists(document: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    tables = document.select(F.explode("tables").alias("t")).select("t.*")
    mapped = tables.select("source_table", "destination_collection", F.explode("field_mappings").alias("m")).select("source_table", "destination_collection", "m.*")
    return (
        tables,
        mapped.select(F.col("source_table").alias("table"), F.col("source_field").alias("name")),
        tables.select(F.col("source_table").alias("table"), F.explode("unmapped_source_fields").alias("name")),
        mapped.select(F.col("destination_collection").alias("collection"), F.col("destination_field").alias("path")),
        tables.select(F.col("destination_collection").alias("collection"), F.explode("unmapped_destination_fields").alias("path")),
    )


def check_coverage(document: DataFrame, source: DataFrame, dest: DataFrame) -> DataFrame:
    """What the document leaves out, has twice or makes up, as coverage_error rows: key and detail say which and how."""
    tables, mapped, left, targeted, spare = _lists(document)
    known_tables, known_colls = source.select("table").distinct(), dest.select("collection").distinct()
    shown = tables.select(F.col("source_table").alias("table"), F.col("destination_collection").alias("collection"))
    wanted = source.select("table", "name").join(shown, "table", "left_semi")
    paths = dest.select("collection", "path").join(shown, "collection", "left_semi")
    real = lambda df, known, key: df.join(known, key, "left_semi")
    checks = [
        (difference(shown.select("table"), known_tables, ["table"]).select(F.col("table").alias("key")), "unknown source table"),
        (difference(wanted, mapped.unionByName(left), ["table", "name"]).select(F.concat_ws(".", "table", "name").alias("key")), "column is neither mapped nor declared unmapped"),
        (real(mapped.distinct(), left, ["table", "name"]).select(F.concat_ws(".", "table", "name").alias("key")), "column is both mapped and declared unmapped"),
        (difference(real(mapped.unionByName(left).distinct(), known_tables, "table"), source, ["table", "name"]).select(F.concat_ws(".", "table", "name").alias("key")), "unknown column"),
        (difference(shown.select("collection"), known_colls, ["collection"]).select(F.col("collection").alias("key")), "unknown destination collection"),
        (difference(paths, targeted.unionByName(spare), ["collection", "path"]).select(F.concat_ws(".", "collection", "path").alias("key")), "path is neither targeted nor declared unmapped"),
        (difference(real(targeted.unionByName(spare).distinct(), known_colls, "collection"), dest, ["collection", "path"]).select(F.concat_ws(".", "collection", "path").alias("key")), "unknown path"),
        (difference(known_tables, shown, ["table"]).select(F.col("table").alias("key")), "source table is missing"),
    ]
    out = None
    for found, detail in checks:
        rows = found.select(F.lit("coverage_error").alias("kind"), "key", F.lit(detail).alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    return out


def validate_contract(document: DataFrame) -> DataFrame:
    """Values that the output contract forbids, as schema_violation rows; key is where they are."""
    tables = document.select(F.posexplode("tables").alias("i", "t"))
    fields = tables.select("i", F.posexplode("t.field_mappings").alias("j", "m"))
    at_table = F.concat(F.lit("tables/"), F.col("i").cast("string"), F.lit("/"))
    at_field = F.concat(at_table, F.lit("field_mappings/"), F.col("j").cast("string"), F.lit("/"))

    def broken(df: DataFrame, at, column: str, bad, detail: str) -> DataFrame:
        return df.filter(F.coalesce(bad, F.lit(True))).select(F.lit("schema_violation").alias("kind"), F.concat(at, F.lit(column)).alias("key"), F.lit(detail).alias("detail"))

    outside = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
    iso = F.col("generated_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    parts = [
        broken(document, F.lit(""), "generated_at", ~iso, "is no ISO 8601 time"),
        *(broken(document, F.lit(""), c, F.col(c) == "", "is empty") for c in ("mapping_version", "source", "destination")),
        *(broken(tables, at_table, c, F.col(f"t.{c}") == "", "is empty") for c in ("source_table", "destination_collection")),
        broken(tables, at_table, "confidence", outside("t.confidence"), "is not between 0 and 1"),
        broken(tables, at_table, "reasoning", needs_repair(F.col("t.reasoning")), "is not one sentence"),
        *(broken(fields, at_field, c, F.col(f"m.{c}") == "", "is empty") for c in ("source_field", "destination_field", "type_transform")),
        broken(fields, at_field, "confidence", outside("m.confidence"), "is not between 0 and 1"),
        broken(fields, at_field, "reasoning", needs_repair(F.col("m.reasoning")), "is not one sentence"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def full_validation(document: DataFrame, source: DataFrame, dest: DataFrame) -> DataFrame:
    """Contract, coverage, paths outside the schema and paths claimed twice, as DIAGNOSTICS rows."""
    mapped = document.select(F.explode("tables").alias("t")).select("t.source_table", "t.destination_collection", F.explode("t.field_mappings").alias("m"))
    pairs = mapped.select(
        F.col("source_table").alias("table"), F.col("destination_collection").alias("collection"), F.col("m.source_field").alias("name"), F.col("m.destination_field").alias("path")
    )
    outside = difference(pairs, dest, ["collection", "path"]).select(F.lit("unresolved_path").alias("kind"), F.concat_ws(".", "table", "name").alias("key"), F.col("path").alias("detail"))
    twice = pairs.groupBy("table", "path").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("detail"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = twice.select(F.lit("collision").alias("kind"), F.concat_ws(".", "table", "path").alias("key"), "detail")
    return validate_contract(document).unionByName(check_coverage(document, source, dest)).unionByName(outside).unionByName(twice)
