"""What a model adjudicator is shown: prompts as Columns, answer schemas, call keys, and guards that keep each call small."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import MAX_REASONING, approx_tokens, bson_category, sql_category
from docweave.types import DEFAULTS

ROUTE = "You pair relational tables with document collections. Choose the one collection that holds the same things as the table, by its column names."
ADJUDICATE = (
    "You map columns to document paths. For every column choose one of its candidate paths, or null if none means the same. "
    "Give a confidence from 0 to 1, one plain sentence of reason, and what the migration has to do."
)
REFLECT = "You review one mapping that is in doubt. Keep it, choose another of the candidates, or null, and say why in one sentence."
TIEBREAK = "Two columns claim one path that holds a single value. Name the column that should keep it."
REWRITE = f"Say the same in one plain sentence of at most {MAX_REASONING} characters."
SYSTEM = {"route": ROUTE, "adjudicate": ADJUDICATE, "escalate": ADJUDICATE, "path_retry": ADJUDICATE, "reflect": REFLECT, "tiebreak": TIEBREAK, "rewrite": REWRITE}

_MAPPING = {
    "source_field": {"type": "string"}, "destination_field": {"type": ["string", "null"]}, "confidence": {"type": "number", "minimum": 0, "maximum": 1},
    "reasoning": {"type": "string"}, "notes": {"type": ["string", "null"]},
}


def _object(properties: dict, *required: str) -> dict:
    return {"type": "object", "properties": properties, "required": list(required)}


#: JSON schema of the answer that each stage asks for.
ANSWER_SCHEMAS = {
    "route": _object({"destination_collection": {"type": "string"}, "confidence": _MAPPING["confidence"], "reasoning": {"type": "string"}}, "destination_collection", "confidence"),
    "adjudicate": _object({"mappings": {"type": "array", "items": _object(_MAPPING, "source_field", "destination_field", "confidence", "reasoning")}}, "mappings"),
    "reflect": _object({**{k: v for k, v in _MAPPING.items() if k != "source_field"}, "changed": {"type": "boolean"}}, "destination_field", "confidence", "reasoning"),
    "tiebreak": _object({"winner": {"type": "string"}, "reasoning": {"type": "string"}}, "winner"),
    "rewrite": _object({"reasoning": {"type": "string"}}, "reasoning"),
}


class ScopeError(ValueError):
    """A call that would show more of the schemas than it may."""


def key_role() -> Column:
    return F.when(F.col("is_pk"), "PK").when(F.col("is_fk"), "FK").when(F.col("is_unique"), "UNIQUE").otherwise("")


def derive_source(fields: DataFrame) -> DataFrame:
    """Source fields with qualified, category, key_role and describe (one terse line)."""
    bits = F.array_compact(
        F.array(
            F.col("sql_type"), F.when(key_role() != "", key_role()), F.when(F.col("references").isNotNull(), F.concat(F.lit("-> "), "references")),
            F.when(~F.col("nullable"), "NOT NULL"), F.when(F.length("comment") > 0, F.concat(F.lit("// "), "comment")),
        )
    )
    return fields.withColumns(
        {"qualified": F.concat_ws(".", "table", "name"), "category": sql_category(F.col("sql_type")), "key_role": key_role(),
         "describe": F.concat("name", F.lit(" ("), F.array_join(bits, ", "), F.lit(")"))}
    )


def derive_dest(fields: DataFrame) -> DataFrame:
    """Destination fields with qualified, leaf, parent, is_ref, category and describe."""
    bits = F.array_compact(
        F.array(
            F.col("bson_type"), F.when(F.col("references").isNotNull(), F.concat(F.lit("ref "), "references")),
            F.when(F.length("comment") > 0, F.concat(F.lit("// "), "comment")),
        )
    )
    nested = F.contains("path", F.lit("."))
    return fields.withColumns(
        {"qualified": F.concat_ws(".", "collection", "path"), "leaf": F.substring_index("path", ".", -1),
         "parent": F.when(nested, F.regexp_replace("path", r"\.[^.]*$", "")).otherwise(""), "is_ref": (F.col("bson_type") == "ObjectId") & (F.col("path") != "_id"),
         "category": bson_category(F.col("bson_type")), "describe": F.concat("path", F.lit(" ("), F.array_join(bits, ", "), F.lit(")"))}
    )


def route_prompts(source: DataFrame, dest: DataFrame) -> DataFrame:
    """A prompt per table: names only, no types. table, prompt."""
    names = source.groupBy("table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("names"))
    colls = dest.select("coll_ord", "collection").distinct().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("coll_ord", "collection"))), lambda x: x["collection"]), ", ").alias("colls"))
    text = F.concat(F.lit("Table "), "table", F.lit(" has the columns "), "names", F.lit(".\nCollections: "), "colls", F.lit("."))
    return names.crossJoin(F.broadcast(colls)).select("table", text.alias("prompt"))  # one row of collections


def batch_prompts(questions: DataFrame, dest: DataFrame, snippets: DataFrame | None = None) -> DataFrame:
    """A prompt per batch of columns with their candidates, never their scores: table, batch, prompt, columns, paths.

    snippets: table, batch, text (optional).
    """
    offered = derive_source(questions).select("table", "batch", "ord", "collection", F.col("describe").alias("column"), F.posexplode_outer("candidates").alias("at", "c"))
    shown = derive_dest(dest).select("collection", F.col("path").alias("p"), F.col("describe").alias("candidate"))
    offered = offered.join(F.broadcast(shown), (offered["collection"] == shown["collection"]) & (F.col("c.path") == F.col("p")), "left").drop(shown["collection"])
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("candidate").isNotNull(), F.struct("at", "candidate")))), lambda x: F.concat(F.lit("  - "), x["candidate"]))
    columns = offered.groupBy("table", "batch", "ord", "column").agg(F.array_join(listed, "\n").alias("list"), F.collect_set("p").alias("own"))
    line = F.concat("column", F.lit("\n"), F.when(F.col("list") != "", F.col("list")).otherwise("  (no candidates)"))
    out = columns.groupBy("table", "batch").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"),
        F.count(F.lit(1)).alias("columns"), F.array_distinct(F.flatten(F.collect_list("own"))).alias("paths"),
    )
    out = out.withColumn("prompt", F.concat(F.lit("Table "), "table", F.lit("\n"), "body"))
    if snippets is not None:
        known = snippets.groupBy("table", "batch").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("known"))
        out = out.join(known, ["table", "batch"], "left").withColumn("prompt", F.concat("prompt", F.coalesce(F.concat(F.lit("\nBackground:\n"), "known"), F.lit("")))).drop("known")
    return out.select("table", "batch", "prompt", "columns", "paths")


def call_key(*parts: str) -> Column:
    """A call's identity: a hash over a canonical form of the columns that make it, for caches and replays."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def projected_tokens(prompt: Column, stage: str, answer: int = 0) -> Column:
    """About how many tokens a call takes: a quarter of its characters, and the room for the answer."""
    return approx_tokens(F.concat(F.lit(SYSTEM[stage]), prompt)) + answer


def counterfactual_tokens(source: DataFrame, dest: DataFrame) -> int:
    """About how many tokens both schemas would take in one prompt."""
    sizes = derive_source(source).select(F.length("describe").alias("n")).unionByName(derive_dest(dest).select(F.length("describe").alias("n")))
    return (sizes.agg(F.coalesce(F.sum(F.col("n") + 1), F.lit(1))).first()[0] - 1) // 4


def read_columns(source: DataFrame, table: str, offset: int = 0, limit: int = DEFAULTS.batch, most: int = DEFAULTS.batch) -> DataFrame:
    """Some columns of a table in order of declaration; more than a batch at once is refused."""
    if limit > most:
        raise ScopeError(f"{limit} columns at once; a call may read {most}")
    found = source.filter(F.col("table") == table)
    if found.isEmpty():
        raise ScopeError(f"there is no table {table}")
    return found.orderBy("ord").offset(offset).limit(limit)


def check_scope(calls: DataFrame, most: int = DEFAULTS.batch) -> DataFrame:
    """Calls that showed more than they may: several tables at once, or more typed columns than a batch."""
    typed = F.col("detail_level") == "typed"
    return calls.filter((F.size("source_tables") > 1) | (typed & (F.size("source_fields") > most)))


def calls_by_stage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"))


def answer_schema(stage: str) -> str:
    return json.dumps(ANSWER_SCHEMAS["adjudicate" if stage in ("escalate", "path_retry") else stage], sort_keys=True)
