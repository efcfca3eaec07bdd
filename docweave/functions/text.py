"""Text functions as Columns: all run inside the JVM."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.types import BSON_CATEGORIES, KEEP_ARGS, SQL_CATEGORIES

MAX_REASONING = 260
_HUMP = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
# Abbreviations whose stops end no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "approx.", "cf.", "ca.", "no.", "al.", "ISO 4217.")
# Answers that mean "nothing fits".
NO_MATCH = ("", "null", "none", "n/a", "no match", "-")


def literal_map(table: dict, kind: str) -> Column:
    """A small table as one map<string, kind> literal: parsed once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>")


def lookup(key: Column, table: dict, default: Column) -> Column:
    """table[key] by a literal map, else default. Values are all strings or all doubles."""
    if not table:
        return default
    kind = "string" if all(isinstance(v, str) for v in table.values()) else "double"
    return F.coalesce(F.try_element_at(literal_map(table, kind), key), default)


def split_identifier(name: Column) -> Column:
    """Lower-case words of an identifier: cut at case humps and at all but ASCII letters and digits."""
    parts = F.split(F.regexp_replace(name, _HUMP, " "), "[^A-Za-z0-9]+")
    return F.filter(F.transform(parts, F.lower), lambda x: x != "")


def base_type(sql_type: Column) -> Column:
    found = F.regexp_extract(sql_type, r"^\s*([A-Za-z_]+)", 1)
    return F.upper(F.when(found != "", found).otherwise(F.trim(sql_type)))


def type_args(sql_type: Column) -> Column:
    inner = F.regexp_extract(sql_type, r"^\s*[A-Za-z_]+\s*\(([^)]*)\)", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")


def sql_category(sql_type: Column) -> Column:
    """TINYINT(1) is a boolean, an unknown type a string."""
    flag = (base_type(sql_type) == "TINYINT") & (F.get(type_args(sql_type), F.lit(0)) == "1")
    return F.when(flag, "boolean").otherwise(lookup(base_type(sql_type), SQL_CATEGORIES, F.lit("string")))


def bson_category(bson_type: Column) -> Column:
    return lookup(F.upper(F.trim(bson_type)), BSON_CATEGORIES, F.lit("unknown"))


def is_enum_code(sql_type: Column, comment: Column) -> Column:
    """A CHAR(1) column whose comment explains its codes."""
    one = (base_type(sql_type) == "CHAR") & (F.get(type_args(sql_type), F.lit(0)) == "1")
    return F.coalesce(one & F.contains(comment, F.lit("=")), F.lit(False))


def code_legend(comment: Column) -> Column:
    """array<struct<code, label>> of "A=Active, I=Inactive", in order; the last label of a repeated code holds, at its first place."""
    parts = F.filter(F.split(F.coalesce(comment, F.lit("")), "[,;/]"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(
        parts, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("code"), F.trim(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)).alias("label"))
    )
    pairs = F.filter(pairs, lambda p: (F.length(p["code"]) == 1) & (p["label"] != ""))
    codes = F.array_distinct(F.transform(pairs, lambda p: p["code"]))
    return F.transform(codes, lambda c: F.element_at(F.filter(pairs, lambda p: p["code"] == c), -1))


def source_label(sql_type: Column) -> Column:
    """The type as a transform names it: arguments only where they matter."""
    base, args = base_type(sql_type), type_args(sql_type)
    return F.when(base.isin(*KEEP_ARGS) & (F.size(args) > 0), F.concat(base, F.lit("("), F.array_join(args, ","), F.lit(")"))).otherwise(base)


def count_sentences(text: Column) -> Column:
    """Runs of text that end with . ! or ? before white space or the end; known abbreviations and decimals don't end any."""
    for a in ABBREVIATIONS:
        text = F.replace(text, F.lit(a), F.lit(a.replace(".", "․")))
    text = F.regexp_replace(text, r"(?<=\d)\.(?=\d)", "․")
    return F.size(F.filter(F.split(text, r"[.!?]+(?:\s+|$)"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")).cast("long")


def needs_repair(text: Column) -> Column:
    """Whether a reason is not one line of one sentence of bounded length."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return (bare == "") | (count_sentences(bare) > 1) | (F.length(bare) > MAX_REASONING) | F.contains(bare, F.lit("\n"))


def first_sentence(text: Column, limit: int = MAX_REASONING) -> Column:
    """The beginning of a text as one valid sentence; a stop counts before a question or exclamation mark, wherever it is."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = clean
    for mark in ("? ", "! ", ". "):
        cut = F.when(F.instr(clean, mark) > 0, F.substring(clean, F.lit(1), F.instr(clean, mark))).otherwise(cut)
    short = F.substring(cut, 1, limit - 1)
    short = F.concat(F.when(F.contains(short, F.lit(" ")), F.regexp_replace(short, r" [^ ]*$", "")).otherwise(short), F.lit("."))
    cut = F.when(F.length(cut) > limit, short).otherwise(cut)
    cut = F.when(F.substring(cut, -1, 1).isin(".", "!", "?"), cut).otherwise(F.concat(cut, F.lit(".")))
    return F.when(clean == "", "The run recorded no reason for this mapping.").otherwise(cut)


def is_no_match(value: Column) -> Column:
    return value.isNull() | F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")).isin(*NO_MATCH)


def ascii_arrows(text: Column) -> Column:
    return F.regexp_replace(text, "→|=>", "->")


def plain_notes(notes: Column) -> Column:
    """Notes with ASCII arrows and quotes; blank ones are null."""
    clean = F.translate(F.replace(notes, F.lit("→"), F.lit("->")), "’", "'")
    return F.when(~F.lower(F.trim(clean)).isin("", "null", "none", "n/a", "-"), clean)


def band(confidence: Column, high: float = 0.90, medium: float = 0.80) -> Column:
    return F.when(confidence >= high, "high").when(confidence >= medium, "medium").otherwise("review")


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)
