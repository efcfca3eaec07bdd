"""Rule, label and notes of a column and path pair as Columns over scored pairs, for mappings of any number of fields.

``p`` names a struct with sql_type, is_pk, references, comment, name, path and bson_type. The rules are those of
docweave.functions.values, which serves a plan for one table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import base_type, bson_category, code_legend, is_enum_code, lookup, source_label, sql_category, type_args
from docweave.functions.values import MANUAL_RULES, NESTED, NOTE_TERMS, OBJECT_ID_RULES


def rule(p: str) -> Column:
    f = lambda c: F.col(f"{p}.{c}")
    source, dest, code = sql_category(f("sql_type")), bson_category(f("bson_type")), is_enum_code(f("sql_type"), f("comment"))
    return (
        F.when((f("path") == "_id") & f("is_pk"), "pk_to_objectid").when(dest == "objectid", "fk_to_objectid")
        .when(code & (dest == "boolean"), "code_to_boolean").when(code & (dest == "string"), "code_to_enum_string")
        .when((source == "boolean") & (dest == "boolean"), "tinyint_to_boolean").when((source == "decimal") & (dest == "number"), "decimal_to_number")
        .when((source == "integer") & (dest == "number"), "int_to_number").when(source.isin("date", "datetime") & (dest == "datetime"), "datetime_to_isodate")
        .when(dest == "string", "string_to_string").otherwise("direct")
    )


def label(p: str, rule_: Column) -> Column:
    f = lambda c: F.col(f"{p}.{c}")
    to = lookup(rule_, {"pk_to_objectid": "ObjectId", "fk_to_objectid": "ObjectId", "code_to_enum_string": "String enum", "code_to_boolean": "Boolean"}, f("bson_type"))
    code = F.when(rule_.startswith("code_"), " code").otherwise("")
    return F.concat(source_label(f("sql_type")), code, F.lit(" -> "), to, F.when(F.contains(f("path"), F.lit(".")), NESTED).otherwise(""))


def notes(p: str, rule_: Column) -> Column:
    """The migration work that a pair implies; null for a plain copy."""
    f = lambda c: F.col(f"{p}.{c}")
    legend, lit = code_legend(f("comment")), F.lit
    args = type_args(f("sql_type"))
    typed = F.concat(base_type(f("sql_type")), F.when(F.size(args) > 0, F.concat(lit("("), F.array_join(args, ","), lit(")"))).otherwise(""))
    pairs = F.array_join(F.transform(legend, lambda x: F.concat(x["code"], lit(" -> "), F.lower(x["label"]))), ", ")
    two = F.array_join(F.transform(F.slice(legend, 1, 2), lambda x, i: F.concat(x["code"], F.when(i == 0, " -> true").otherwise(" -> false"))), ", ")
    return (
        F.when(rule_ == "pk_to_objectid", F.concat(lit("A new _id is generated; preserve "), f("name"), lit(" as a legacy key so that references can be remapped.")))
        .when(rule_ == "fk_to_objectid", F.concat(lit("Resolve by a remap table from legacy keys of "), F.coalesce(f("references"), lit("the referenced table")), lit(" once that collection is loaded.")))
        .when((rule_ == "code_to_enum_string") & (F.size(legend) > 0), F.concat(lit("Transform: "), pairs))
        .when(rule_ == "code_to_enum_string", "Needs a lookup from codes to readable strings.")
        .when((rule_ == "code_to_boolean") & (F.size(legend) > 0), F.concat(lit("Lossy: "), two, F.when(F.size(legend) > 2, "; further codes have no Boolean").otherwise(""), lit(".")))
        .when(rule_ == "code_to_boolean", "Lossy: a code of several states becomes one of two.")
        .when(rule_ == "tinyint_to_boolean", "Transform: 0 -> false, 1 -> true.")
        .when(rule_ == "decimal_to_number", F.concat(typed, lit(" is exact and Number is a double; use Decimal128 or minor units where cents matter.")))
        .when((rule_ == "datetime_to_isodate") & (sql_category(f("sql_type")) == "date"), "A bare date becomes midnight UTC; check the time zone.")
        .when(rule_ == "datetime_to_isodate", "The source has no time zone; values are taken as UTC.")
    )


def notes_are_sound(rule_: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    sound = F.lit(True)
    for name, terms in NOTE_TERMS.items():
        named = F.lit(False)
        for t in terms:
            named = named | F.contains(low, F.lit(t))
        if name in OBJECT_ID_RULES:
            named = named & ~F.contains(low, F.lit("wrap"))
        sound = F.when(rule_ == name, named).otherwise(sound)
    return sound


def needs_person(rule_: Column) -> Column:
    return rule_.isin(*MANUAL_RULES)
