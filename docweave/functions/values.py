"""Value transforms as Columns: the rule of a field pair is known when the plan is built, so each is one expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.sources.ddl import base_and_args
from docweave.types import BSON_CATEGORIES, KEEP_ARGS, SQL_CATEGORIES

#: Rules whose result needs a person's look, whatever the value.
OBJECT_ID_RULES = ("pk_to_objectid", "fk_to_objectid")
#: Rules that cap a mapping's confidence.
MANUAL_RULES = (*OBJECT_ID_RULES, "code_to_boolean")
ISO_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
NESTED = " (nested path)"

# What a note must mention, by rule.
NOTE_TERMS = {
    "pk_to_objectid": ("remap", "legacy", "generate", "generated", "retain", "preserve"),
    "fk_to_objectid": ("remap", "lookup", "mapping table", "legacy", "resolve"),
    "code_to_enum_string": ("->", "transform", "lookup", "map"),
    "code_to_boolean": ("->", "true", "false", "lossy"),
}


@dataclass(frozen=True)
class Field:
    """One side-by-side pair of a source column and a destination path, as far as a transform needs it."""

    table: str
    name: str
    sql_type: str
    is_pk: bool
    references: str | None
    comment: str | None
    path: str
    bson_type: str

    @property
    def category(self) -> str:
        base, args = base_and_args(self.sql_type)
        return "boolean" if base == "TINYINT" and args[:1] == ["1"] else SQL_CATEGORIES.get(base, "string")

    @property
    def target(self) -> str:
        return BSON_CATEGORIES.get((self.bson_type or "").strip().upper(), "unknown")

    @property
    def is_code(self) -> bool:
        base, args = base_and_args(self.sql_type)
        return base == "CHAR" and args[:1] == ["1"] and "=" in (self.comment or "")

    @property
    def legend(self) -> dict[str, str]:
        """Codes in order and their labels."""
        split = (x.partition("=") for x in re.split("[,;/]", self.comment or "") if "=" in x)
        return {code.strip(): label.strip() for code, _, label in split if len(code.strip()) == 1 and label.strip()}


def rule(f: Field) -> str:
    """The first rule that fits."""
    target = f.target
    choices = (
        ("pk_to_objectid", f.path == "_id" and f.is_pk),
        ("fk_to_objectid", target == "objectid"),
        ("code_to_boolean", f.is_code and target == "boolean"),
        ("code_to_enum_string", f.is_code and target == "string"),
        ("tinyint_to_boolean", f.category == target == "boolean"),
        ("decimal_to_number", (f.category, target) == ("decimal", "number")),
        ("int_to_number", (f.category, target) == ("integer", "number")),
        ("datetime_to_isodate", f.category in ("date", "datetime") and target == "datetime"),
        ("string_to_string", target == "string"),
    )
    return next((name for name, fits in choices if fits), "direct")


def label(f: Field) -> str:
    """The transform in words, such as CHAR(1) code -> String enum (nested path)."""
    base, args = base_and_args(f.sql_type)
    own = f"{base}({','.join(args)})" if base in KEEP_ARGS and args else base
    found = rule(f)
    to = {"pk_to_objectid": "ObjectId", "fk_to_objectid": "ObjectId", "code_to_enum_string": "String enum", "code_to_boolean": "Boolean"}.get(found, f.bson_type)
    return f"{own}{' code' if found.startswith('code_') else ''} -> {to}{NESTED if '.' in f.path else ''}"


def baseline_notes(f: Field) -> str | None:
    """The migration work that a pair implies; None for a plain copy."""
    found, legend = rule(f), f.legend
    if found == "pk_to_objectid":
        return f"A new _id is generated; preserve {f.name} as a legacy key so that references can be remapped."
    if found == "fk_to_objectid":
        return f"Resolve by a remap table from legacy keys of {f.references or 'the referenced table'} once that collection is loaded."
    if found == "code_to_enum_string":
        return "Transform: " + ", ".join(f"{c} -> {x.lower()}" for c, x in legend.items()) if legend else "Needs a lookup from codes to readable strings."
    if found == "code_to_boolean":
        pairs = [f"{c} -> {x}" for c, x in zip(legend, ("true", "false"), strict=False)]
        if not pairs:
            return "Lossy: a code of several states becomes one of two."
        return "Lossy: " + ", ".join(pairs) + ("; further codes have no Boolean" if len(legend) > 2 else "") + "."
    if found == "tinyint_to_boolean":
        return "Transform: 0 -> false, 1 -> true."
    if found == "decimal_to_number":
        base, args = base_and_args(f.sql_type)
        return f"{base}{'(' + ','.join(args) + ')' if args else ''} is exact and Number is a double; use Decimal128 or minor units where cents matter."
    if found == "datetime_to_isodate":
        return "A bare date becomes midnight UTC; check the time zone." if f.category == "date" else "The source has no time zone; values are taken as UTC."
    return None


def notes_are_sound(f: Field, notes: str | None) -> bool:
    """Whether notes name the mechanism that the rule needs; other rules take any notes."""
    found = rule(f)
    if found not in NOTE_TERMS:
        return True
    low = (notes or "").lower()
    return not (found in OBJECT_ID_RULES and "wrap" in low) and any(x in low for x in NOTE_TERMS[found])


def object_id(table: str, key: Column) -> Column:
    """A stable stand-in for a generated id; a foreign key gives the id of the row that it names."""
    return F.left(F.sha1(F.concat_ws(":", F.lit(table), key.cast("string")).cast("binary")), F.lit(24))


def to_iso(value: Column, kind: str) -> Column:
    """ISO 8601 in UTC with a Z; strings in one of three formats, others unchanged. Expects session time zone UTC."""
    if kind == "date":
        return F.concat(value.cast("string"), F.lit("T00:00:00Z"))
    if kind.startswith("timestamp"):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")), F.lit("Z"))
    text = F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")
    parsed = [F.date_format(F.try_to_timestamp(text, F.lit(x)), "yyyy-MM-dd'T'HH:mm:ss'Z'") for x in ISO_FORMATS]
    return F.coalesce(*parsed, text)


@dataclass(frozen=True)
class Converted:
    """A converted value, whether a person must look at it, and why."""

    value: Column
    manual: Column
    detail: Column


def convert(f: Field, value: Column, kind: str) -> Converted:
    """The value of source type ``kind`` (a Spark type name) under the pair's rule. Null stays null and needs no look."""
    found, legend = rule(f), f.legend
    present, nothing = value.isNotNull(), F.lit(None).cast("string")
    text = value.cast("string")
    plain = lambda x: Converted(x, F.lit(False), nothing)

    def tried(kind: str) -> tuple[Column, Column, Column]:
        """The value as a type, or null where it can't be one: then a person must look, and the table's other rows go on."""
        made = value.try_cast(kind)
        bad = present & made.isNull()
        return made, bad, F.when(bad, F.concat(F.lit("The value "), text, F.lit(f" is no {kind}; left empty.")))

    if found in OBJECT_ID_RULES:
        table = (f.references or f.table).partition(".")[0]
        made = F.when(present, F.struct(object_id(table, value).alias("$oid")))
        return Converted(made, present, F.when(present, F.concat(F.lit("The id is made by the migration; legacy key "), text, F.lit(" is kept."))))
    if found == "code_to_enum_string":
        known = text.isin(*legend) if legend else F.lit(False)
        named = text
        for code, name in legend.items():
            named = F.when(text == code, name.lower()).otherwise(named)
        odd = present & ~known
        return Converted(named, odd, F.when(odd, F.concat(F.lit("The legend has no code "), text, F.lit("."))))
    if found == "code_to_boolean":
        codes = list(legend)[:2]
        if not codes:
            return Converted(F.when(present, text != ""), present, nothing)
        odd = present & ~text.isin(*codes)
        return Converted(F.when(present, text == codes[0]), odd, F.when(odd, F.concat(F.lit("Code "), text, F.lit(" has no Boolean; taken as false."))))
    if found == "tinyint_to_boolean":
        made, *odd = tried("int")
        return Converted(made != 0, *odd)
    if found == "decimal_to_number":
        return Converted(*tried("double"))
    if found == "int_to_number":
        return Converted(*tried("long"))
    if found == "datetime_to_isodate":
        return plain(F.when(present, F.struct(to_iso(value, kind).alias("$date"))))
    return plain(value)
