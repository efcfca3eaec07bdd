import datetime as dt

import pytest
from pyspark.sql import functions as F

from docweave.functions import mapping, text, tokens
from docweave.functions.similarity import ratio
from docweave.functions.values import Field, baseline_notes, convert, label, notes_are_sound, rule
from docweave.operators import migrate, shortlist
from docweave.operators.extract_json import extract
from docweave.sources.knowledge import default_pack


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


@pytest.mark.parametrize(("name", "want"), [("fullName.firstName", ["full", "name", "first", "name"]), ("_id", ["id"]), ("HTTPServerID2x", ["http", "server", "id2x"]), ("", [])])
def test_split_identifier(spark, name, want):
    assert one(spark, text.split_identifier(F.col("x")), x=name) == want


@pytest.mark.parametrize(
    ("words", "n"),
    [("One.", 1), ("One, e.g. this.", 1), ("One. Two!", 2), ("It is 0.95 sure.", 1), ("No stop", 1), ("A? B", 2), ("", 0), ("ISO 4217. codes", 1)],
)
def test_count_sentences(spark, words, n):
    assert one(spark, text.count_sentences(F.col("x")), x=words) == n


@pytest.mark.parametrize(
    ("words", "want"),
    [("  One  two. Three", "One two."), ("A! B. C", "A! B."), ("No stop", "No stop."), ("x " * 200, ("x " * 129)[:-1] + "."), ("Why? So", "Why?")],
)
def test_first_sentence(spark, words, want):
    found = one(spark, text.first_sentence(F.col("x")), x=words)
    assert found == want and len(found) <= 260


def test_no_match_and_notes(spark):
    rows = spark.createDataFrame([(x,) for x in ("", " NULL ", "n/a", "-", None, "No Match", "path")], "x string")
    assert [r[0] for r in rows.select(text.is_no_match(F.col("x"))).collect()] == [True] * 6 + [False]
    assert one(spark, text.plain_notes(F.col("x")), x="a → b’s") == "a -> b's" and one(spark, text.plain_notes(F.col("x")), x=" None ") is None
    assert one(spark, text.ascii_arrows(F.col("x")), x="INT => X → Y") == "INT -> X -> Y"


def test_ratio_is_not_symmetric():
    assert ratio("deptstat", "isactive") == 0.125 and ratio("isactive", "deptstat") == 0.375 and ratio("", "") == 1.0


def test_tokens(spark):
    pack = default_pack()
    assert one(spark, tokens.core_tokens(F.col("x"), pack), x="dept_stat") == ["active", "department", "state", "status"]
    assert one(spark, tokens.core_tokens(F.col("x"), pack), x="isActive") == ["active"]
    core = tokens.core_tokens(F.col("x"), pack)
    assert "department" in one(spark, tokens.concept_tokens(core, pack), x="team") and "team" not in one(spark, tokens.concept_tokens(core, pack), x="team")


def pair(sql_type="INT", path="a.b", bson="Number", **more):
    return Field("t", "c", sql_type, more.get("pk", False), more.get("ref"), more.get("comment"), path, bson)


LEGEND = "A=Active, I=Inactive, T=Terminated"
PAIRS = [
    (pair(path="_id", bson="ObjectId", pk=True), "pk_to_objectid", "INT -> ObjectId"),
    (pair(path="a.bId", bson="ObjectId", ref="d.id"), "fk_to_objectid", "INT -> ObjectId (nested path)"),
    (pair("VARCHAR(9)", "x", "ObjectId"), "fk_to_objectid", "VARCHAR -> ObjectId"),
    (pair("CHAR(1)", "s", "String", comment=LEGEND), "code_to_enum_string", "CHAR(1) code -> String enum"),
    (pair("CHAR(1)", "s", "Boolean", comment="A=Active, I=Inactive"), "code_to_boolean", "CHAR(1) code -> Boolean"),
    (pair("TINYINT(1)", "f", "Boolean"), "tinyint_to_boolean", "TINYINT(1) -> Boolean"),
    (pair("DECIMAL(12, 2)", "m.x"), "decimal_to_number", "DECIMAL(12,2) -> Number (nested path)"),
    (pair("BIGINT", "n"), "int_to_number", "BIGINT -> Number"),
    (pair("DATE", "d", "ISODate"), "datetime_to_isodate", "DATE -> ISODate"),
    (pair("VARCHAR(5)", "s", "String"), "string_to_string", "VARCHAR -> String"),
    (pair("JSON", "o", "Object"), "direct", "JSON -> Object"),
]


@pytest.mark.parametrize(("f", "want", "named"), PAIRS)
def test_rule_in_python_and_in_a_plan(spark, f, want, named):
    assert rule(f) == want and label(f) == named
    row = spark.createDataFrame([(f.sql_type, f.is_pk, f.references, f.comment, f.name, f.path, f.bson_type)], "sql_type string, is_pk boolean, references string, comment string, name string, path string, bson_type string")
    p = row.select(F.struct("*").alias("p"))
    found = mapping.rule("p")
    assert p.select(found, mapping.label("p", found), mapping.notes("p", found)).first()[:] == (want, named, baseline_notes(f))
    for notes in (None, "wrap the value", "remap via a lookup -> true", "x"):
        assert p.select(mapping.notes_are_sound(found, F.lit(notes).cast("string"))).first()[0] == notes_are_sound(f, notes)
    assert notes_are_sound(f, baseline_notes(f))


def value(spark, f, v, kind="string"):
    row = spark.createDataFrame([(v,)], f"v {kind}")
    made = convert(f, F.col("v"), row.schema["v"].dataType.typeName())
    r = row.select(made.value.alias("v"), made.manual.alias("m")).first()
    return (r["v"].asDict() if hasattr(r["v"], "asDict") else r["v"]), r["m"]


def test_values(spark):
    status, flag = PAIRS[3][0], PAIRS[4][0]
    assert value(spark, status, "A") == ("active", False) and value(spark, status, "Z") == ("Z", True) and value(spark, status, None) == (None, False)
    assert value(spark, flag, "A") == (True, False) and value(spark, flag, "I") == (False, False) and value(spark, flag, "Z") == (False, True)
    assert value(spark, PAIRS[5][0], 1, "int") == (True, False) and value(spark, PAIRS[6][0], "125000.50") == (125000.5, False)
    assert value(spark, pair("DATETIME", "d", "ISODate"), "2019-04-01 09:00:00") == ({"$date": "2019-04-01T09:00:00Z"}, False)
    assert value(spark, PAIRS[8][0], "1990-07-14") == ({"$date": "1990-07-14T00:00:00Z"}, False) and value(spark, PAIRS[8][0], "soon") == ({"$date": "soon"}, False)
    assert value(spark, PAIRS[8][0], dt.date(1990, 7, 14), "date") == ({"$date": "1990-07-14T00:00:00Z"}, False)
    assert value(spark, PAIRS[8][0], dt.datetime(1990, 7, 14, 1, 2, 3, 50), "timestamp_ntz") == ({"$date": "1990-07-14T01:02:03.000050Z"}, False)
    made, manual = value(spark, PAIRS[0][0], 7, "int")
    assert len(made["$oid"]) == 24 and manual and made == value(spark, PAIRS[0][0], 7, "long")[0]
    # a foreign key's id is the id of the row that it names
    d = Field("d", "id", "INT", True, None, None, "_id", "ObjectId")
    assert value(spark, PAIRS[1][0], 7, "int")[0] == value(spark, d, 7, "int")[0]


def test_malformed_values_never_end_a_migration(spark):
    """A value that is no number is left empty and marked; the other rows of the table go on."""
    pairs = [
        Field("t", "n", "INT", False, None, None, "n", "Number"), Field("t", "d", "DECIMAL(9,2)", False, None, None, "d", "Number"),
        Field("t", "b", "TINYINT(1)", False, None, None, "b", "Boolean"),
    ]
    rows = spark.createDataFrame([(1, "12", "1.5", "1"), (2, "x", "1,5", "yes"), (3, None, None, None), (4, "99999999999999999999", "1e3", "0")], "k int, n string, d string, b string")
    made = {f.name: convert(f, F.col(f.name), "string") for f in pairs}
    got = {r["k"]: r for r in rows.select("k", *(c.value.alias(n) for n, c in made.items()), *(c.manual.alias(f"{n}_manual") for n, c in made.items()), *(c.detail.alias(f"{n}_detail") for n, c in made.items())).collect()}
    assert [tuple(got[k][c] for c in "ndb") for k in (1, 2, 3, 4)] == [(12, 1.5, True), (None, None, None), (None, None, None), (None, 1000.0, False)]
    assert [tuple(got[k][f"{c}_manual"] for c in "ndb") for k in (1, 2, 3, 4)] == [(False,) * 3, (True,) * 3, (False,) * 3, (True, False, False)]
    assert got[2]["d_detail"] == "The value 1,5 is no double; left empty." and got[1]["n_detail"] is None
    done = migrate.migrate(rows, pairs, ["k"])
    assert done.count() == 4 and done.select("document").filter("document is null").isEmpty()


def test_migrate(spark):
    df = spark.createDataFrame([(1, "A", "x"), (2, None, "y")], "id int, st string, extra string")
    pairs = [Field("t", "id", "INT", True, None, None, "_id", "ObjectId"), Field("t", "st", "CHAR(1)", False, None, LEGEND, "job.status", "String"), Field("t", "gone", "INT", False, None, None, "x", "Number")]
    done = migrate.migrate(df, pairs, ["id"])
    rows = {r["id"]: r for r in done.collect()}
    assert rows[1]["document"]["job"]["status"] == "active" and rows[2]["document"]["job"]["status"] is None
    assert [a["path"] for a in rows[1]["annotations"]] == ["_id", "job.status"]
    assert done.select(migrate.manual_count()).first()[0] == 1 and migrate.flatten(done).columns == ["_id.$oid", "job.status"]
    assert migrate.preview(df, pairs).first()["manual_count"] == 1
    with pytest.raises(ValueError, match="mapped"):
        migrate.migrate(df, [])


def test_margin(spark):
    m = lambda s, r: spark.range(1).select(shortlist.margin(F.lit(s).cast("double"), F.lit(r).cast("double"))).first()[0]
    assert m(None, 0.3) == 0.0 and m(0.9, None) == 1.0 and m(0.6, 0.1) == pytest.approx(0.8) and m(0.2, 0.6) == 0.0


@pytest.mark.parametrize(
    ("said", "want"),
    [('{"a": 1}', {"a": 1}), ("text ```json\n{\"a\": 2}\n``` more", {"a": 2}), ('so {"a": "}{", "b": {"c": 3}} end}', {"a": "}{", "b": {"c": 3}}), ("[1]", None), ("{broken", None), ("", None), (None, None)],
)
def test_extract_json(said, want):
    assert extract(said) == want
