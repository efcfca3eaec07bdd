import json

import pytest
from schemas import HR_DDL, PEOPLE, PEOPLE_JSON, SHOP_JSON, TRUTH

from docweave.sources import inference, reader
from docweave.sources.ddl import base_and_args, parse_ddl
from docweave.sources.json_schema import parse_collections, parse_documents, parse_tables, value_type
from docweave.types import SchemaError


def paths(payload):
    return {c: [x.path for x in xs] for c, xs in parse_collections(payload)[2].items()}


def test_ddl(spark):
    rows = {(r["table"], r["name"]): r for r in reader.source_fields(spark, HR_DDL).collect()}
    assert len(rows) == 34 and {r["database"] for r in rows.values()} == {"old_hr"}
    e = rows["emp_master", "emp_id"]
    assert e["is_pk"] and not e["nullable"] and not e["is_fk"]
    assert rows["emp_master", "office_loc_id"]["references"] == "locations.loc_id" and rows["emp_master", "office_loc_id"]["is_fk"]
    assert rows["dept_info", "parent_dept_id"]["references"] == "dept_info.dept_id"
    assert rows["dept_info", "dept_id"]["is_pk"] and rows["dept_info", "dept_cd"]["is_unique"]
    assert rows["emp_master", "sal_currency"]["comment"] == "ISO 4217, e.g. USD" and rows["emp_master", "base_sal"]["sql_type"] == "DECIMAL(12,2)"
    assert [r["name"] for r in sorted(rows.values(), key=lambda r: (r["table_ord"], r["ord"]))][:3] == ["emp_id", "emp_cd", "f_name"]


def test_ddl_odds():
    _, tables = parse_ddl("create table s.`t` (a int(11) unsigned not null default 1 comment 'it''s, (odd) -- text', b enum('x,y','z'), primary key (a, b), key k (b))")
    a, b = tables["t"]
    assert (a.sql_type, a.comment, a.is_pk, a.nullable) == ("int(11)", "it's, (odd) -- text", True, False) and b.is_pk and b.base_type == "ENUM"
    assert parse_ddl("create table s.t (a int)")[0] == "s"
    with pytest.raises(SchemaError):
        parse_ddl("create view v as select 1")


@pytest.mark.parametrize(("text", "want"), [("DECIMAL(12, 2)", ("DECIMAL", ["12", "2"])), ("int", ("INT", [])), ("", ("", [])), ("2x", ("2X", []))])
def test_base_and_args(text, want):
    assert base_and_args(text) == want


def test_three_table_shapes_agree():
    shapes = [
        {"columns": [{"name": "id", "type": "INT", "key": "PK"}, {"name": "o", "type": "INT", "references": "t.id"}]},
        [{"name": "id", "type": "INT", "primary_key": True}, {"name": "o", "type": "INT", "key": "FK", "references": "t.id"}],
        {"id": "INT PRIMARY KEY", "o": "INT FK -> t.id", "_comment": "x"},
    ]
    found = [parse_tables({"tables": {"t": s}})[2]["t"] for s in shapes]
    assert found[0] == found[1] == found[2]
    for bad in ({"tables": {}}, {"tables": {"t": []}}, {"tables": {"t": 3}}, {"tables": {"t": [{"type": "INT"}]}}):
        with pytest.raises(SchemaError):
            parse_tables(bad)


def test_ddl_and_json_have_one_fingerprint(spark):
    ddl = "create table acct (acct_id INT primary key, cust_nm VARCHAR(80) comment 'customer name', mrr_amt DECIMAL(10,2), mgr_id INT references users(id))"
    assert reader.source_fingerprint(reader.source_fields(spark, ddl)) == reader.source_fingerprint(reader.source_fields(spark, SHOP_JSON))


def test_terse_destination():
    assert paths({"collections": {"books": {"author": {"name": "String"}}}}) == {"books": ["author.name"]}
    assert paths({"collections": {"b": {"payment": {"type": "String", "amount": "Number"}}}}) == {"b": ["payment.type", "payment.amount"]}
    assert paths({"collections": {"b": {"isbn": {"name": "isbn", "type": "String"}}}}) == {"b": ["isbn"]}
    found = parse_collections(PEOPLE)[2]
    assert sum(map(len, found.values())) == 40
    manager = next(x for x in parse_collections({"collections": {"e": {"m": "ObjectId -- ref -> employees._id"}}})[2]["e"])
    assert (manager.bson_type, manager.references) == ("ObjectId", "employees._id")
    for bad in ({"collections": {}}, {"collections": {"e": {}}}, {"collections": {"e": [{"type": "String"}]}}):
        with pytest.raises(SchemaError):
            parse_collections(bad)


def test_no_leaf_is_above_another():
    for xs in paths(PEOPLE).values():
        assert not any(b.startswith(f"{a}.") for a in xs for b in xs)


def test_documents():
    docs = [{"_id": {"$oid": "a"}, "n": None, "s": {"x": 1}}, {"n": {"$numberDecimal": "1"}, "s": {"y": True}, "l": [1], "d": {"$date": "x"}, "_comment": 1}]
    found = {x.path: x.bson_type for x in parse_documents({"collections": {"c": docs}})[2]["c"]}
    assert found == {"_id": "ObjectId", "n": "Decimal128", "s.x": "Number", "s.y": "Boolean", "l": "Array", "d": "ISODate"}
    with pytest.raises(SchemaError, match="n"):
        parse_documents({"collections": {"c": [{"n": None}]}})
    assert [value_type(x) for x in (True, 1, 1.5, "", None, [], {"$numberLong": "1"}, {"$odd": 1})] == "Boolean Number Number String Null Array Number Object".split()


def test_detect_format():
    assert reader.detect_format("x", "A.SQL") == "mysql_ddl" and reader.detect_format(" create table t (a int)") == "mysql_ddl"
    assert reader.detect_format(SHOP_JSON) == "mysql_json" and reader.detect_format(PEOPLE_JSON) == "mongo_json"
    assert reader.detect_format('{"collections": {"_c": 1, "a": [{}]}}') == "mongo_documents"
    for bad in ("prose", "{", '{"a": 1}'):
        with pytest.raises(SchemaError):
            reader.detect_format(bad)


def test_wrong_side_and_size(spark):
    with pytest.raises(SchemaError):
        reader.source_fields(spark, PEOPLE_JSON)
    with pytest.raises(SchemaError):
        reader.dest_fields(spark, SHOP_JSON)
    with pytest.raises(SchemaError, match="limit"):
        reader.source_fields(spark, " " * 200_001)


def test_files(spark, tmp_path):
    (tmp_path / "hr.sql").write_text(HR_DDL)
    (tmp_path / "people.json").write_text(PEOPLE_JSON)
    (tmp_path / "rows.json").write_text(json.dumps({"emp": [{"a": 1}, {"a": None}], "dept": [{"b": "x"}]}))
    assert reader.read_source(spark, str(tmp_path / "hr.sql")).count() == sum(map(len, TRUTH.values())) + 1
    assert reader.read_dest(spark, str(tmp_path / "people.json")).count() == 40
    assert {(r["name"], r["side"]) for r in reader.catalogue(spark, str(tmp_path)).collect()} == {("hr.sql", "destination"), ("people.json", "destination"), ("rows.json", "destination")}
    assert [r["a"] for r in reader.sample_rows(spark, str(tmp_path / "rows.json"), "emp").collect()] == [1, None]
    (tmp_path / "out").mkdir()
    assert reader.latest_mapping(spark, str(tmp_path / "none"), str(tmp_path / "out")) is None
    (tmp_path / "out" / "mapping_a_to_b.json").write_text("{}")
    assert reader.latest_mapping(spark, str(tmp_path / "none"), str(tmp_path / "out")).endswith("mapping_a_to_b.json")


def test_inference_at_scale(spark):
    rows = [(3, '{"a": 1, "b": {"c": null}}'), (1, '{"a": null, "b": {"c": "x"}, "d": {"$oid": "1"}}'), (2, '{"a": "s"}'), (4, "junk"), (5, None), (6, "[1]")]
    found = {r["path"]: (r["type"], r["documents"], r["first"]) for r in inference.infer_paths(spark.createDataFrame(rows, "o long, j string"), "j", "o").collect()}
    assert found == {"a": ("String", 3, 1), "b.c": ("String", 2, 1), "d": ("ObjectId", 1, 1)}
