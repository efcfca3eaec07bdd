import pytest
from pyspark.sql import functions as F
from schemas import HR_DDL, PEOPLE_JSON

from docweave import settings
from docweave.operators import decisions, prompts, shortlist
from docweave.sources import reader


@pytest.fixture(scope="module")
def hr(spark):
    return reader.source_fields(spark, HR_DDL).cache(), reader.dest_fields(spark, PEOPLE_JSON).cache()


def test_descriptions(hr):
    s = {r["qualified"]: r for r in prompts.derive_source(hr[0]).collect()}
    assert s["emp_master.emp_id"]["describe"] == "emp_id (INT, PK, NOT NULL)" and s["emp_master.dept_id"]["describe"] == "dept_id (INT, FK, -> dept_info.dept_id)"
    assert s["emp_master.rec_stat"]["describe"] == "rec_stat (CHAR(1), // A=Active, I=Inactive, T=Terminated)" and s["emp_master.is_remote"]["category"] == "boolean"
    d = {r["qualified"]: r for r in prompts.derive_dest(hr[1]).collect()}
    m = d["employees.employment.managerId"]
    assert (m["leaf"], m["parent"], m["is_ref"], m["category"], m["describe"]) == ("managerId", "employment", True, "objectid", "employment.managerId (ObjectId, ref employees._id)")
    assert not d["employees._id"]["is_ref"] and d["employees._id"]["parent"] == ""


def test_prompts_show_what_they_may(spark, hr):
    routing = spark.createDataFrame([("emp_master", "employees"), ("dept_info", "departments"), ("locations", "locations")], "table string, collection string")
    asked = decisions.open_decisions(hr[0], routing, shortlist.shortlist(*hr, routing))
    known = spark.createDataFrame([("emp_master", 0, "Fact two."), ("emp_master", 0, "Fact one.")], "table string, batch long, text string")
    rows = {(r["table"], r["batch"]): r for r in prompts.batch_prompts(asked, hr[1], known).collect()}
    assert len(rows) == 5 and max(r["columns"] for r in rows.values()) == 8 and max(len(r["paths"]) for r in rows.values()) < 40
    first = rows["emp_master", 0]["prompt"]
    assert "emp_id (INT, PK, NOT NULL)\n  - _id (ObjectId)" in first and "0." not in first and first.endswith("Fact one.\nFact two.") and "dept_info\n" not in first
    routes = {r["table"]: r["prompt"] for r in prompts.route_prompts(*hr).collect()}
    assert "emp_id, emp_cd" in routes["emp_master"] and "INT" not in routes["emp_master"] and "employees, departments, locations" in routes["dept_info"]


def test_guards_and_keys(spark, hr):
    assert [r["name"] for r in prompts.read_columns(hr[0], "emp_master", 2, 3).collect()] == ["f_name", "l_name", "dob"]
    for bad in (("emp_master", 0, 9), ("ghost", 0, 3)):
        with pytest.raises(prompts.ScopeError):
            prompts.read_columns(hr[0], *bad)
    calls = spark.createDataFrame([("a", ["t"], ["x"] * 9, "typed"), ("a", ["t"], ["x"] * 9, "names"), ("b", ["t", "u"], [], "names")], "stage string, source_tables array<string>, source_fields array<string>, detail_level string")
    assert prompts.check_scope(calls).count() == 2 and {(r["stage"], r["calls"]) for r in prompts.calls_by_stage(calls).collect()} == {("a", 2), ("b", 1)}
    rows = spark.createDataFrame([("m", "p", None), ("m", "p", None), ("m", "p", "x")], "model string, prompt string, tool string")
    assert rows.select(prompts.call_key("model", "prompt", "tool")).distinct().count() == 2
    assert 200 < prompts.counterfactual_tokens(*hr) < 2000
    assert spark.range(1).select(prompts.projected_tokens(F.lit("x" * 40), "rewrite", 100)).first()[0] == 100 + (40 + len(prompts.REWRITE)) // 4
    assert '"mappings"' in prompts.answer_schema("escalate")


def test_settings():
    s = settings.load({"DOCWEAVE_CASCADE": "off", "DOCWEAVE_TOP_K": "8", "DOCWEAVE_FLOOR": "0.2", "DOCWEAVE_REFLECTION": "YES"})
    assert s.chain == ("strong",) and s.limits.top_k == 8 and s.limits.floor == 0.2 and s.reflection and settings.load({}).chain == ("fast", "strong")
