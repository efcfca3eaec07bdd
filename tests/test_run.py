import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from schemas import HR_DDL, PEOPLE_JSON, SHOP_JSON, TRUTH, ZOO_JSON

from docweave import api
from docweave.__main__ import main
from docweave.operators import assemble, coverage, evaluation, ledger, pairing, routing, shortlist, snippets
from docweave.operators.adjudicate import Call, Deterministic, Replay, Scripted, batches, match_answers
from docweave.plans.run import map_schemas
from docweave.sinks import writers
from docweave.sources import calls, knowledge, reader
from docweave.streaming.progress import Progress, last_by_key_stream, parse_sse, read_events, read_last, sse
from docweave.types import ANSWERS, DEFAULTS, MAPPING_DOCUMENT


@pytest.fixture(scope="module")
def hr(spark):
    return reader.source_fields(spark, HR_DDL).cache(), reader.dest_fields(spark, PEOPLE_JSON).cache()


@pytest.fixture(scope="module")
def shop(spark):
    return reader.source_fields(spark, SHOP_JSON).cache(), reader.dest_fields(spark, ZOO_JSON).cache()


@pytest.fixture(scope="module")
def routed(spark):
    return spark.createDataFrame([("emp_master", "employees"), ("dept_info", "departments"), ("locations", "locations")], "table string, collection string")


@pytest.fixture(scope="module")
def done(hr):
    return map_schemas(*hr, generated_at="2024-01-01T00:00:00Z")


def truth(spark):
    return spark.createDataFrame([(t, n, p) for t, m in TRUTH.items() for n, p in m.items()], "table string, name string, path string")


def test_retrieval_gate(spark, hr, routed):
    found = shortlist.shortlist(*hr, routed).cache()
    r = evaluation.recall(truth(spark), found, 6).first()
    assert r["pairs"] == 33 and r["recall_at_k"] == 1.0 and r["rank_at_1"] >= 0.85
    golden = found.filter("name = 'dept_stat' and path = 'isActive'").first()
    assert [golden[c] for c in ("lexical", "fuzzy", "type_compat", "key_role", "comment", "total")] == pytest.approx([0.85375, 0.125, 0.65, 0.4, 0.6, 0.621425])
    assert found.groupBy("table", "name").count().agg(F.max("count")).first()[0] == 6 and found.agg(F.min("total")).first()[0] >= 0.15
    ranked = shortlist.with_margin(found, ["table", "name"], "total")
    assert ranked.filter("margin < 0 or margin > 1").isEmpty()


def test_embeddings_mix_in(spark, hr, routed):
    near = spark.createDataFrame([("emp_master", "dob", "meta.createdAt", 1.0)], "table string, name string, path string, similarity double")
    plain, mixed = (shortlist.score_pairs(*hr, routed, embeddings=e).filter("name = 'dob' and path = 'meta.createdAt'").first()["total"] for e in (None, near))
    assert mixed == pytest.approx(plain * 0.85 + 0.15)


def test_pairs_that_belong_together(spark, hr, shop):
    own, crossed = pairing.assess_pair(*hr)[0].first(), pairing.assess_pair(hr[0], shop[1])[0].first()
    assert own["verdict"] == "aligned" and crossed["verdict"] != "aligned" and own["score"] > crossed["score"]
    best = {r["table"]: r["collection"] for r in pairing.assess_pair(*hr)[1].collect()}
    assert best == {"emp_master": "employees", "dept_info": "departments", "locations": "locations"}


def test_deterministic_run(spark, done, hr):
    assert done.ok and done.routing.pairs["dept_info"] == "departments"
    got = assemble.mapped_fields(done.document).select(F.col("source_table").alias("table"), F.col("source_field").alias("name"), F.col("destination_field").alias("path"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in truth(spark).collect()}
    c = done.report()["coverage"].first()
    assert (c["source_total"], c["source_mapped"], c["paths_total"], c["paths_targeted"], c["accounted"]) == (34, 33, 40, 33, 34)
    assert {r["path"] for r in done.report()["unmapped_destination"].collect()} == {"department.code", "department.name", "location.code", "location.name", "location.city", "location.country", "location.timezone"}
    assert [(r["table"], r["name"]) for r in done.report()["unmapped_source"].collect()] == [("emp_master", "dob")]
    q = done.report()["quality"].first()
    assert q["high"] + q["medium"] + q["review"] == 33 and 0.8 < q["mean_confidence"] <= 1
    doc = json.loads(writers.mapping_text(done.document))
    assert list(doc) == [f.split()[0] for f in MAPPING_DOCUMENT.split(", ")[:5]] and "notes" in doc["tables"][0]["field_mappings"][2]
    assert writers.mapping_name(done.document) == "mapping_old_hr_to_people.json"
    assert [e["type"] for e in done.progress.events][0] == "run_start" and done.progress.events[-1]["type"] == "run_end"
    assert done.progress.frame(spark).filter("type = 'mapping'").count() == 33


def test_display_orders(done, hr):
    shown = [(r["table"], r["name"], r["path"]) for r in assemble.mapped_first(hr[0], done.document).collect()]
    assert shown[0] == ("emp_master", "emp_id", "_id") and shown[18] == ("emp_master", "dob", None) and len(shown) == 34
    paths = [r["path"] for r in assemble.paths_following(hr[1], hr[0], done.document).filter("collection = 'employees'").collect()]
    assert paths[:2] == ["_id", "employeeCode"] and paths[-7:] == ["department.code", "department.name", "location.code", "location.name", "location.city", "location.country", "location.timezone"]


def test_whole_table_migration(spark, done):
    rows = spark.createDataFrame([(1, "E1", "A", 1, 7, "2020-01-02 03:04:05"), (2, "E2", "Q", 0, None, None)], "emp_id int, emp_cd string, rec_stat string, is_remote int, dept_id int, hire_dt string")
    out = {r["emp_id"]: r for r in api.migrate_table(rows, done, "emp_master", ["emp_id"]).collect()}
    assert out[1]["document"]["employment"]["status"] == "active" and out[1]["document"]["employment"]["startDate"]["$date"] == "2020-01-02T03:04:05Z"
    assert out[2]["document"]["employment"]["status"] == "Q" and out[2]["document"]["department"]["departmentId"] is None


def shop_answers(*rows):
    return [{"stage": "adjudicate", "table": "acct", "confidence": 0.9, "reasoning": "Fits.", **r} for r in rows]


def run_shop(spark, shop, rows, **more):
    return map_schemas(*shop, cheap=Scripted(spark, rows), routes=[("acct", "cages", 1.0, "Only one.")], reflection=False, **more)


def decided(r):
    return {x["name"]: x for x in r.decisions.collect()}


def test_invented_path_is_retried_then_dropped(spark, shop):
    rows = shop_answers({"name": "acct_id", "path": "_id"}, {"name": "cust_nm", "path": "made.up"}, {"name": "mrr_amt", "path": "no.such"})
    rows.append({"stage": "path_retry", "table": "acct", "name": "cust_nm", "path": "animal.species", "confidence": 0.7, "reasoning": "Second try."})
    r = run_shop(spark, shop, rows)
    d = decided(r)
    assert d["cust_nm"]["path"] == "animal.species" and d["cust_nm"]["repaired"]
    assert d["mrr_amt"]["path"] is None and "no.such" in d["mrr_amt"]["forced_null"] and d["mgr_id"]["path"] is None
    kinds = {(x["kind"], x["key"]) for x in r.diagnostics.collect()}
    assert {("hallucinated_path", "acct.cust_nm"), ("hallucinated_path", "acct.mrr_amt"), ("forced_null", "acct.mrr_amt")} <= kinds and r.ok


def test_collision_by_confidence_and_by_tiebreak(spark, shop):
    two = [{"name": "cust_nm", "path": "animal.species"}, {"name": "mrr_amt", "path": "animal.species", "confidence": 0.3}]
    d = decided(run_shop(spark, shop, shop_answers(*two)))
    assert d["cust_nm"]["path"] == "animal.species" and d["mrr_amt"]["path"] is None and d["mrr_amt"]["confidence"] == 0.0 and d["mrr_amt"]["tie_broken"]
    even = [{"name": "acct_id", "path": "fedAt"}, {"name": "mgr_id", "path": "fedAt"}]
    rows = shop_answers(*even)
    first = decided(run_shop(spark, shop, rows))
    winner = next(n for n in ("acct_id", "mgr_id") if first[n]["path"])
    loser = ({"acct_id", "mgr_id"} - {winner}).pop()
    rows.append({"stage": "tiebreak", "table": "acct", "name": winner, "path": f"acct.{loser}", "confidence": 1.0, "reasoning": "x"})
    again = decided(run_shop(spark, shop, rows))
    assert again[loser]["path"] == "fedAt" and again[winner]["path"] is None and "tiebreak" in again[winner]["forced_null"]


def test_words_are_repaired(spark, shop):
    rows = shop_answers({"name": "acct_id", "path": "_id", "reasoning": "One. Two. Three.", "notes": "wrap the integer"}, {"name": "cust_nm", "path": " N/A "})
    r = run_shop(spark, shop, rows)
    d = decided(r)
    assert d["acct_id"]["reasoning"] == "One." and "legacy" in d["acct_id"]["notes"] and d["acct_id"]["confidence"] <= 0.85
    assert d["cust_nm"]["path"] is None
    assert {("reasoning_repair", "acct.acct_id"), ("notes_correction", "acct.acct_id")} <= {(x["kind"], x["key"]) for x in r.diagnostics.collect()}


def test_cascade_and_reflection(spark, shop):
    rows = shop_answers({"name": "acct_id", "path": "_id", "confidence": 0.95}, {"name": "acct.cust_nm", "path": "fedAt", "confidence": 0.4})
    strong = [{"stage": "escalate", "table": "acct", "name": "cust_nm", "path": "animal.species", "confidence": 0.5, "reasoning": "Better."},
              {"stage": "reflect", "table": "acct", "name": "mrr_amt", "path": "animal.weightKg", "confidence": 0.9, "reasoning": "A number."}]
    r = map_schemas(*shop, cheap=Scripted(spark, rows), strong=Scripted(spark, strong), routes=[("acct", "cages", 1.0, "")])
    d = decided(r)
    assert (d["cust_nm"]["path"], d["cust_nm"]["decided_by"]) == ("animal.species", "escalated") and d["acct_id"]["decided_by"] == "cheap"
    assert (d["mrr_amt"]["path"], d["mrr_amt"]["decided_by"]) == ("animal.weightKg", "reflection")
    assert [p["pass"] for p in d["cust_nm"]["passes"]] == ["cheap", "escalated"]
    assert r.report()["quality"].first()["escalation_rate"] == 0.5


def test_user_function_is_asked_in_batches(spark, shop):
    def ask(frame: pd.DataFrame, stage: str) -> pd.DataFrame:
        rows = frame.assign(path=[c[0]["path"] if len(c) else None for c in frame["candidates"]], confidence=0.9, reasoning="First.", notes=None, model=stage)
        return rows[["table", "name", "path", "confidence", "reasoning", "notes", "model"]]

    r = map_schemas(*shop, cheap=Call(ask), reflection=False)
    assert any(x["path"] for x in r.decisions.collect())


def test_a_run_records_its_calls(spark, hr, tmp_path):
    """One call a batch, priced, with prompt, snippets, examples and manifest; persisted and listed again."""

    def choose(frame, stage):
        path = [c[0]["path"] if len(c) else None for c in frame["candidates"]]
        sure = [0.5 if stage == "adjudicate" and k == 0 else 0.9 for k in range(len(frame))]
        notes = ["seen" if "Background:" in p else "not seen" for p in frame["prompt"]] if "prompt" in frame else None
        return frame[["table", "name"]].assign(path=path, confidence=sure, reasoning="The names agree.", notes=notes, model="fast" if stage == "adjudicate" else "strong")

    example = {"source_table": "emp_master", "source_field": "f_name", "destination_field": "fullName.firstName"}
    pack = knowledge.Knowledge(**{**knowledge.default_pack().__dict__, "overrides": (example,)})
    r = map_schemas(*hr, Call(choose), Call(choose), pack=pack, generated_at="2024-01-01T00:00:00Z")
    made = r.calls.collect()
    batches_ = [c for c in made if c["stage"] == "adjudicate"]
    assert len(batches_) == 5 and sum(len(c["source_fields"]) for c in batches_) == 34 and max(len(c["source_fields"]) for c in batches_) == 8
    assert [c["seq"] for c in made] == list(range(len(made))) and all(len(c["source_tables"]) == 1 and c["input_tokens"] > 0 and c["output_tokens"] > 0 for c in made)
    assert {c["model_id"] for c in made if c["stage"] == "escalate"} == {"strong"} and all(len(c["destination_paths"]) < 40 for c in made)
    trace = r.log.trace(spark).collect()
    assert all("Background:" in t["prompt"] and t["answer"] for t in trace if t["stage"] == "adjudicate")
    assert any("Accepted before:\n  f_name -> fullName.firstName" in t["prompt"] for t in trace if t["table"] == "emp_master") and not any("Accepted" in t["prompt"] for t in trace if t["table"] == "locations")
    report = r.report()
    cost, most = report["cost"].first(), report["constraints"].first()
    assert cost["total_tokens"] == sum(c["input_tokens"] + c["output_tokens"] for c in made) and cost["total_usd"] > 0 and cost["billable_calls"] == len(made)
    assert most["max_typed_fields"] == 8 and most["max_tables"] == 1 and most["prompts_with_both_schemas"] == 0 and most["both_schemas_tokens"] > most["max_input_tokens"] / 4
    rate = report["escalation"].first()
    assert rate["decisions"] == 34 and rate["escalated"] == sum(len(c["source_fields"]) for c in made if c["stage"] == "escalate") >= 1
    kinds = [e["type"] for e in r.progress.events]
    assert kinds.count("batch") >= 5 and "escalate" in kinds and kinds[-2:] == ["result", "run_end"]
    home = writers.persist_run(r, str(tmp_path / "runs"))
    kept = api.runs(spark, str(tmp_path / "runs")).collect()
    assert [(x["run_id"], x["calls"]) for x in kept] == [(r.run_id, len(made))] and spark.read.json(f"{home}/calls").count() == len(made)
    assert spark.read.json(f"{home}/prompts").count() == len(made)


def test_the_budget_holds_before_a_call(spark, shop):
    """A run that would pass its ceiling ends with an event, before anybody is asked."""
    asked, progress = [], Progress()

    class Never:
        def answer(self, questions, stage):
            asked.append(stage)

    with pytest.raises(ledger.BudgetExceeded, match="raise the ceiling"):
        map_schemas(*shop, Never(), limits=DEFAULTS.__class__(token_ceiling=50), progress=progress)
    assert not asked and progress.events[-1]["type"] == "error"
    held = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    assert held == ("4", "true")


def test_settings_reach_the_command_line(monkeypatch, capsys):
    from docweave import __main__, settings

    monkeypatch.setenv("DOCWEAVE_TOP_K", "9")
    monkeypatch.setenv("DOCWEAVE_CASCADE", "off")
    args = __main__.parser(settings.load()).parse_args(["a", "b"])
    assert args.top_k == 9 and args.no_cascade and not args.no_reflection
    monkeypatch.setenv("DOCWEAVE_TOP_K", "many")
    assert main(["a", "b"]) == 2 and "setting" in capsys.readouterr().err


def test_replay_needs_every_answer(spark, shop):
    records = spark.createDataFrame([("adjudicate", "acct", "acct_id", "_id", 0.9, "r", None, "m")], f"stage string, {ANSWERS}")
    with pytest.raises(LookupError):
        map_schemas(*shop, cheap=Replay(records), reflection=False)
    q = spark.createDataFrame([("t", "a"), ("t", "b")], "table string, name string")
    a = spark.createDataFrame([("t", "x.a", "p1", 0.1, None, None, "m"), ("t", "a", "-", 0.2, None, None, "m"), ("t", "z", "p", 1.0, None, None, "m")], ANSWERS).coalesce(1)
    assert [(r["name"], r["path"], r["confidence"]) for r in match_answers(q, a).collect()] == [("a", None, 0.2)]


def test_recorded_calls(spark, tmp_path):
    manifest = {"source_tables": ["t"], "source_fields": ["t.a", "t.b"], "destination_paths": ["x", "x"], "destination_collections": ["c"], "detail_level": "typed"}
    one = {"request": {"stage": "adjudicate", "model_id": "fast", "system": "s", "user": "uu", "manifest": manifest},
           "response": {"data": {"mappings": [{"source_field": "a", "destination_field": "x", "confidence": 0.9, "reasoning": "r"}]}, "input_tokens": 100, "output_tokens": 10, "model_id": "fast", "latency_ms": 5}}
    two = {"request": {"stage": "route", "model_id": "micro", "manifest": {**manifest, "detail_level": "names"}},
           "response": {"data": {"destination_collection": "c", "confidence": 0.8, "reasoning": "x"}, "input_tokens": 7, "output_tokens": 1, "model_id": "micro", "latency_ms": 5}}
    for k, x in enumerate((one, two)):
        (tmp_path / f"{k}.json").write_text(json.dumps(x))
    records = calls.read_records(spark, str(tmp_path))
    assert calls.routes_of(records) == [("t", "c", 0.8, "x")]
    assert calls.answers_of(records).first()["path"] == "x"
    assert calls.answers_of(records, "fast").filter("stage = 'escalate'").count() == 1
    log = calls.calls_of(records)
    m = ledger.constraint_maxima(log).first()
    assert (m["total_calls"], m["max_typed_fields"], m["max_paths"], m["max_mappings"], m["max_input_tokens"]) == (2, 2, 1, 1, 100)
    assert ledger.whole_schema_prompts(log, 2, 1).first()[0] == 1 and ledger.whole_schema_prompts(log, 3, 1).first()[0] == 0
    with pytest.raises(ledger.BudgetExceeded):
        ledger.check_budget(log, 10, 100)
    ledger.check_budget(log, 0, 118)
    total = ledger.totals(ledger.priced(log, ledger.model_prices(spark)))
    assert total.first()["total_usd"] == round(100e-6 + 50e-6 + 7e-6 * 0.035 + 1e-6 * 0.14, 6)
    assert ledger.cost_per_field(total, 0).first()[0] == 0.0


def test_routing():
    r = routing.resolve([("cust", "people", 0.9, ""), ("emp", "people", 0.95, ""), ("z", "none", 0.9, "")], ["people", "customers", "zoo"])
    assert r.pairs == {"cust": "customers", "emp": "people", "z": "zoo"} and len(r.conflicts) == 2 and r.confidence["z"] == 0.5
    assert routing.resolve([("a", "x", 1.0, ""), ("b", "x", 0.5, "")], ["x"]).pairs == {"a": "x", "b": "x"}


def test_coverage_finds_each_fault(spark, done, hr):
    doc = json.loads(writers.mapping_text(done.document))
    t = doc["tables"][0]
    t["unmapped_source_fields"] = ["emp_id", "ghost"]
    t["field_mappings"][1]["destination_field"] = "made.up"
    t["field_mappings"][2]["reasoning"] = "One. Two."
    t["field_mappings"][3]["confidence"] = 1.5
    doc["tables"][1]["source_table"] = "nope"
    doc["tables"][2]["destination_collection"] = "nowhere"
    doc["generated_at"] = "today"
    bad = spark.createDataFrame([doc], MAPPING_DOCUMENT)
    found = {(r["kind"], r["key"], r["detail"]) for r in coverage.full_validation(bad, *hr).collect()}
    details = {d for _, _, d in found}
    for d in ("unknown source table", "column is neither mapped nor declared unmapped", "column is both mapped and declared unmapped", "unknown column", "unknown destination collection",
              "path is neither targeted nor declared unmapped", "unknown path", "source table is missing", "is not one sentence", "is not between 0 and 1", "is no ISO 8601 time"):
        assert d in details, d
    assert ("unresolved_path", "emp_master.emp_cd", "made.up") in found
    assert coverage.full_validation(done.document, *hr).isEmpty()


def test_snippets_and_batches(spark, hr):
    pack = knowledge.default_pack()
    terms = snippets.batch_terms(batches(hr[0], DEFAULTS.batch), pack)
    assert terms.filter("table = 'emp_master'").count() == 3
    asked = terms.select(F.concat_ws("/", "table", F.col("batch").cast("string")).alias("query"), "terms")
    found = snippets.retrieve(asked, snippets.snippet_rows(spark, pack))
    assert found.groupBy("query").count().agg(F.max("count")).first()[0] <= 4 and "money" in {r["id"] for r in found.filter("query = 'emp_master/1'").collect()}
    assert pack.type_rule("DATE")[1] == "ISODate" and pack.type_rule("X") is None and pack.exemplars("t") == []


def test_knowledge_file(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"abbreviations": {"QTY": "Quantity"}, "synonyms": [["a", "b"], ["b", "c"]], "stopwords": ["The"], "snippets": [{"id": "i", "text": "t"}]}))
    pack = knowledge.read_pack(spark, str(tmp_path / "k.json"))
    assert pack.abbreviations == {"qty": ["quantity"]} and pack.synonyms["b"] == ["a", "c"] and pack.stopwords == ("the",)


def test_sinks(spark, tmp_path, done):
    writers.write_document(done.document, str(tmp_path / "doc"))
    assert '"notes":null' in spark.read.text(str(tmp_path / "doc")).first()[0]
    cache = spark.createDataFrame([("k1", "yes")], "key string, answer string")
    writers.record_calls(cache, str(tmp_path / "cache"))
    hit, miss = writers.cached(spark.createDataFrame([("k1",), ("k2",)], "key string"), spark.read.json(str(tmp_path / "cache")), "key")
    assert hit.first()["answer"] == "yes" and miss.first()["key"] == "k2"
    runs = spark.createDataFrame([(f"r{k}", k) for k in range(30)], "run_id string, started_at long")
    assert [r["run_id"] for r in writers.history(runs).collect()][:2] == ["r29", "r28"] and writers.history(runs).count() == 25
    assert assemble.review_list(done.document).count() == done.report()["quality"].first()["review"]


def test_progress_stream(spark, tmp_path):
    seen = []
    p = Progress(seen.append)
    p.emit("mapping", source_field="a", path="x")
    p.emit("mapping", source_field="a", path="y")
    assert [e["type"] for e in seen] == ["mapping", "mapping"]
    assert parse_sse(sse("a", "1") + sse("b", "2")) == [("a", "1"), ("b", "2")]
    events = str(tmp_path / "events")
    p.frame(spark).limit(1).write.mode("append").json(events)
    stream = lambda: last_by_key_stream(read_events(spark, events), "type", "seq", str(tmp_path / "last")).option("checkpointLocation", str(tmp_path / "cp")).start()
    for batch in (None, p.frame(spark).filter("seq = 1")):
        if batch is not None:
            batch.write.mode("append").json(events)
        q = stream()
        q.processAllAvailable()
        q.stop()
    last = {r["type"]: r for r in read_last(spark, str(tmp_path / "last"), "type").collect()}
    assert len(last) == p.frame(spark).select("type").distinct().count() and '"y"' in next(r["payload"] for r in last.values() if r["seq"] == 1)


def test_surface(spark):
    out = api.parse(spark, HR_DDL, PEOPLE_JSON)
    assert out["assessment"].first()["verdict"] == "aligned" and {r["fields"] for r in out["table_counts"].collect()} == {19, 7, 8}
    assert api.candidates(out["source"], out["dest"], "emp_master", "work_email", "employees", 3).first()["path"] == "contact.email"
    assert api.describe(spark)["status"] == "ok" and api.model_prices(spark).count() == 6 and "tables" in api.contract_schema()
    with pytest.raises(ValueError):
        api.run(spark, HR_DDL, PEOPLE_JSON, batch=0)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "s.json").write_text(SHOP_JSON)
    (tmp_path / "d.json").write_text(ZOO_JSON)
    (tmp_path / "bad.txt").write_text("prose")
    assert main([str(tmp_path / "s.json"), str(tmp_path / "d.json"), "--output", str(tmp_path / "out")]) == 0
    assert json.loads((tmp_path / "out" / "mapping_tiny_shop_to_zoo.json").read_text())["tables"][0]["source_table"] == "acct"
    assert main([str(tmp_path / "bad.txt"), str(tmp_path / "d.json"), "--quiet"]) == 2
    assert "error" in capsys.readouterr().err


def test_separation(spark):
    rows = spark.createDataFrame([(True, 0.6), (True, 0.5), (False, 0.4), (False, 0.3)], "is_true boolean, score double")
    r = evaluation.separation(rows).first()
    assert (r["true_min"], r["other_max"], r["misplaced"]) == (0.5, 0.4, 0)
    assert Deterministic().floor == 0.25
