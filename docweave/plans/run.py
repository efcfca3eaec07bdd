"""A whole run: route, shortlist, adjudicate, reflect, repair, assemble, validate."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.values import Field
from docweave.operators import assemble as out
from docweave.operators import coverage, decisions, ledger, pairing, prompts
from docweave.operators.adjudicate import Adjudicator, Deterministic
from docweave.operators.recording import CallLog, Recorder
from docweave.operators.routing import Routing, resolve
from docweave.operators.shortlist import shortlist
from docweave.session import scratch
from docweave.sources.knowledge import Knowledge, default_pack
from docweave.streaming.progress import Progress
from docweave.types import DEFAULTS, FATAL, Thresholds


@dataclass
class Run:
    """What a run yields; every table is a DataFrame."""

    run_id: str
    routing: Routing
    candidates: DataFrame
    decisions: DataFrame
    document: DataFrame
    diagnostics: DataFrame
    pairing: DataFrame
    source: DataFrame
    dest: DataFrame
    progress: Progress
    duration_ms: int = 0
    limits: Thresholds = field(default_factory=Thresholds)
    log: CallLog = field(default_factory=CallLog)
    started_at: str = ""

    @property
    def ok(self) -> bool:
        return self.diagnostics.filter(F.col("kind").isin(*FATAL)).isEmpty()

    def report(self) -> dict[str, DataFrame]:
        """The report's tables by name."""
        return {
            "routing": self.routing.frame(self.document.sparkSession), "pairing": self.pairing, "coverage": out.coverage(self.document, self.source, self.dest),
            "quality": out.quality(self.document, self.decisions, self.limits), "unmapped_source": out.unmapped_source(self.decisions),
            "unmapped_destination": out.unmapped_destination(self.decisions, self.dest, self.routing.frame(self.document.sparkSession)),
            "diagnostics": self.diagnostics, "decisions": self.decisions, "escalation": out.escalation(self.decisions), **self.cost(), "constraints": self.constraints(),
        }

    @property
    def calls(self) -> DataFrame:
        """The run's calls; none where no model was asked."""
        return self.log.frame(self.document.sparkSession)

    def cost(self) -> dict[str, DataFrame]:
        """The ledger: totals with the cost per mapped column, by stage, by model, and on other models."""
        prices = ledger.model_prices(self.document.sparkSession)
        calls = ledger.priced(self.calls, prices)
        total = ledger.totals(calls)
        mapped = self.decisions.filter("path is not null").count()
        return {
            "cost": total.crossJoin(ledger.cost_per_field(total, mapped)), "cost_by_stage": ledger.by_stage(calls), "cost_by_model": ledger.by_model(calls),
            "what_if": ledger.what_if(total, prices),
        }

    def constraints(self) -> DataFrame:
        """One row: the most that any call was shown, prompts with both schemas whole, and what those would have taken."""
        n, m = self.source.count(), self.dest.count()
        most = ledger.constraint_maxima(self.calls).crossJoin(ledger.whole_schema_prompts(self.calls, n, m))
        return most.withColumns({"source_fields": F.lit(n), "destination_paths": F.lit(m), "both_schemas_tokens": F.lit(prompts.counterfactual_tokens(self.source, self.dest))})


@contextmanager
def small_tables(spark: SparkSession):
    """Schemas have a row per column: inside, their joins take one partition each and are not re-planned. Settings come back."""
    held = {name: spark.conf.get(name, None) for name in SMALL}
    try:
        for name, value in SMALL.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in held.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


#: One partition, one plan, and no code compiled for rows that are fewer than the code's lines.
SMALL = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}


def propose_routes(pairings: DataFrame) -> list[tuple[str, str, float, str]]:
    """Routing without a model: each table's best collection by vocabulary."""
    rows = pairings.orderBy("table_ord").collect()  # a row per table of a schema
    return [(r["table"], r["collection"], float(r["affinity"]), f"Table {r['table']} shares most of its vocabulary with collection {r['collection']}.") for r in rows]


def ask_routes(source: DataFrame, dest: DataFrame, router: Adjudicator) -> list[tuple[str, str, float, str]]:
    """Routing by an adjudicator: one call a table, with names only. Its answer's path names the collection."""
    offered = dest.groupBy("collection").agg(F.min("coll_ord").alias("at"))
    offered = offered.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "collection"))), lambda c: F.struct(c["collection"].alias("path"), F.lit(0.0).alias("total"))).alias("candidates"))
    asked = prompts.route_prompts(source, dest).crossJoin(F.broadcast(offered))  # one row of collections
    said = router.answer(asked.withColumns({"name": F.col("table"), "batch": F.lit(0).cast("long")}), "route").collect()  # a row per table
    return [(r["table"], r["path"] or "", float(r["confidence"] or 0.0), r["reasoning"] or "") for r in said]


def map_schemas(
    source: DataFrame,
    dest: DataFrame,
    cheap: Adjudicator | None = None,
    strong: Adjudicator | None = None,
    routes: list[tuple[str, str, float, str]] | None = None,
    pack: Knowledge | None = None,
    limits: Thresholds = DEFAULTS,
    reflection: bool = True,
    progress: Progress | None = None,
    generated_at: str | None = None,
    router: Adjudicator | None = None,
) -> Run:
    """source, dest: field rows. ``cheap`` answers first, ``strong`` what it was unsure of, and reviews; without any, the
    best candidates by score are taken. ``routes``: proposals per table, else ``router``'s, by default by vocabulary.

    Whoever answers but the library's own scorer is asked in recorded calls: see Run.log, report() and Run.calls.
    """
    progress = progress or Progress()
    try:
        with small_tables(source.sparkSession):
            return _map(source, dest, cheap, strong, routes, pack or default_pack(), limits, reflection, progress, generated_at, router)
    except Exception as e:
        progress.emit("error", error=type(e).__name__, message=str(e)[:500])
        raise


def _map(source, dest, cheap, strong, routes, pack, limits, reflection, progress, generated_at, router) -> Run:
    began, spark = time.time(), source.sparkSession
    run_id, log = uuid.uuid4().hex[:12], CallLog(limits, progress)
    progress.emit("run_start", run_id=run_id)
    source, dest = scratch(source.coalesce(1), "source"), scratch(dest.coalesce(1), "dest")
    recorded = lambda who, model: who if who is None or isinstance(who, Deterministic) else Recorder(who, log, dest, pack, model)
    cheap, strong, router = recorded(cheap or Deterministic(), "fast"), recorded(strong, "strong"), recorded(router, "micro")
    pairings = scratch(pairing.table_pairings(pairing.field_affinities(source, dest, pack)), "pairings")
    verdict = scratch(pairing.assess(pairings), "verdict")

    progress.emit("stage_start", stage="route")
    tables = [r["table"] for r in source.select("table", "table_ord").distinct().orderBy("table_ord").collect()]
    colls = [r["collection"] for r in dest.select("collection", "coll_ord").distinct().orderBy("coll_ord").collect()]
    proposals = {p[0]: p for p in (routes or (ask_routes(source, dest, router) if router else propose_routes(pairings)))}
    routing = resolve([proposals.get(t, (t, "", 0.0, "")) for t in tables], colls)
    for t, c in routing.pairs.items():
        progress.emit("route", table=t, collection=c, confidence=routing.confidence[t])
    routed = routing.frame(spark)

    progress.emit("stage_start", stage="shortlist")
    candidates = scratch(shortlist(source, dest, routed, pack, limits), "candidates")
    questions = scratch(decisions.open_decisions(source, routed, candidates, limits), "questions")
    progress.emit("stage_end", stage="shortlist", **out.shortlist_stats(questions).first().asDict())

    progress.emit("stage_start", stage="adjudicate")
    held = decisions.finalize(decisions.adjudicate(questions, cheap, strong, limits), dest, limits)
    judge = strong or cheap
    if reflection and strong is not None:
        held = decisions.reflect(scratch(held, "adjudicated"), dest, judge, limits)
    progress.emit("stage_start", stage="repair")
    held, found = decisions.repair(scratch(held, "reflected"), dest, judge, limits)

    progress.emit("stage_start", stage="assemble")
    document = scratch(out.assemble(held, source, dest, routed, generated_at), "document")
    found = scratch(found.unionByName(coverage.full_validation(document, source, dest)), "diagnostics")
    n = 0
    for r in out.mapped_fields(document).select("source_table", "source_field", "destination_field", "confidence").toLocalIterator():
        progress.emit("mapping", source_field=f"{r[0]}.{r[1]}", destination_field=r[2], confidence=r[3])
        n += 1
    progress.emit("result", run_id=run_id, mapped=n, calls=len(log.rows))
    progress.emit("run_end", run_id=run_id)
    started = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(began))
    return Run(run_id, routing, candidates, held, document, found, verdict, source, dest, progress, int(1000 * (time.time() - began)), limits, log, started)


def compile_mapping(document: DataFrame, source: DataFrame, dest: DataFrame, table: str) -> list[Field]:
    """A table's accepted mapping as the pairs that migrate() takes. Columns and paths that a schema lacks are left out."""
    m = out.mapped_fields(document).filter(F.col("source_table") == table)
    s = source.select(F.col("table").alias("source_table"), F.col("name").alias("source_field"), "sql_type", "is_pk", "references", "comment", "ord")
    d = dest.select(F.col("collection").alias("destination_collection"), F.col("path").alias("destination_field"), "bson_type")
    rows = m.join(s, ["source_table", "source_field"]).join(d, ["destination_collection", "destination_field"]).orderBy("ord").collect()
    return [Field(table, r["source_field"], r["sql_type"], r["is_pk"], r["references"], r["comment"], r["destination_field"], r["bson_type"]) for r in rows]
