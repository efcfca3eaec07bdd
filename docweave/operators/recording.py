"""Calls of a run: what each was shown, what it took, and the guards before it.

Questions that go to a model are grouped into calls: a batch of a table's columns, or one column where a stage looks at one. Before any
is put, the recorder makes its prompt (with knowledge snippets and accepted examples), checks its scope and the run's token ceiling;
afterwards it books tokens, time and manifest. A run has as many calls as its schemas have batches, so the driver keeps the ledger.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import approx_tokens
from docweave.operators import ledger, prompts
from docweave.operators.adjudicate import Adjudicator
from docweave.operators.snippets import batch_terms, retrieve, snippet_rows
from docweave.session import scratch
from docweave.sources.knowledge import Knowledge
from docweave.streaming.progress import Progress
from docweave.types import CALLS, DEFAULTS, Thresholds

TRACE = "seq long, stage string, model_id string, table string, batch long, system string, prompt string, answer string"
#: Stages whose calls show one column each; all others show a batch.
SINGLE = ("reflect", "tiebreak", "rewrite")
#: The progress event that a call of a stage is.
EVENTS = {"adjudicate": "batch", "path_retry": "batch", "escalate": "escalate", "reflect": "reflect"}
_NAMES = [f.split()[0] for f in CALLS.split(", ")]


class CallLog:
    """Calls in order, with their prompts and answers."""

    def __init__(self, limits: Thresholds = DEFAULTS, progress: Progress | None = None):
        self.limits, self.progress, self.rows, self.traces = limits, progress or Progress(), [], []

    def check(self, projected: int) -> None:
        """Refuses calls that would take the run above its token ceiling, before they are made."""
        used = sum(r["input_tokens"] + r["output_tokens"] for r in self.rows if not r["cache_hit"])
        if used + projected > self.limits.token_ceiling:
            raise ledger.BudgetExceeded(f"The run has used {used} of {self.limits.token_ceiling} tokens and the next calls need about {projected}; raise the ceiling to go on.")

    def add(self, call: dict, trace: dict) -> None:
        seq = len(self.rows)
        self.rows.append({"seq": seq, **call})
        self.traces.append({"seq": seq, **trace})
        if kind := EVENTS.get(call["stage"]):
            self.progress.emit(kind, table=trace["table"], batch=trace["batch"], fields=call["source_fields"], model=call["model_id"])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r[c] for c in _NAMES) for r in self.rows], CALLS)

    def trace(self, spark: SparkSession) -> DataFrame:
        """Every prompt as it was put, and what came back."""
        names = [f.split()[0] for f in TRACE.split(", ")]
        return spark.createDataFrame([tuple(r[c] for c in names) for r in self.traces], TRACE)


class Recorder:
    """An adjudicator whose calls are recorded. ``model``: under which name they are priced if answers don't say."""

    def __init__(self, who: Adjudicator, log: CallLog, dest: DataFrame, pack: Knowledge, model: str):
        self.who, self.log, self.dest, self.pack, self.model = who, log, dest, pack, model

    def _shown(self, questions: DataFrame, stage: str) -> DataFrame:
        if stage == "route":
            return questions.select("table", "batch", "prompt", F.lit(0).alias("columns"), F.transform("candidates", lambda c: c["path"]).alias("paths"))
        known = None
        if self.pack.snippets:
            best = retrieve(batch_terms(questions, self.pack).select(F.struct("table", "batch").alias("query"), "terms"), snippet_rows(questions.sparkSession, self.pack))
            texts = questions.sparkSession.createDataFrame([(i, x) for i, _, x in self.pack.snippets], "id string, text string")
            known = best.join(texts, "id").select("query.table", "query.batch", "text")
        shown = prompts.batch_prompts(questions, self.dest, known)
        return shown.withColumn("prompt", F.concat("prompt", self._examples(F.col("table"))))

    def _examples(self, table):
        """Accepted mappings of the table, as lines of its prompts."""
        out = F.lit("")
        for name in {o.get("source_table") for o in self.pack.overrides}:
            lines = "".join(f"\n  {o.get('source_field')} -> {o.get('destination_field')}" for o in self.pack.exemplars(name))
            out = F.when(table == name, f"\nAccepted before:{lines}").otherwise(out)
        return out

    def answer(self, questions: DataFrame, stage: str) -> DataFrame:
        if stage in SINGLE:
            questions = questions.withColumn("batch", F.col("ord"))
        questions = scratch(questions, f"asked-{stage}")
        shown = self._shown(questions, stage).withColumn("tokens", prompts.projected_tokens(F.col("prompt"), stage))
        names = questions.groupBy("table", "batch").agg(F.array_sort(F.collect_list("name")).alias("names"), F.collect_set("collection" if stage != "route" else "table").alias("collections"))
        asked = shown.join(names, ["table", "batch"]).orderBy("table", "batch").collect()  # a row per call
        if not asked:
            return self.who.answer(questions, stage)
        if wide := [r for r in asked if stage not in SINGLE and len(r["names"]) > self.log.limits.batch]:
            raise prompts.ScopeError(f"a call of {wide[0]['table']} would show {len(wide[0]['names'])} columns; it may show {self.log.limits.batch}")
        self.log.check(sum(r["tokens"] for r in asked))
        if "prompt" not in questions.columns:
            questions = questions.join(F.broadcast(shown.select("table", "batch", "prompt")), ["table", "batch"])
        began = time.time()
        said = scratch(self.who.answer(questions, stage), f"said-{stage}")
        took = int(1000 * (time.time() - began) / len(asked))
        each = said.withColumn("name", F.substring_index(F.trim("name"), ".", -1)).join(questions.select("table", "batch", "name"), ["table", "name"])
        each = each.groupBy("table", "batch").agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "path", "confidence", "reasoning", "notes")))).alias("answer"), F.max("model").alias("model"))
        back = {(r["table"], r["batch"]): r for r in each.withColumn("tokens", approx_tokens(F.col("answer"))).collect()}
        for r in asked:
            found = back.get((r["table"], r["batch"]))
            typed = stage != "route"
            call = {
                "stage": stage, "model_id": (found and found["model"]) or self.model, "input_tokens": r["tokens"], "output_tokens": found["tokens"] if found else 0, "latency_ms": took,
                "cache_hit": False, "source_tables": [r["table"]], "source_fields": [f"{r['table']}.{n}" for n in r["names"]] if typed else [],
                "destination_collections": sorted(c for c in r["collections"] if c) if typed else sorted(r["paths"]), "destination_paths": sorted(r["paths"]) if typed else [],
                "detail_level": "typed" if typed else "names", "prompt_chars": len(r["prompt"]), "mappings": len(json.loads(found["answer"])) if found else 0,
            }
            self.log.add(call, {"stage": stage, "model_id": call["model_id"], "table": r["table"], "batch": r["batch"], "system": prompts.SYSTEM[stage], "prompt": r["prompt"], "answer": found["answer"] if found else None})
        return said
