"""From answers to final decisions: blending, cascade, reflection and repair, each a DataFrame transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import mapping
from docweave.functions.text import bson_category, first_sentence, is_enum_code, needs_repair, sql_category
from docweave.operators.adjudicate import Adjudicator, match_answers
from docweave.operators.shortlist import margin, type_compatibility
from docweave.session import scratch
from docweave.types import DEFAULTS, DIAGNOSTICS, Thresholds


def blend(model: Column, retrieval: Column, penalty: Column, cap: Column, limits: Thresholds = DEFAULTS) -> Column:
    """Weighted certainty of model and retrieval, less a penalty, under a cap (null: none), two decimals."""
    raw = limits.model_weight * model + limits.retrieval_weight * retrieval - penalty
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(raw, F.coalesce(cap, F.lit(1.0))))), 2)


def open_decisions(source: DataFrame, routing: DataFrame, candidates: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """A row per column with its collection, batch and candidates (array of path, total, best first)."""
    offered = candidates.groupBy("table", "name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "path", "total"))), lambda c: F.struct(c["path"].alias("path"), c["total"].alias("total"))).alias("candidates")
    )
    own = source.join(F.broadcast(routing.select("table", "collection")), "table").join(offered, ["table", "name"], "left")
    batch = F.floor((F.row_number().over(Window.partitionBy("table").orderBy("ord")) - 1) / limits.batch)
    empty = F.array().cast("array<struct<path: string, total: double>>")
    return own.withColumn("candidates", F.coalesce("candidates", empty)).withColumn("batch", batch)


def with_dest(decisions: DataFrame, dest: DataFrame) -> DataFrame:
    """Adds dest_type and legal: the chosen path's type, if the collection has it, and p, the pair for mapping rules."""
    found = dest.select("collection", "path", F.col("bson_type").alias("dest_type"))
    joined = decisions.drop("dest_type", "p", "legal").join(F.broadcast(found), ["collection", "path"], "left")
    pair = F.struct("sql_type", "is_pk", "references", "comment", "name", "path", F.col("dest_type").alias("bson_type"))
    return joined.withColumn("p", pair).withColumn("legal", F.col("dest_type").isNotNull())


def finalize(decisions: DataFrame, dest: DataFrame, limits: Thresholds = DEFAULTS) -> DataFrame:
    """Sets confidence; an unmapped column has 0."""
    d = with_dest(decisions, dest)
    chosen = F.get(F.filter("candidates", lambda c: c["path"] == F.col("path")), F.lit(0))["total"]
    rival = F.array_max(F.transform(F.filter("candidates", lambda c: c["path"] != F.col("path")), lambda c: c["total"]))
    suits = type_compatibility(sql_category(F.col("sql_type")), bson_category(F.col("dest_type")), is_enum_code(F.col("sql_type"), F.col("comment")))
    penalty = F.when(F.col("legal") & (suits < 0.5), limits.type_penalty).otherwise(0.0)
    cap = F.when(F.col("legal") & mapping.needs_person(mapping.rule("p")), limits.manual_cap)
    sure = blend(F.col("model_confidence"), margin(chosen, rival), penalty, cap, limits)
    return d.withColumn("confidence", F.when(F.col("path").isNull(), 0.0).otherwise(sure)).drop("dest_type", "p", "legal")


def _record(stage: str) -> Column:
    return F.struct(
        F.lit(stage).alias("pass"), F.col("model").alias("model"), F.col("new_path").alias("destination_field"), F.col("new_confidence").alias("confidence"),
        F.col("new_reasoning").alias("reasoning"),
    )


def ask(decisions: DataFrame, who: Adjudicator, stage: str, which: Column) -> DataFrame:
    """Put the questions that ``which`` selects; adds new_path, new_confidence, new_reasoning, new_notes, model, answered.

    Answers are written to the shared folder first, so that no plan asks a model twice.
    """
    questions = decisions.filter(which)
    found = scratch(match_answers(questions, who.answer(questions, stage)), f"answers-{stage}")
    named = found.select("table", "name", F.col("path").alias("new_path"), F.col("confidence").alias("new_confidence"), F.col("reasoning").alias("new_reasoning"), F.col("notes").alias("new_notes"), "model", F.lit(True).alias("answered"))
    return decisions.join(named, ["table", "name"], "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


_NEW = ("new_path", "new_confidence", "new_reasoning", "new_notes", "model", "answered")


def _take(decisions: DataFrame, stage: str, when: Column, **more: Column) -> DataFrame:
    """Let new answers replace old ones where ``when`` holds."""
    changed = {
        "passes": F.when(F.col("answered"), F.concat("passes", F.array(_record(stage)))).otherwise(F.col("passes")),
        **{c: F.when(when, F.col(f"new_{n}")).otherwise(F.col(c)) for c, n in (("path", "path"), ("model_confidence", "confidence"), ("reasoning", "reasoning"), ("notes", "notes"))},
        **{c: F.when(when, v).otherwise(F.col(c)) for c, v in more.items()},
    }
    return decisions.withColumns(changed).drop(*_NEW)


def adjudicate(questions: DataFrame, cheap: Adjudicator, strong: Adjudicator | None = None, limits: Thresholds = DEFAULTS) -> DataFrame:
    """All columns to the cheap adjudicator; those below escalate_below, or without an answer, to the strong one."""
    blank = questions.withColumns(
        {
            "path": F.lit(None).cast("string"), "model_confidence": F.lit(0.0), "confidence": F.lit(0.0), "reasoning": F.lit(""), "notes": F.lit(None).cast("string"),
            "decided_by": F.lit("cheap" if strong else "single"), "passes": F.array().cast("array<struct<pass: string, model: string, destination_field: string, confidence: double, reasoning: string>>"),
            "repaired": F.lit(False), "tie_broken": F.lit(False), "forced_null": F.lit(None).cast("string"),
        }
    )
    done = _take(ask(blank, cheap, "adjudicate", F.lit(True)), "cheap" if strong else "single", F.col("answered"))
    if strong:
        weak = F.col("model_confidence") < limits.escalate_below
        done = _take(ask(done, strong, "escalate", weak), "escalated", F.col("answered"), decided_by=F.lit("escalated"))
    none = F.size("passes") == 0
    return done.withColumn("forced_null", F.when(none, "no adjudicator answered for this column"))


def reflect(decisions: DataFrame, dest: DataFrame, who: Adjudicator, limits: Thresholds = DEFAULTS) -> DataFrame:
    """One second look at every decision whose final confidence is below reflect_below, unmapped ones included."""
    weak = F.col("confidence") < limits.reflect_below
    again = ask(decisions, who, "reflect", weak)
    # what a reflection leaves out stays as it was
    again = again.withColumns(
        {
            "new_confidence": F.when(F.col("new_confidence") > 0, F.col("new_confidence")).otherwise(F.col("model_confidence")),
            "new_reasoning": F.when(F.col("new_reasoning") != "", F.col("new_reasoning")).otherwise(F.col("reasoning")),
            "new_notes": F.coalesce("new_notes", "notes"),
        }
    )
    return finalize(_take(again, "reflection", F.col("answered"), decided_by=F.lit("reflection")), dest, limits)


def guard_paths(decisions: DataFrame, dest: DataFrame, who: Adjudicator) -> DataFrame:
    """Paths that the collection lacks are asked for once more; if the answer is none either, the column is unmapped."""
    checked = with_dest(decisions, dest).withColumn("bad", F.col("path").isNotNull() & ~F.col("legal")).withColumn("proposed", F.col("path"))
    again = ask(checked.drop("p", "legal", "dest_type"), who, "path_retry", F.col("bad"))
    legal = dest.select("collection", F.col("path").alias("new_path"), F.lit(True).alias("retry_legal"))
    again = again.join(F.broadcast(legal), ["collection", "new_path"], "left")
    saved = F.col("bad") & F.coalesce("retry_legal", F.lit(False))
    out = _take(again, "path_retry", saved, repaired=F.lit(True)).withColumn("lost", F.col("bad") & ~F.coalesce("retry_legal", F.lit(False)))
    return out.withColumns(
        {
            "path": F.when(~F.col("lost"), F.col("path")),
            "forced_null": F.when(F.col("lost"), F.concat(F.lit("the proposed path is not in the schema: "), "proposed")).otherwise(F.col("forced_null")),
            "reasoning": F.when(F.col("lost"), "No valid path was proposed for this column, nor on a second try.").otherwise(F.col("reasoning")),
        }
    ).drop("retry_legal", "lost")


def find_collisions(mappings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Paths with several owners: path, owners in order of ``ord``. mappings: path, name, ord and the columns of ``by``."""
    owners = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"])
    return mappings.filter(F.col("path").isNotNull()).groupBy(*(by or []), "path").agg(owners.alias("owners")).filter(F.size("owners") > 1)


def resolve_collisions(decisions: DataFrame, who: Adjudicator | None = None, limits: Thresholds = DEFAULTS) -> DataFrame:
    """One column per path and table: the surest, then the earliest; two that are about as sure go to the adjudicator."""
    # columns without a path contend for nothing: each is a group of its own
    claim = F.coalesce("path", F.concat(F.lit("\0"), "name"))
    w = Window.partitionBy("table", claim).orderBy(F.col("confidence").desc(), F.col("ord"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = decisions.withColumns(
        {
            "place": F.when(F.col("path").isNotNull(), F.row_number().over(w)), "contenders": F.when(F.col("path").isNotNull(), F.count(F.lit(1)).over(whole)),
            "winner": F.first("name").over(whole), "runner": F.nth_value("name", 2).over(whole),
            "spread": F.first("confidence").over(whole) - F.nth_value("confidence", 2).over(whole),
        }
    ).withColumn("method", F.lit("confidence"))
    # confidences have two decimals, so their difference needs a little room
    tie = (F.col("contenders") == 2) & (F.col("spread") <= limits.collision_delta + 1e-9)
    if who is not None:
        questions = held.filter(tie & (F.col("place") == 1))
        said = scratch(match_answers(questions, who.answer(questions, "tiebreak")), "answers-tiebreak")
        # the answer's path names the column that keeps the path
        said = said.select("table", F.col("name").alias("winner"), F.substring_index("path", ".", -1).alias("picked"))
        held = held.join(said, ["table", "winner"], "left")
        known = (F.col("picked") == F.col("winner")) | (F.col("picked") == F.col("runner"))
        known = tie & F.coalesce(known, F.lit(False))
        held = held.withColumn("method", F.when(known, "tiebreak").otherwise(F.col("method"))).withColumn("winner", F.when(known, F.col("picked")).otherwise(F.col("winner"))).drop("picked")
    lost = (F.col("contenders") > 1) & (F.col("name") != F.col("winner"))
    held = held.withColumn("lost", F.coalesce(lost, F.lit(False))).withColumn("claimed", F.col("path"))
    return held.withColumns(
        {
            "forced_null": F.when(F.col("lost"), F.concat(F.lit("lost "), "claimed", F.lit(" to "), "winner", F.lit(" by "), "method")).otherwise(F.col("forced_null")),
            "reasoning": F.when(F.col("lost"), F.concat(F.lit("The path "), "claimed", F.lit(" holds one value and "), "winner", F.lit(" keeps it."))).otherwise(F.col("reasoning")),
            "tie_broken": F.col("tie_broken") | F.col("lost"),
            "confidence": F.when(F.col("lost"), 0.0).otherwise(F.col("confidence")),
            "path": F.when(~F.col("lost"), F.col("path")),
        }
    )


def repair_reasoning(decisions: DataFrame, who: Adjudicator | None = None) -> DataFrame:
    """Reasons that are not one sentence are rewritten by the adjudicator, if that helps, else cut to their first one."""
    bad = needs_repair(F.col("reasoning"))
    held = decisions.withColumn("reason_bad", bad)
    if who is not None:
        said = ask(held, who, "rewrite", F.col("reason_bad") & (F.trim("reasoning") != ""))
        better = F.when(F.col("answered") & ~needs_repair(F.col("new_reasoning")), F.col("new_reasoning"))
        held = said.withColumn("better", better).drop(*_NEW)
    else:
        held = held.withColumn("better", F.lit(None).cast("string"))
    fixed = F.coalesce("better", first_sentence(F.col("reasoning")))
    return held.withColumns(
        {"reasoning": F.when(F.col("reason_bad"), fixed).otherwise(F.col("reasoning")), "repaired": F.col("repaired") | F.col("reason_bad")}
    ).drop("better")


def repair_notes(decisions: DataFrame, dest: DataFrame) -> DataFrame:
    """Blank notes get the baseline of their rule; notes that miss the mechanism are replaced by it and kept as rejected."""
    held = with_dest(decisions, dest)
    held = held.withColumn("rule", mapping.rule("p")).withColumn("base", F.when(F.col("legal"), mapping.notes("p", F.col("rule"))))
    blank = F.trim(F.coalesce("notes", F.lit(""))) == ""
    wrong = F.col("base").isNotNull() & ~blank & ~mapping.notes_are_sound(F.col("rule"), F.col("notes"))
    held = held.withColumn("rejected", F.when(wrong, F.col("notes")))
    return held.withColumns(
        {
            "notes": F.when(F.col("base").isNotNull() & (blank | F.col("rejected").isNotNull()), F.col("base")).otherwise(F.col("notes")),
            "repaired": F.col("repaired") | F.col("rejected").isNotNull(),
        }
    ).drop("rule", "base", "dest_type", "p", "legal")


def repair(decisions: DataFrame, dest: DataFrame, who: Adjudicator, limits: Thresholds = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Paths, confidence, collisions, reasons, notes, in this order. Returns decisions and DIAGNOSTICS rows."""
    held = finalize(guard_paths(decisions, dest, who), dest, limits)
    held = scratch(repair_notes(repair_reasoning(resolve_collisions(held, who, limits), who), dest), "decisions")
    key = F.concat_ws(".", "table", "name")

    def rows(kind: str, when: Column, detail: Column) -> DataFrame:
        return held.filter(when).select(F.lit(kind).alias("kind"), key.alias("key"), detail.cast("string").alias("detail"))

    found = held.sparkSession.createDataFrame([], DIAGNOSTICS)
    for part in (
        rows("hallucinated_path", F.col("bad"), F.col("proposed")),
        rows("forced_null", F.col("bad") & F.col("forced_null").isNotNull() & ~F.col("lost"), F.col("forced_null")),
        rows("collision", F.col("lost"), F.concat_ws(" ", "claimed", F.lit("kept by"), "winner", F.lit("by"), "method")),
        rows("reasoning_repair", F.col("reason_bad"), F.col("reasoning")),
        rows("notes_correction", F.col("rejected").isNotNull(), F.col("rejected")),
    ):
        found = found.unionByName(part)
    clean = held.drop("bad", "proposed", "place", "contenders", "winner", "runner", "spread", "method", "lost", "claimed", "reason_bad", "rejected")
    return clean, found


def table_confidence(mean: Column, mapped: Column, total: Column) -> Column:
    """Mean confidence of a table's mappings, less up to 30 % by the share of its columns that are unmapped."""
    return F.when((mapped > 0) & (total > 0), F.round(mean * (0.7 + 0.3 * mapped / total), 2)).otherwise(0.0)
