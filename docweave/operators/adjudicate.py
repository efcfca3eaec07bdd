"""Adjudicators: whoever chooses a path from a shortlist. A model is one of them; the library brings three that need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import is_no_match
from docweave.session import prepare
from docweave.types import ANSWERS


class Adjudicator(Protocol):
    """Answers questions of a stage (adjudicate, escalate, reflect, path_retry, tiebreak, rewrite).

    questions: table, name, batch, candidates (array of path, total), and what the stage adds. Answers: ANSWERS rows; a
    question without an answer is allowed.
    """

    def answer(self, questions: DataFrame, stage: str) -> DataFrame: ...


class Deterministic:
    """The best candidate, if it reaches ``floor``, with its score and margin as confidence."""

    def __init__(self, floor: float = 0.25):
        self.floor = floor

    def answer(self, questions: DataFrame, stage: str) -> DataFrame:
        best = F.get("candidates", F.lit(0))
        second = F.coalesce(F.get("candidates", F.lit(1))["total"], F.lit(0.0))
        chosen = F.when(best["total"] >= self.floor, best["path"])
        sure = F.least(F.lit(1.0), 0.55 + 0.5 * best["total"] + F.least(best["total"] - second, F.lit(0.2)))
        reason = F.when(chosen.isNotNull(), F.concat(F.lit("Best match by names, types, keys and comments is "), chosen, F.lit("."))).otherwise(
            "No destination path is close enough by names, types, keys and comments."
        )
        return questions.select(
            "table", "name", chosen.alias("path"), F.coalesce(F.when(chosen.isNotNull(), sure), F.lit(0.0)).alias("confidence"), reason.alias("reasoning"),
            F.lit(None).cast("string").alias("notes"), F.lit("deterministic").alias("model"),
        )


class Replay:
    """Recorded answers by stage, table and name; a question without a record is an error, found by an anti-join."""

    def __init__(self, records: DataFrame, strict: bool = True):
        self.records, self.strict = records, strict

    def answer(self, questions: DataFrame, stage: str) -> DataFrame:
        own = self.records.filter(F.col("stage") == stage).drop("stage").withColumn("name", F.substring_index("name", ".", -1))
        if self.strict and (lost := questions.join(own, ["table", "name"], "left_anti").select("table", "name").first()):
            raise LookupError(f"no recorded answer of stage {stage} for {lost['table']}.{lost['name']}")
        return own.join(questions.select("table", "name"), ["table", "name"], "left_semi").select(*_NAMES)


class Scripted(Replay):
    """Answers from a list of dicts with stage, table, name and any of the other columns; other questions stay open."""

    def __init__(self, spark, rows: list[dict]):
        filled = [tuple(r.get(c, "scripted" if c == "model" else None) for c in ("stage", *_NAMES)) for r in rows]
        super().__init__(spark.createDataFrame(filled, f"stage string, {ANSWERS}"), strict=False)


class Call:
    """A function of the user's: it gets a pandas frame of questions of one batch or more and the stage, and returns answers.

    The result is materialised by the run before it is used, so a retried task is the only way to ask twice; key your
    cache on the question.
    """

    def __init__(self, function: Callable[[pd.DataFrame, str], pd.DataFrame]):
        self.function = function

    def answer(self, questions: DataFrame, stage: str) -> DataFrame:
        function = self.function

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield function(frame, stage).reindex(columns=_NAMES)

        prepare(questions.sparkSession)
        return questions.repartition("table", "batch").mapInPandas(run, ANSWERS)


_NAMES = [f.split()[0] for f in ANSWERS.split(", ")]


def match_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers to those questions: names may come qualified, "no match" is a null path, the last of several answers holds."""
    cleaned = answers.withColumn("at", F.monotonically_increasing_id()).withColumns(
        {
            "name": F.substring_index(F.trim("name"), ".", -1),
            "path": F.when(~is_no_match(F.col("path")), F.trim("path")),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "reasoning": F.trim(F.coalesce("reasoning", F.lit(""))),
        }
    )
    last = F.max_by(F.struct("path", "confidence", "reasoning", "notes", "model"), "at")
    found = cleaned.groupBy("table", "name").agg(last.alias("a")).select("table", "name", "a.*")
    return questions.select("table", "name").join(found, ["table", "name"])


def batches(fields: DataFrame, size: int) -> DataFrame:
    """Consecutive batches of ``size`` columns of a table, from 0."""
    w = Window.partitionBy("table").orderBy("ord")
    return fields.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
