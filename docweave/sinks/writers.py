"""Where results go: mapping documents, reports, call records and caches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.assemble import to_json

HISTORY = 25
RUNS = "run_id string, started_at string, duration_ms long, mapping string, ok boolean, calls long"


def mapping_name(document: DataFrame) -> str:
    """mapping_<source>_to_<destination>.json"""
    r = document.select(F.substring_index("source", " ", 1).alias("s"), F.substring_index("destination", " ", 1).alias("d")).first()
    return f"mapping_{r['s']}_to_{r['d']}.json"


def mapping_text(document: DataFrame) -> str:
    """Indented JSON; a mapping has a row per column of a schema, so the driver holds it."""
    return json.dumps(json.loads(to_json(document).first()["value"]), indent=2, ensure_ascii=False) + "\n"


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Any report table as JSON lines, nulls included, to any store that Spark writes to."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file in any store that Spark writes to."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_document(document: DataFrame, path: str) -> None:
    to_json(document).coalesce(1).write.mode("overwrite").text(path)


def record_calls(calls: DataFrame, path: str) -> None:
    """Append recorded calls or cached answers; read_answers() finds them again."""
    calls.write.mode("append").json(path)


def cached(questions: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Questions that the cache answers, with its columns, and those that it does not."""
    return questions.join(cache, key), questions.join(cache.select(key), key, "left_anti")


def persist_run(run, folder: str) -> str:
    """A run's mapping, report tables, calls, prompts and events under folder/<run id>, and its row in folder/runs. Returns its folder.

    Any store that Spark writes to; list_runs() finds it again, also after another driver has written it.
    """
    spark, home = run.document.sparkSession, f"{folder.rstrip('/')}/{run.run_id}"
    write_document(run.document, f"{home}/mapping")
    for name, table in {**run.report(), "calls": run.calls, "prompts": run.log.trace(spark), "events": run.progress.frame(spark)}.items():
        write_json(table, f"{home}/{name}")
    row = (run.run_id, run.started_at, run.duration_ms, mapping_name(run.document), run.ok, len(run.log.rows))
    write_json(spark.createDataFrame([row], RUNS).coalesce(1), f"{folder.rstrip('/')}/runs", "append")
    return home


def list_runs(spark: SparkSession, folder: str, limit: int = HISTORY) -> DataFrame:
    """The newest persisted runs, newest first."""
    return history(spark.read.schema(RUNS).json(f"{folder.rstrip('/')}/runs"), limit)


def history(runs: DataFrame, limit: int = HISTORY) -> DataFrame:
    """The newest runs, newest first."""
    return runs.orderBy(F.desc("started_at"), "run_id").limit(limit)
