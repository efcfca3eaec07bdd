"""Schema files and texts as DataFrames with a row per field."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.ddl import parse_ddl
from docweave.sources.json_schema import parse_collections, parse_documents, parse_tables
from docweave.types import DEST_FIELDS, SOURCE_FIELDS, SchemaError

#: Longest schema text that is accepted, in characters.
MAX_CHARS = 200_000


def detect_format(text: str, filename: str = "") -> str:
    """mysql_ddl, mysql_json, mongo_json or mongo_documents."""
    if filename.lower().endswith(".sql"):
        return "mysql_ddl"
    if not text.lstrip().startswith("{"):
        if "CREATE TABLE" in text.upper():
            return "mysql_ddl"
        raise SchemaError("This is neither JSON nor CREATE TABLE statements.")
    try:
        payload = json.loads(text)
    except json.JSONDecodeError as e:
        raise SchemaError(f"The JSON breaks at line {e.lineno}, column {e.colno}: {e.msg}") from e
    if "tables" in payload:
        return "mysql_json"
    if "collections" in payload:
        first = next((v for k, v in payload["collections"].items() if not k.startswith("_")), None)
        return "mongo_documents" if isinstance(first, list) else "mongo_json"
    raise SchemaError("A JSON schema has 'tables' or 'collections'.")


def _guard(text: str) -> str:
    if len(text) > MAX_CHARS:
        raise SchemaError(f"The schema has {len(text)} characters; {MAX_CHARS} is the limit.")
    return text


def source_fields(spark: SparkSession, text: str, filename: str = "") -> DataFrame:
    """Columns of a relational schema, in any of its written forms, as SOURCE_FIELDS rows."""
    kind = detect_format(_guard(text), filename)
    if kind == "mysql_ddl":
        database, tables = parse_ddl(text)
        dialect = "MySQL (Relational)"
    elif kind == "mysql_json":
        database, dialect, tables = parse_tables(json.loads(text))
    else:
        raise SchemaError(f"This looks like {kind}, which is no relational schema.")
    rows = [
        (database, dialect, t, i, j, c.name, c.sql_type, c.base_type, c.nullable, c.is_pk, c.is_fk, c.is_unique, c.references, c.comment)
        for i, (t, columns) in enumerate(tables.items())
        for j, c in enumerate(columns)
    ]
    return spark.createDataFrame(rows, SOURCE_FIELDS)


def dest_fields(spark: SparkSession, text: str, filename: str = "") -> DataFrame:
    """Leaf paths of a document schema, in any of its written forms, as DEST_FIELDS rows."""
    kind = detect_format(_guard(text), filename)
    if kind not in ("mongo_json", "mongo_documents"):
        raise SchemaError(f"This looks like {kind}, which is no document schema.")
    database, dialect, found = (parse_collections if kind == "mongo_json" else parse_documents)(json.loads(text))
    rows = [(database, dialect, c, i, j, x.path, x.bson_type, x.comment, x.references) for i, (c, xs) in enumerate(found.items()) for j, x in enumerate(xs)]
    return spark.createDataFrame(rows, DEST_FIELDS)


def read_text(spark: SparkSession, path: str) -> str:
    """A schema file's text, from any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_source(spark: SparkSession, path: str) -> DataFrame:
    return source_fields(spark, read_text(spark, path), path.rpartition("/")[2])


def read_dest(spark: SparkSession, path: str) -> DataFrame:
    return dest_fields(spark, read_text(spark, path), path.rpartition("/")[2])


def fingerprints(rows: DataFrame, by: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """by, fingerprint: 16 hex digits over a canonical form of each group's rows, columns ``cols`` in the order of ``order``."""
    line = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    held = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), line.alias("line"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(held, lambda x: x["line"]), ","), F.lit("]"))
    return rows.groupBy(*by).agg(F.left(F.sha2(text, 256), F.lit(16)).alias("fingerprint"))


def source_fingerprint(fields: DataFrame) -> str:
    """16 hex digits that are the same for the DDL and the JSON form of a schema."""
    role = F.when(F.col("is_pk"), "PK").when(F.col("is_fk"), "FK").when(F.col("is_unique"), "UNIQUE").otherwise("")
    cols = ["table", "name", "sql_type", "nullable", "role", "references", "comment"]
    return fingerprints(fields.withColumn("role", role), [], ["table_ord", "ord"], cols).first()["fingerprint"]


def dest_fingerprint(fields: DataFrame) -> str:
    return fingerprints(fields, [], ["coll_ord", "ord"], ["collection", "path", "bson_type", "references", "comment"]).first()["fingerprint"]


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Schema files of a folder: name, bytes, side (source or destination, by the name)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,sql}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    side = F.when(F.lower(name).rlike("mysql|ddl"), "source").otherwise("destination")
    return files.select(name.alias("name"), F.col("length").alias("bytes"), side.alias("side"))


def sample_rows(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of one table from a JSON file that holds an array of objects per table."""
    found = spark.read.json(path, multiLine=True)
    return found.select(F.explode(F.col(f"`{table}`")).alias("row")).select("row.*")


def latest_mapping(spark: SparkSession, *folders: str) -> str | None:
    """Path of the newest mapping_*.json in the first folder that has one."""
    for folder in folders:
        try:
            files = spark.read.format("binaryFile").option("pathGlobFilter", "mapping_*_to_*.json").load(folder)
            if row := files.select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path").first():
                return row["path"]
        except Exception as e:  # a folder that is not there
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return None
