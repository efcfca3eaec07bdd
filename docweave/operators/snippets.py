"""Retrieval of knowledge snippets by shared words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import split_identifier
from docweave.functions.tokens import core_tokens
from docweave.operators.shortlist import top_k
from docweave.sources.knowledge import Knowledge

# Weight of a tag that shares a word, and of each shared word of the text.
TAG, BODY = 2.0, 0.35


def snippet_rows(spark: SparkSession, pack: Knowledge) -> DataFrame:
    """id, tags (each as words), body (distinct words)."""
    rows = spark.createDataFrame([(i, list(t), x) for i, t, x in pack.snippets], "id string, tags array<string>, text string")
    return rows.select("id", F.transform("tags", split_identifier).alias("tags"), F.array_distinct(split_identifier(F.col("text"))).alias("body"))


def retrieve(queries: DataFrame, snippets: DataFrame, limit: int = 4) -> DataFrame:
    """queries: query, terms (words). The best snippets of each: query, id, score, rank; none for a query that shares no word.

    Only pairs that share a word are formed: words of tags and texts are the join key. Snippets may be many: Spark broadcasts
    them by their size, or shuffles.
    """
    terms = queries.select("query", F.explode(F.array_distinct(F.transform(F.filter("terms", lambda x: x != ""), F.lower))).alias("word"))
    tags = snippets.select("id", F.posexplode("tags").alias("tag", "words")).select("id", "tag", F.explode(F.array_distinct("words")).alias("word"))
    body = snippets.select("id", F.explode("body").alias("word"))
    by_tag = terms.join(tags, "word").groupBy("query", "id").agg((TAG * F.count_distinct("tag")).alias("score"))
    by_body = terms.join(body, "word").groupBy("query", "id").agg((BODY * F.count(F.lit(1))).alias("score"))
    scored = by_tag.unionByName(by_body).groupBy("query", "id").agg(F.round(F.sum("score"), 9).alias("score"))
    return top_k(scored, ["query"], "score", "id", limit, 1e-9)


def batch_terms(batch: DataFrame, pack: Knowledge) -> DataFrame:
    """Words that a batch of source fields asks for: table, batch and terms."""
    role = F.array_compact(F.array(F.when(F.col("is_pk"), "primary"), F.when(F.col("is_fk"), "foreign")))
    words = F.concat(core_tokens(F.col("name"), pack), F.coalesce(core_tokens(F.col("comment"), pack), F.array().cast("array<string>")), role)
    return batch.groupBy("table", "batch").agg(F.array_distinct(F.flatten(F.collect_list(words))).alias("terms"))
