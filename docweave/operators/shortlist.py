"""Candidate paths for every column: tokens once per field, an equi-join by routed collection, windowed top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.similarity import containment, lexical, overlap, with_ratio
from docweave.functions.text import bson_category, is_enum_code, lookup, sql_category
from docweave.functions.tokens import concept_tokens, core_tokens, flat
from docweave.session import prepare
from docweave.sources.knowledge import Knowledge, default_pack
from docweave.types import DEFAULTS, TYPE_DEFAULT, TYPE_MATRIX, Thresholds

# Weights of the components of a score, and of an embedding's similarity if there is one.
WEIGHTS = {"lexical": 0.38, "fuzzy": 0.12, "type_compat": 0.20, "key_role": 0.14, "comment": 0.16}
EMBEDDING_WEIGHT = 0.15


def source_tokens(fields: DataFrame, pack: Knowledge) -> DataFrame:
    """Source fields with everything that a comparison needs, worked out once per field."""
    return (
        fields.withColumn("core", core_tokens(F.col("name"), pack))
        .withColumn("concepts", concept_tokens(F.col("core"), pack))
        .withColumn("comment_core", F.when(F.length("comment") > 0, core_tokens(F.col("comment"), pack)))
        .withColumn("flat", flat(F.col("name")))
        .withColumn("category", sql_category(F.col("sql_type")))
        .withColumn("is_code", is_enum_code(F.col("sql_type"), F.col("comment")))
    )


def dest_tokens(fields: DataFrame, pack: Knowledge) -> DataFrame:
    leaf = F.substring_index("path", ".", -1)
    return (
        fields.withColumn("leaf", leaf)
        .withColumn("is_ref", (F.col("bson_type") == "ObjectId") & (F.col("path") != "_id"))
        .withColumn("category", bson_category(F.col("bson_type")))
        .withColumn("core", core_tokens(F.col("path"), pack))
        .withColumn("concepts", concept_tokens(F.col("core"), pack))
        .withColumn("comment_core", F.when(F.length("comment") > 0, core_tokens(F.col("comment"), pack)))
        .withColumn("leaf_flat", flat(F.col("leaf")))
        .withColumn("path_flat", flat(F.col("path")))
    )


def type_compatibility(source: Column, dest: Column, is_code: Column) -> Column:
    """How plausible a move of one category to another is; a code column suits a string or, less well, a Boolean."""
    table = {f"{a}>{b}": v for a, to in TYPE_MATRIX.items() for b, v in to.items()}
    return (
        F.when(is_code & (dest == "string"), 1.0).when(is_code & (dest == "boolean"), 0.65)
        .otherwise(lookup(F.concat_ws(">", source, dest), table, F.lit(TYPE_DEFAULT)))
    )


def key_role_score(is_pk, is_fk, is_unique, path, leaf, is_ref, same_target) -> Column:
    """How well keys suit a path; ``same_target``: the foreign key's table is routed to the collection that the path refers to."""
    own_id = path == "_id"
    return (
        F.when(is_pk, F.when(own_id, 1.0).when(is_ref, 0.35).otherwise(0.15))
        .when(is_fk, F.when(is_ref & same_target, 1.0).when(is_ref, 0.70).when(own_id, 0.20).otherwise(0.10))
        .when(own_id, 0.0)
        .when(is_unique & F.lower(leaf).endswith("code"), 0.85)
        .when(is_ref, 0.10)
        .otherwise(0.40)
    )


def comment_score(s: str, d: str) -> Column:
    own = F.col(f"{s}.comment_core")
    by_comment = F.when(F.col(f"{d}.comment_core").isNotNull(), overlap(own, F.col(f"{d}.comment_core"))).otherwise(0.0)
    found = F.greatest(by_comment, 0.6 * containment(own, F.col(f"{d}.core")))
    return F.when(own.isNull(), 0.0).otherwise(F.least(F.lit(1.0), found))


def compare(pairs: DataFrame) -> DataFrame:
    """Adds lexical, fuzzy and comment to pairs with structs s (source_tokens) and d (dest_tokens)."""
    prepare(pairs.sparkSession)
    s, d = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"d.{c}"))
    pairs = pairs.withColumns({"sf": s("flat"), "lf": d("leaf_flat"), "pf": d("path_flat")})
    pairs = with_ratio(with_ratio(pairs, "sf", "lf", "by_leaf"), "sf", "pf", "by_path")
    return pairs.withColumns(
        {
            "lexical": lexical(s("core"), s("concepts"), d("core"), d("concepts")),
            "fuzzy": F.greatest("by_leaf", "by_path"),
            "comment": comment_score("s", "d"),
        }
    ).drop("sf", "lf", "pf", "by_leaf", "by_path")


def _packed(fields: DataFrame, name: str, *keys: str) -> DataFrame:
    return fields.select(*keys, F.struct(*fields.columns).alias(name))


def score_pairs(source: DataFrame, dest: DataFrame, routing: DataFrame, pack: Knowledge | None = None, embeddings: DataFrame | None = None) -> DataFrame:
    """Every column against every path of its table's collection: table, name, collection, path, scores, total.

    source, dest: field rows; routing: table, collection. embeddings: table, name, path, similarity (optional).
    """
    pack = pack or default_pack()
    routes = routing.select("table", "collection")
    targets = routes.select(F.col("table").alias("of"), F.col("collection").alias("to"))
    s = source_tokens(source, pack).join(F.broadcast(targets), F.substring_index("references", ".", 1) == F.col("of"), "left").drop("of")
    pairs = _packed(s, "s", "table").join(F.broadcast(routes), "table").join(_packed(dest_tokens(dest, pack), "d", "collection"), "collection")
    pairs = compare(pairs)
    same = F.coalesce(F.col("s.to") == F.substring_index("d.references", ".", 1), F.lit(False))
    pairs = pairs.withColumns(
        {
            "type_compat": type_compatibility(F.col("s.category"), F.col("d.category"), F.col("s.is_code")),
            "key_role": key_role_score(F.col("s.is_pk"), F.col("s.is_fk"), F.col("s.is_unique"), F.col("d.path"), F.col("d.leaf"), F.col("d.is_ref"), same),
        }
    )
    total = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    keys = [F.col("s.table").alias("table"), F.col("s.name").alias("name"), "collection", F.col("d.path").alias("path")]
    scored = pairs.select(*keys, F.col("s.table_ord").alias("table_ord"), F.col("s.ord").alias("ord"), *WEIGHTS, total.alias("total"))
    if embeddings is not None:
        scored = scored.join(embeddings.select("table", "name", "path", F.col("similarity").alias("embedding")), ["table", "name", "path"], "left")
        mixed = F.col("total") * (1 - EMBEDDING_WEIGHT) + EMBEDDING_WEIGHT * F.col("embedding")
        scored = scored.withColumn("total", F.coalesce(mixed, "total"))
    else:
        scored = scored.withColumn("embedding", F.lit(None).cast("double"))
    return scored.withColumn("total", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "total")))


def top_k(scored: DataFrame, by: list[str], score: str, tie: str, k: int, floor: float) -> DataFrame:
    """The k best rows of each group from the floor on, as rank 1 to k. Spark keeps k rows per group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).asc())
    return scored.filter(F.col(score) >= floor).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def shortlist(source, dest, routing, pack=None, limits: Thresholds = DEFAULTS, embeddings=None) -> DataFrame:
    """The top_k candidates of every column; columns without any have no rows."""
    return top_k(score_pairs(source, dest, routing, pack, embeddings), ["table", "name"], "total", "path", limits.top_k, limits.floor)


def margin(score: Column, rival: Column) -> Column:
    """How clearly a candidate won: half its score, half its lead, of which 0.20 is as good as more; without a rival score + 0.25."""
    lead = 0.5 * score + 0.5 * F.least(score - rival, F.lit(0.20)) / 0.20
    return F.when(score.isNull(), 0.0).when(rival.isNull(), F.least(F.lit(1.0), score + 0.25)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), lead)))


def with_margin(candidates: DataFrame, by: list[str], score: str) -> DataFrame:
    """Each candidate's margin against the best other one of its group."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col("rank"))
    ranked = candidates.withColumns(
        {
            "place": F.row_number().over(w),
            "best": F.first(score).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            "second": F.nth_value(score, 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    rival = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("best"))
    return ranked.withColumn("margin", margin(F.col(score), rival)).drop("place", "best", "second")
