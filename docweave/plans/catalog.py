"""Catalogue of the library's queries, each with its DuckDB twin where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.functions.similarity import lexical, overlap_of, with_ratio
from docweave.operators import adjudicate, assemble, coverage, decisions, evaluation, ledger, migrate, pairing, prompts, routing, shortlist, snippets
from docweave.operators.extract_json import extract_json
from docweave.plans import parts, tpch  # noqa: F401  parts registers its queries
from docweave.plans.registry import QUERIES, SQL, query
from docweave.plans.run import compile_mapping, map_schemas
from docweave.sinks import writers
from docweave.sources import inference, reader
from docweave.streaming.progress import last_by_key
from docweave.types import MAPPING_DOCUMENT, TYPE_DEFAULT, TYPE_MATRIX


def _flat(df: DataFrame, **names: str) -> DataFrame:
    """Leaves of a document by their dot paths, renamed."""
    flat = migrate.flatten(df)
    return flat.select(*(F.col(f"`{path}`").alias(name) for name, path in names.items()))


# ---- value transforms over whole tables


@query("SELECT c_custkey, left(sha1('customer:' || c_custkey), 24) AS oid FROM customer")
def xf_pk_objectid(t, spark):
    done = migrate.migrate(t("customer"), tpch.CUSTOMER[:1], ["c_custkey"])
    return done.select("c_custkey", F.col("document._id.$oid").alias("oid"))


@query("SELECT c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def xf_fk_objectid_join(t, spark):
    orders = migrate.migrate(t("orders").select("o_custkey"), tpch.ORDERS).select(F.col("document.customer.customerId.$oid").alias("oid"))
    customers = migrate.migrate(t("customer").select("c_custkey", "c_mktsegment"), tpch.CUSTOMER[:1], ["c_mktsegment"])
    customers = customers.select("c_mktsegment", F.col("document._id.$oid").alias("oid"))
    return orders.join(customers, "oid").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending' ELSE o_orderstatus END AS status FROM orders")
def xf_code_to_enum(t, spark):
    return migrate.migrate(t("orders"), tpch.ORDERS[2:3], ["o_orderkey"]).select("o_orderkey", "document.status")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status,
       o_orderstatus NOT IN ('F', 'O') AS manual FROM orders""")
def xf_code_to_enum_unknown(t, spark):
    pair = tpch.field("orders", "o_orderstatus", "CHAR(1)", "status", "String", comment="F=Finished, O=Open")
    done = migrate.migrate(t("orders"), [pair], ["o_orderkey"])
    return done.select("o_orderkey", "document.status", F.col("annotations")[0]["manual"].alias("manual"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS line, l_linestatus = 'O' AS is_open, l_returnflag = 'R' AS is_returned,
       (l_returnflag NOT IN ('R', 'A'))::BIGINT AS manual FROM lineitem""")
def xf_code_to_boolean(t, spark):
    pairs = [
        tpch.field("lineitem", "l_linestatus", "CHAR(1)", "isOpen", "Boolean", comment="O=Open, F=Finished"),
        tpch.field("lineitem", "l_returnflag", "CHAR(1)", "isReturned", "Boolean", comment="R=Returned, A=Accepted, N=New"),
    ]
    done = migrate.migrate(t("lineitem"), pairs, ["l_orderkey", "l_linenumber"])
    return done.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("document.isOpen").alias("is_open"), F.col("document.isReturned").alias("is_returned"),
        migrate.manual_count().alias("manual"),
    )


@query("SELECT doc_id, toxic <> 0 AS is_toxic FROM labels")
def xf_int_bool(t, spark):
    pair = tpch.field("labels", "toxic", "TINYINT(1)", "isToxic", "Boolean")
    return migrate.migrate(t("labels"), [pair], ["doc_id"]).select("doc_id", F.col("document.isToxic").alias("is_toxic"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS price FROM orders")
def xf_decimal_number(t, spark):
    exact = t("orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(12,2)"))
    return migrate.migrate(exact, tpch.ORDERS[3:4], ["o_orderkey"]).select("o_orderkey", F.col("document.total.price").alias("price"))


@query("SELECT p_partkey, p_size::BIGINT AS size FROM part")
def xf_int_number(t, spark):
    pair = tpch.field("part", "p_size", "INT", "size", "Number")
    return migrate.migrate(t("part"), [pair], ["p_partkey"]).select("p_partkey", "document.size")


@query("SELECT p_partkey, p_name AS name FROM part")
def xf_string(t, spark):
    pair = tpch.field("part", "p_name", "VARCHAR(55)", "name", "String")
    return migrate.migrate(t("part"), [pair], ["p_partkey"]).select("p_partkey", "document.name")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders")
def xf_isodate(t, spark):
    whole = t("orders").withColumn("o_orderdate", F.date_trunc("second", "o_orderdate").cast("timestamp_ntz"))
    return migrate.migrate(whole, tpch.ORDERS[4:5], ["o_orderkey"]).select("o_orderkey", F.col("document.dates.orderDate.$date").alias("at"))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
       WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'day ' || o_orderkey END AS x FROM orders)
SELECT o_orderkey, coalesce(strftime(coalesce(try_strptime(x, '%Y-%m-%d %H:%M:%S'), try_strptime(x, '%Y-%m-%dT%H:%M:%S'), try_strptime(x, '%Y-%m-%d')),
       '%Y-%m-%dT%H:%M:%SZ'), x) AS at FROM s""")
def xf_isodate_strings(t, spark):
    k, at = F.col("o_orderkey") % 4, lambda f: F.date_format("o_orderdate", f)
    written = F.when(k == 0, at("yyyy-MM-dd HH:mm:ss")).when(k == 1, at("yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, at("yyyy-MM-dd"))
    strings = t("orders").select("o_orderkey", F.coalesce(written, F.concat(F.lit("day "), F.col("o_orderkey").cast("string"))).alias("o_orderdate"))
    return migrate.migrate(strings, tpch.ORDERS[4:5], ["o_orderkey"]).select("o_orderkey", F.col("document.dates.orderDate.$date").alias("at"))


@query("""SELECT left(sha1('orders:' || o_orderkey), 24) AS id, left(sha1('customer:' || o_custkey), 24) AS customer_id,
       CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending' ELSE o_orderstatus END AS status, o_totalprice AS price,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ordered_at, o_orderpriority AS priority FROM orders""")
def xf_build_document(t, spark):
    whole = t("orders").withColumn("o_orderdate", F.date_trunc("second", "o_orderdate").cast("timestamp_ntz"))
    done = migrate.migrate(whole, tpch.ORDERS)
    return _flat(done, id="_id.$oid", customer_id="customer.customerId.$oid", status="status", price="total.price", ordered_at="dates.orderDate.$date", priority="priority")


@query("""SELECT path, rule, count(*) AS n, sum(CASE WHEN rule LIKE '%objectid' THEN 1 ELSE 0 END)::BIGINT AS manual FROM orders,
       (VALUES ('_id', 'pk_to_objectid'), ('customer.customerId', 'fk_to_objectid'), ('status', 'code_to_enum_string'), ('total.price', 'decimal_to_number'),
       ('dates.orderDate', 'datetime_to_isodate'), ('priority', 'string_to_string')) v(path, rule) GROUP BY path, rule""")
def xf_annotations(t, spark):
    done = migrate.migrate(t("orders"), tpch.ORDERS).select(F.explode("annotations").alias("a"))
    return done.groupBy("a.path", "a.rule").agg(F.count(F.lit(1)).alias("n"), F.count_if("a.manual").alias("manual"))


@query("SELECT o_orderkey, c_name AS customer_name, c_mktsegment AS customer_segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def xf_denormalize(t, spark):
    done = migrate.denormalize(t("orders"), "o_custkey", t("customer"), "c_custkey", {"c_name": "customer_name", "c_mktsegment": "customer_segment"})
    return done.select("o_orderkey", "customer_name", "customer_segment")


# ---- names, types and texts

_SPLIT_SQL = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda x: x <> '')"


@query(f"SELECT token, count(*) AS n FROM (SELECT lower(unnest({_SPLIT_SQL.format('url')})) AS token FROM pages) GROUP BY token")
def tok_split_identifier(t, spark):
    words = t("pages").select(F.explode(tx.split_identifier(F.col("url"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_TYPES = [("DECIMAL(12, 2)",), ("TINYINT(1)",), ("tinyint",), ("varchar(20)",), ("CHAR(1)",), ("BIT(1)",), ("DATETIME",), ("json",), ("POINT",), ("BOOL",), ("YEAR(4)",)]


@query("""SELECT * FROM (VALUES ('DECIMAL(12, 2)', 'DECIMAL', 2::BIGINT, 'decimal', 'DECIMAL(12,2)'), ('TINYINT(1)', 'TINYINT', 1, 'boolean', 'TINYINT(1)'),
       ('tinyint', 'TINYINT', 0, 'integer', 'TINYINT'), ('varchar(20)', 'VARCHAR', 1, 'string', 'VARCHAR'), ('CHAR(1)', 'CHAR', 1, 'string', 'CHAR(1)'),
       ('BIT(1)', 'BIT', 1, 'string', 'BIT(1)'), ('DATETIME', 'DATETIME', 0, 'datetime', 'DATETIME'), ('json', 'JSON', 0, 'object', 'JSON'),
       ('POINT', 'POINT', 0, 'string', 'POINT'), ('BOOL', 'BOOL', 0, 'boolean', 'BOOL'), ('YEAR(4)', 'YEAR', 1, 'integer', 'YEAR')) v(sql_type, base, args, category, label)""")
def sql_types(t, spark):
    c = F.col("sql_type")
    rows = spark.createDataFrame(_TYPES, "sql_type string")
    return rows.select("sql_type", tx.base_type(c).alias("base"), F.size(tx.type_args(c)).cast("long").alias("args"), tx.sql_category(c).alias("category"), tx.source_label(c).alias("label"))


_SCORES = ", ".join(f"('{a}', '{b}', {v})" for a, to in TYPE_MATRIX.items() for b, v in to.items())


@query(f"""WITH s(source) AS (VALUES ('integer'), ('decimal'), ('string'), ('date'), ('datetime'), ('boolean'), ('object'), ('binary')),
       d(dest) AS (VALUES ('number'), ('objectid'), ('string'), ('boolean'), ('datetime'), ('object'), ('array')), c(is_code) AS (VALUES (true), (false)),
       m(a, b, v) AS (VALUES {_SCORES})
SELECT source, dest, is_code, CASE WHEN is_code AND dest = 'string' THEN 1.0 WHEN is_code AND dest = 'boolean' THEN 0.65 ELSE coalesce(v, {TYPE_DEFAULT}) END::DOUBLE AS score
FROM s, d, c LEFT JOIN m ON a = source AND b = dest""")
def type_matrix(t, spark):
    make = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} {'boolean' if name == 'is_code' else 'string'}")
    rows = make("source", "integer decimal string date datetime boolean object binary".split())
    rows = rows.crossJoin(make("dest", "number objectid string boolean datetime object array".split())).crossJoin(make("is_code", (True, False)))  # 112 rows
    return rows.withColumn("score", shortlist.type_compatibility(F.col("source"), F.col("dest"), F.col("is_code")))


@query("""WITH k(is_pk, is_fk, is_unique) AS (VALUES (true, false, false), (false, true, false), (false, false, true), (false, false, false)),
       p(path, is_ref) AS (VALUES ('_id', false), ('a.bId', true), ('a.itemCode', false), ('a.b', false)), s(same) AS (VALUES (true), (false))
SELECT is_pk, is_fk, is_unique, path, same, CASE WHEN is_pk THEN CASE WHEN path = '_id' THEN 1.0 WHEN is_ref THEN 0.35 ELSE 0.15 END
       WHEN is_fk THEN CASE WHEN is_ref AND same THEN 1.0 WHEN is_ref THEN 0.7 WHEN path = '_id' THEN 0.2 ELSE 0.1 END WHEN path = '_id' THEN 0.0
       WHEN is_unique AND path LIKE '%Code' THEN 0.85 WHEN is_ref THEN 0.1 ELSE 0.4 END::DOUBLE AS score FROM k, p, s""")
def key_role(t, spark):
    keys = spark.createDataFrame([(True, False, False), (False, True, False), (False, False, True), (False, False, False)], "is_pk boolean, is_fk boolean, is_unique boolean")
    paths = spark.createDataFrame([("_id", False), ("a.bId", True), ("a.itemCode", False), ("a.b", False)], "path string, is_ref boolean")
    rows = keys.crossJoin(paths).crossJoin(spark.createDataFrame([(True,), (False,)], "same boolean"))  # 32 rows
    c = F.col
    score = shortlist.key_role_score(c("is_pk"), c("is_fk"), c("is_unique"), c("path"), F.substring_index("path", ".", -1), c("is_ref"), c("same"))
    return rows.select("is_pk", "is_fk", "is_unique", "path", "same", score.alias("score"))


def _overlap_sql(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE 0.7 * len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) "
            f"+ 0.3 * len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END")  # fmt: skip


@query(f"""WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b,
       list_distinct(string_split(lower(p_brand), '#')) AS x FROM part),
o AS (SELECT *, {_overlap_sql('a', 'b')} AS core, least(1.0, (len(list_intersect(x, b)) + len(list_intersect(a, x)) + 0.5 * len(x)) / greatest(1, least(len(a), len(b)))) AS concept FROM w)
SELECT p_partkey, round(least(1.0, core + 0.35 * concept * (1 - core)), 6) AS score FROM o""")
def lexical_score(t, spark):
    words = lambda c, by: F.array_distinct(F.split(F.lower(c), by))
    rows = t("part").select("p_partkey", words("p_name", " ").alias("a"), words("p_type", " ").alias("b"), words("p_brand", "#").alias("x"))
    return rows.select("p_partkey", F.round(lexical(F.col("a"), F.col("x"), F.col("b"), F.col("x")), 6).alias("score"))


_WORDS = "[^a-z0-9]+"


def _shared(t) -> DataFrame:
    """Documents against benchmark items by shared words: containment and Jaccard of every pair that shares one."""
    words = lambda df, key: df.select(key, F.array_distinct(F.filter(F.split(F.lower("text"), _WORDS), lambda x: x != "")).alias("w"))
    d, b = words(t("documents"), "doc_id"), words(t("benchmark"), "item_id")
    d, b = (x.select(x.columns[0], F.size("w").alias(f"n_{x.columns[0][0]}"), F.explode("w").alias("word")) for x in (d, b))
    pairs = d.join(b, "word").groupBy("doc_id", "item_id", "n_d", "n_i").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("doc_id", "item_id", F.round(overlap_of(F.col("n"), F.col("n_d"), F.col("n_i")), 9).alias("score"))


_SHARED_SQL = """WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents),
b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS n_d, unnest(w) AS word FROM d), bw AS (SELECT item_id, len(w) AS n_i, unnest(w) AS word FROM b),
p AS (SELECT doc_id, item_id, n_d, n_i, count(*)::DOUBLE AS n FROM dw JOIN bw USING (word) GROUP BY ALL),
s AS (SELECT doc_id, item_id, round(0.7::DOUBLE * n / least(n_d, n_i) + 0.3::DOUBLE * n / (n_d + n_i - n), 9) AS score FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM s WHERE score >= 0.15 QUALIFY rank <= 6)
"""


@query(_SHARED_SQL + "SELECT doc_id, item_id, score, rank FROM k")
def tok_overlap_topk(t, spark):
    return shortlist.top_k(_shared(t), ["doc_id"], "score", "item_id", 6, 0.15)


@query(_SHARED_SQL + """SELECT doc_id, item_id, round(CASE WHEN second IS NULL THEN least(1.0, score + 0.25)
       ELSE greatest(0.0, least(1.0, 0.5 * score + 0.5 * least(score - second, 0.2) / 0.2)) END, 6)::DOUBLE AS margin
FROM (SELECT *, lead(score) OVER (PARTITION BY doc_id ORDER BY rank) AS second FROM k) WHERE rank = 1""")
def tok_margin(t, spark):
    best = shortlist.top_k(_shared(t), ["doc_id"], "score", "item_id", 6, 0.15)
    return shortlist.with_margin(best, ["doc_id"], "score").filter("rank = 1").select("doc_id", "item_id", F.round("margin", 6).alias("margin"))


@query(_SHARED_SQL + """, truth AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents)
SELECT count(*) AS pairs, round(avg((coalesce(rank <= 6, false))::INT), 6) AS recall_at_k, round(avg((coalesce(rank = 1, false))::INT), 6) AS rank_at_1,
       round(avg(rank), 6) AS mean_rank, min(score) AS min_true_score FROM truth LEFT JOIN k USING (doc_id, item_id)""")
def recall_at_k(t, spark):
    n = t("benchmark").count()
    truth = t("documents").select(F.lit("documents").alias("table"), F.col("doc_id").alias("name"), (F.col("doc_id") % n).alias("path"))
    found = shortlist.top_k(_shared(t), ["doc_id"], "score", "item_id", 6, 0.15)
    found = found.select(F.lit("documents").alias("table"), F.col("doc_id").alias("name"), F.col("item_id").alias("path"), "rank", F.col("score").alias("total"))
    rows = evaluation.recall(truth, found, 6)
    return rows.select("pairs", *(F.round(c, 6).alias(c) for c in ("recall_at_k", "rank_at_1", "mean_rank")), "min_true_score")


@query("""WITH q AS (SELECT conv_id || '/' || turn AS query, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM conversations),
qw AS (SELECT query, unnest(w) AS word FROM q),
s AS (SELECT item_id::VARCHAR AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark),
tags AS (SELECT id, w[1] AS word FROM s), body AS (SELECT id, unnest(list_distinct(w)) AS word FROM s),
u AS (SELECT query, id, 2.0::DOUBLE AS v FROM qw JOIN tags USING (word) UNION ALL SELECT query, id, 0.35::DOUBLE FROM qw JOIN body USING (word)),
r AS (SELECT query, id, round(sum(v), 9) AS score FROM u GROUP BY query, id)
SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= 4""")
def snippet_retrieve(t, spark):
    words = F.filter(F.split(F.lower("text"), _WORDS), lambda x: x != "")
    asked = t("conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query"), words.alias("terms"))
    known = t("benchmark").select(F.col("item_id").cast("string").alias("id"), words.alias("w"))
    known = known.select("id", F.array(F.slice("w", 1, 1)).alias("tags"), F.array_distinct("w").alias("body"))
    return snippets.retrieve(asked, known, 4)


_NO_STOPS = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, 'e.g.', 'e_g_'), 'i.e.', 'i_e_'), 'etc.', 'etc_'), 'vs.', 'vs_'), 'approx.', 'approx_'), 'cf.', 'cf_'), 'ca.', 'ca_'), 'no.', 'no_'), 'al.', 'al_'), 'ISO 4217.', 'ISO 4217_')"
_SENTENCES = "len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(" + _NO_STOPS + ", '([0-9])\\.([0-9])', '\\1_\\2', 'g'), '([0-9])\\.([0-9])', '\\1_\\2', 'g'), '[.!?]+(?:\\s+|$)'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> ''))"


@query(f"SELECT doc_id, {_SENTENCES.format('text')} AS sentences FROM documents")
def count_sentences(t, spark):
    return t("documents").select("doc_id", tx.count_sentences(F.col("text")).alias("sentences"))


@query(f"""WITH b AS (SELECT item_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM benchmark),
f AS (SELECT *, CASE WHEN instr(c, '. ') > 0 THEN c[:instr(c, '. ')] WHEN instr(c, '! ') > 0 THEN c[:instr(c, '! ')] WHEN instr(c, '? ') > 0 THEN c[:instr(c, '? ')] ELSE c END AS s FROM b),
g AS (SELECT *, CASE WHEN length(s) > 260 THEN regexp_replace(s[:259], ' [^ ]*$', '') || '.' ELSE s END AS y FROM f)
SELECT item_id, x = '' OR {_SENTENCES.format('x')} > 1 OR length(x) > 260 OR contains(x, chr(10)) AS bad,
       CASE WHEN right(y, 1) IN ('.', '!', '?') THEN y ELSE y || '.' END AS reason FROM g""")
def reasoning_repair(t, spark):
    c = F.col("text")
    return t("benchmark").select("item_id", tx.needs_repair(c).alias("bad"), tx.first_sentence(c).alias("reason"))


@query("""SELECT * FROM (VALUES (1::BIGINT, 'A', 'Active', 0::BIGINT), (1, 'I', 'Inactive', 1), (1, 'T', 'Terminated', 2), (2, 'Y', 'Again', 0), (2, 'N', 'No', 1), (3, 'F', 'a=b', 0)) v(id, code, label, place)""")
def legend_parse(t, spark):
    rows = spark.createDataFrame([(1, "A=Active, I=Inactive; T=Terminated"), (2, "Y=Yes/N=No/Y=Again"), (3, "F=a=b, XX=two, Z="), (4, "no legend"), (5, None)], "id long, comment string")
    found = rows.select("id", F.posexplode(tx.code_legend(F.col("comment"))).alias("place", "c"))
    return found.select("id", "c.code", "c.label", F.col("place").cast("long").alias("place"))


# ---- decisions, validation, cost


@query("SELECT p_name AS path, count(*) AS owners, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS names FROM part GROUP BY p_name HAVING count(*) > 1")
def collisions(t, spark):
    rows = t("part").select(F.col("p_name").alias("path"), F.col("p_partkey").cast("string").alias("name"), F.col("p_partkey").alias("ord"))
    return decisions.find_collisions(rows).select("path", F.size("owners").cast("long").alias("owners"), F.array_join("owners", ",").alias("names"))


@query("""WITH d AS (SELECT c_custkey, c_mktsegment || c_nationkey AS path, round(c_acctbal / 10000, 2) AS confidence FROM customer)
SELECT c_custkey, path, row_number() OVER (PARTITION BY path ORDER BY confidence DESC, c_custkey) = 1 AS kept FROM d""")
def collision_winner(t, spark):
    c = t("customer")
    rows = c.select(
        F.lit("customer").alias("table"), F.col("c_custkey").cast("string").alias("name"), F.col("c_custkey").alias("ord"),
        F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("path"), F.round(F.col("c_acctbal") / 10000, 2).alias("confidence"),
        F.lit("").alias("reasoning"), F.lit(False).alias("tie_broken"), F.lit(None).cast("string").alias("forced_null"),
    )
    done = decisions.resolve_collisions(rows)
    return done.select(F.col("ord").alias("c_custkey"), F.col("claimed").alias("path"), (~F.col("lost")).alias("kept"))


@query("SELECT lang, count(*) AS n FROM documents ANTI JOIN labels USING (doc_id) GROUP BY lang")
def coverage_diff(t, spark):
    return coverage.difference(t("documents").select("doc_id", "lang"), t("labels"), ["doc_id"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_mktsegment, CASE WHEN count(*) FILTER (c_acctbal > 0) = 0 THEN 0.0 ELSE round(avg(c_acctbal / 10000) FILTER (c_acctbal > 0)
       * (0.7 + 0.3 * count(*) FILTER (c_acctbal > 0) / count(*)), 2) END AS confidence FROM customer GROUP BY 1""")
def table_confidence(t, spark):
    up = F.col("c_acctbal") > 0
    rows = t("customer").groupBy("c_mktsegment").agg(F.avg(F.when(up, F.col("c_acctbal") / 10000)).alias("mean"), F.count_if(up).alias("mapped"), F.count(F.lit(1)).alias("total"))
    return rows.select("c_mktsegment", decisions.table_confidence(F.col("mean"), F.col("mapped"), F.col("total")).alias("confidence"))


@query("""SELECT CASE WHEN c >= 0.9 THEN 'high' WHEN c >= 0.8 THEN 'medium' ELSE 'review' END AS band, count(*) AS n
       FROM (SELECT round(1 - 3 * l_discount, 2) AS c FROM lineitem) GROUP BY 1""")
def confidence_bands(t, spark):
    level = tx.band(F.round(1 - 3 * F.col("l_discount"), 2))
    return t("lineitem").select(level.alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS line, round(greatest(0.0, least(1.0, least(0.6 * 10 * l_discount + 0.4 * 10 * l_tax
       - CASE WHEN l_returnflag = 'N' THEN 0.05 ELSE 0.0 END, CASE WHEN l_linestatus = 'F' THEN 0.85 ELSE 1.0 END))) + 1e-9, 2) AS confidence FROM lineitem""")
def blend_confidence(t, spark):
    penalty = F.when(F.col("l_returnflag") == "N", 0.05).otherwise(0.0) - 1e-9  # keeps halves apart: engines round them unlike
    blended = decisions.blend(10 * F.col("l_discount"), 10 * F.col("l_tax"), penalty, F.when(F.col("l_linestatus") == "F", 0.85))
    return t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), blended.alias("confidence"))


@query("""WITH a AS (SELECT c_mktsegment AS tbl, c_nationkey % 5 AS coll, c_custkey % 20 AS name, max(round((c_acctbal + 1000) / 11000, 6)) AS affinity FROM customer GROUP BY ALL),
m AS (SELECT tbl, coll, avg(affinity) AS affinity, count(*) FILTER (affinity >= 0.3) AS placed, count(*) AS fields FROM a GROUP BY tbl, coll)
SELECT tbl, coll::BIGINT AS coll, round(affinity, 4) AS affinity, fields, placed FROM m QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY placed DESC, affinity DESC, coll) = 1""")
def pair_affinity(t, spark):
    scored = t("customer").groupBy(F.col("c_mktsegment").alias("table"), (F.col("c_nationkey") % 5).alias("coll_ord"), (F.col("c_custkey") % 20).alias("name")).agg(
        F.max(F.round((F.col("c_acctbal") + 1000) / 11000, 6)).alias("affinity")
    )
    best = pairing.table_pairings(scored.withColumn("table_ord", F.lit(0)).withColumn("collection", F.col("coll_ord").cast("long")))
    return best.select(F.col("table").alias("tbl"), F.col("collection").alias("coll"), F.round("affinity", 4).alias("affinity"), "fields", F.col("placed_fields").alias("placed"))


_MODELS = ("micro", "lite", "pro", "fast", "strong", "other")
_CALLS_SQL = """WITH p(model_id, label, tier, i, o) AS (VALUES ('micro', 'Micro', 'cheap', 0.035::DOUBLE, 0.14::DOUBLE), ('lite', 'Lite', 'cheap', 0.06, 0.24), ('pro', 'Pro', 'mid', 0.8, 3.2),
       ('fast', 'Fast', 'cheap', 1.0, 5.0), ('strong', 'Strong', 'strong', 3.0, 15.0), ('embed', 'Embeddings', 'embedding', 0.02, 0.0)),
c AS (SELECT event_id AS seq, event_type AS stage, ['micro', 'lite', 'pro', 'fast', 'strong', 'other'][(user_id % 6) + 1] AS model_id, user_id, event_id % 900 + 100 AS input_tokens,
       event_id % 90 + 10 AS output_tokens, event_id % 7 = 0 AS cache_hit FROM events),
k AS (SELECT c.*, coalesce(label, 'Unknown model') AS label, CASE WHEN cache_hit THEN 0.0 ELSE input_tokens / 1e6 * coalesce(i, 0) + output_tokens / 1e6 * coalesce(o, 0) END AS usd
       FROM c LEFT JOIN p USING (model_id)),
t AS (SELECT sum(input_tokens) FILTER (NOT cache_hit)::BIGINT AS total_input_tokens, sum(output_tokens) FILTER (NOT cache_hit)::BIGINT AS total_output_tokens, round(sum(usd), 6) AS total_usd,
       count(*) FILTER (NOT cache_hit) AS billable_calls, count(*) FILTER (cache_hit) AS cache_hits FROM k)
"""


def _calls(t, spark) -> DataFrame:
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("user_id") % 6 + 1).cast("int"))
    rows = t("events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), model.alias("model_id"), "user_id", (F.col("event_id") % 900 + 100).alias("input_tokens"),
        (F.col("event_id") % 90 + 10).alias("output_tokens"), (F.col("event_id") % 7 == 0).alias("cache_hit"),
    )
    return ledger.priced(rows, ledger.model_prices(spark))


@query(_CALLS_SQL + """SELECT stage, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(usd), 6) AS usd,
       count(DISTINCT model_id) AS models FROM k GROUP BY stage""")
def ledger_by_stage(t, spark):
    return ledger.by_stage(_calls(t, spark)).withColumn("models", F.size("models").cast("long"))


@query(_CALLS_SQL + "SELECT model_id, label, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(usd), 6) AS usd FROM k GROUP BY model_id, label")
def ledger_by_model(t, spark):
    return ledger.by_model(_calls(t, spark))


@query(_CALLS_SQL + "SELECT *, total_input_tokens + total_output_tokens AS total_tokens FROM t")
def ledger_totals(t, spark):
    return ledger.totals(_calls(t, spark))


@query(_CALLS_SQL + "SELECT model_id, round(total_input_tokens / 1e6 * i + total_output_tokens / 1e6 * o, 6) AS usd FROM t, p WHERE tier <> 'embedding'")
def ledger_what_if(t, spark):
    return ledger.what_if(ledger.totals(_calls(t, spark)), ledger.model_prices(spark))


@query(_CALLS_SQL + """SELECT seq, user_id, spent, spent <= 20000 AS within FROM (SELECT seq, user_id, (sum(CASE WHEN cache_hit THEN 0 ELSE input_tokens + output_tokens END)
       OVER (PARTITION BY user_id ORDER BY seq))::BIGINT AS spent FROM k)""")
def budget_running(t, spark):
    return ledger.running_budget(_calls(t, spark), "user_id", 20_000).select("seq", "user_id", "spent", "within")


@query("SELECT p_brand, batch, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 8 AS batch FROM part) GROUP BY 1, 2")
def batching(t, spark):
    rows = adjudicate.batches(t("part").select(F.col("p_brand").alias("table"), F.col("p_partkey").alias("ord")), 8)
    return rows.groupBy(F.col("table").alias("p_brand"), F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


@query("""WITH e AS (SELECT event_id, props, unnest(json_keys(props)) AS path FROM events), v AS (SELECT event_id, path, json_type(props, '$.' || path) AS j FROM e)
SELECT path, coalesce(arg_min(CASE WHEN j IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'Number' WHEN j = 'VARCHAR' THEN 'String' WHEN j = 'BOOLEAN' THEN 'Boolean' WHEN j = 'ARRAY' THEN 'Array' END, event_id)
       FILTER (j <> 'NULL'), 'Null') AS type, count(*) AS documents, min(event_id) AS first FROM v GROUP BY path""")
def merge_documents(t, spark):
    return inference.infer_paths(t("events"), "props", "event_id").drop("rank")


@query("""SELECT r_name, left(sha256('[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']'), 16) AS fingerprint
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def fingerprint(t, spark):
    named = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return reader.fingerprints(named, ["r_name"], ["n_nationkey"], ["n_nationkey", "n_name"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_event_wins(t, spark):
    return last_by_key(t("events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def bounded_history(t, spark):
    runs = t("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("started_at"))
    return writers.history(runs).select(F.col("run_id").alias("o_orderkey"), F.col("started_at").alias("o_totalprice"))


# ---- whole runs and what SQL has no words for


def _run(spark):
    return map_schemas(reader.source_fields(spark, tpch.DDL), reader.dest_fields(spark, tpch.DOCUMENTS), generated_at="2024-01-01T00:00:00Z")


@query("""SELECT * FROM (VALUES ('customer', 'c_custkey', '_id', 'BIGINT -> ObjectId'), ('customer', 'c_name', 'name', 'VARCHAR -> String'),
       ('customer', 'c_acctbal', 'account.balance', 'DECIMAL(12,2) -> Number (nested path)'), ('customer', 'c_mktsegment', 'market.segment', 'CHAR(10) -> String (nested path)'),
       ('orders', 'o_orderkey', '_id', 'BIGINT -> ObjectId'), ('orders', 'o_custkey', 'customer.customerId', 'BIGINT -> ObjectId (nested path)'),
       ('orders', 'o_orderstatus', 'status', 'CHAR(1) code -> String enum'), ('orders', 'o_totalprice', 'total.price', 'DECIMAL(12,2) -> Number (nested path)'),
       ('orders', 'o_orderdate', 'dates.orderDate', 'DATETIME -> ISODate (nested path)'), ('orders', 'o_orderpriority', 'priority', 'VARCHAR -> String'))
       v(source_table, source_field, destination_field, type_transform)""")
def mapping_run(t, spark):
    return assemble.mapped_fields(_run(spark).document).select("source_table", "source_field", "destination_field", "type_transform")


@query(SQL["xf_build_document"])
def migrate_by_run(t, spark):
    r = _run(spark)
    whole = t("orders").withColumn("o_orderdate", F.date_trunc("second", "o_orderdate").cast("timestamp_ntz"))
    done = migrate.migrate(whole, compile_mapping(r.document, r.source, r.dest, "orders"))
    return _flat(done, id="_id.$oid", customer_id="customer.customerId.$oid", status="status", price="total.price", ordered_at="dates.orderDate.$date", priority="priority")


@query()
def run_report(t, spark):
    r = _run(spark).report()
    return r["coverage"].crossJoin(r["quality"]).crossJoin(r["pairing"].drop("headline"))  # one row each


@query("""SELECT * FROM (VALUES ('customer', 'c_custkey', 'BIGINT', true, false, NULL), ('customer', 'c_name', 'VARCHAR(25)', false, false, NULL), ('customer', 'c_nationkey', 'INT', false, false, NULL),
       ('customer', 'c_acctbal', 'DECIMAL(12,2)', false, false, NULL), ('customer', 'c_mktsegment', 'CHAR(10)', false, false, NULL), ('orders', 'o_orderkey', 'BIGINT', true, false, NULL),
       ('orders', 'o_custkey', 'BIGINT', false, true, 'customer.c_custkey'), ('orders', 'o_orderstatus', 'CHAR(1)', false, false, NULL), ('orders', 'o_totalprice', 'DECIMAL(12,2)', false, false, NULL),
       ('orders', 'o_orderdate', 'DATETIME', false, false, NULL), ('orders', 'o_orderpriority', 'VARCHAR(15)', false, false, NULL)) v("table", name, sql_type, is_pk, is_fk, "references")""")
def ddl_parse(t, spark):
    return reader.source_fields(spark, tpch.DDL).select("table", "name", "sql_type", "is_pk", "is_fk", "references")


@query()
def fuzzy_ratio(t, spark):
    pairs = t("part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return with_ratio(pairs, "a", "b", "ratio").select("p_partkey", F.round("ratio", 6).alias("ratio"))


@query("SELECT * FROM (VALUES ('cust', 'people', 0.9::DOUBLE), ('emp', 'staff', 0.7), ('ord', 'orders', 0.8), ('ghost', 'staff', 0.5)) v(\"table\", collection, confidence)")
def greedy_routing(t, spark):
    proposals = [("cust", "people", 0.9, ""), ("emp", "people", 0.7, ""), ("ord", "orders", 0.8, ""), ("ghost", "nowhere", 0.9, "")]
    return routing.resolve(proposals, ["people", "staff", "orders"]).frame(spark).select("table", "collection", "confidence")


@query("SELECT event_id, props::JSON->>'k' AS k FROM events")
def extract_json_answers(t, spark):
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nand that is all {"))
    found = t("events").select("event_id", extract_json(wrapped).alias("j"))
    return found.select("event_id", F.get_json_object("j", "$.k").alias("k"))


# ---- parts of a run one by one


@query("""SELECT * FROM (VALUES ('customer.c_custkey', 'c_custkey (BIGINT, PK, NOT NULL)', 'integer', 'PK'), ('customer.c_name', 'c_name (VARCHAR(25), NOT NULL, // customer name)', 'string', ''),
       ('customer.c_nationkey', 'c_nationkey (INT)', 'integer', ''), ('customer.c_acctbal', 'c_acctbal (DECIMAL(12,2), // account balance)', 'decimal', ''),
       ('customer.c_mktsegment', 'c_mktsegment (CHAR(10), // market segment)', 'string', ''), ('orders.o_orderkey', 'o_orderkey (BIGINT, PK, NOT NULL)', 'integer', 'PK'),
       ('orders.o_custkey', 'o_custkey (BIGINT, FK, -> customer.c_custkey)', 'integer', 'FK'), ('orders.o_orderstatus', 'o_orderstatus (CHAR(1), // F=Finished, O=Open, P=Pending)', 'string', ''),
       ('orders.o_totalprice', 'o_totalprice (DECIMAL(12,2), // total price)', 'decimal', ''), ('orders.o_orderdate', 'o_orderdate (DATETIME, // order date)', 'datetime', ''),
       ('orders.o_orderpriority', 'o_orderpriority (VARCHAR(15), // priority)', 'string', '')) v(qualified, "describe", category, key_role)""")
def describe_source(t, spark):
    return prompts.derive_source(reader.source_fields(spark, tpch.DDL)).select("qualified", "describe", "category", "key_role")


@query("""SELECT * FROM (VALUES ('customers', '_id', 'ObjectId', NULL), ('customers', 'name', 'String', NULL), ('customers', 'account.balance', 'Number', NULL),
       ('customers', 'market.segment', 'String', NULL), ('orders', '_id', 'ObjectId', NULL), ('orders', 'customer.customerId', 'ObjectId', 'customers._id'),
       ('orders', 'customer.name', 'String', NULL), ('orders', 'status', 'String', NULL), ('orders', 'total.price', 'Number', NULL), ('orders', 'dates.orderDate', 'ISODate', NULL),
       ('orders', 'priority', 'String', NULL)) v(collection, path, bson_type, "references")""")
def dest_paths(t, spark):
    return reader.dest_fields(spark, tpch.DOCUMENTS).select("collection", "path", "bson_type", "references")


@query("""WITH k AS (SELECT user_id, value FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
SELECT event_id, e.user_id, k.value AS answer FROM events e LEFT JOIN k USING (user_id)""")
def cache_lookup(t, spark):
    events = t("events")
    cache = events.filter("event_id % 3 = 0").groupBy("user_id").agg(F.min_by("value", "event_id").alias("answer"))
    hit, miss = writers.cached(events.select("event_id", "user_id"), cache, "user_id")
    return hit.unionByName(miss.withColumn("answer", F.lit(None).cast("double"))).select("event_id", "user_id", "answer")


@query("""SELECT count(*) AS total_calls, max(user_id % 3)::BIGINT AS max_tables, max(user_id % 11) FILTER (event_id % 2 = 0)::BIGINT AS max_typed_fields, max(user_id % 11)::BIGINT AS max_named_fields,
       max(CASE WHEN user_id % 4 > 0 THEN 1 ELSE 0 END)::BIGINT AS max_paths, coalesce(max(user_id % 9) FILTER (event_type = 'click'), 0)::BIGINT AS max_mappings, max(event_id % 900 + 100)::BIGINT AS max_input_tokens
FROM events""")
def constraint_maxima(t, spark):
    many = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    u = F.col("user_id")
    calls = t("events").select(
        F.when(F.col("event_type") == "click", "adjudicate").otherwise("route").alias("stage"), F.when(F.col("event_id") % 2 == 0, "typed").otherwise("names").alias("detail_level"),
        many(u % 3).alias("source_tables"), many(u % 11).alias("source_fields"), many(u % 4).alias("destination_paths"), (u % 9).alias("mappings"), (F.col("event_id") % 900 + 100).alias("input_tokens"),
    )
    return ledger.constraint_maxima(calls)


@query("""SELECT * FROM (VALUES ('orders', 'customer.name', 'A copy kept beside customer.customerId; joining customers._id fills it, not a column of orders.')) v(collection, path, reason)""")
def unmapped_destination(t, spark):
    return _run(spark).report()["unmapped_destination"]


@query("""SELECT * FROM (VALUES ('customer', 'c_nationkey')) v("table", name)""")
def unmapped_source(t, spark):
    return _run(spark).report()["unmapped_source"].select("table", "name")


@query("SELECT 0::BIGINT AS faults")
def full_validation(t, spark):
    r = _run(spark)
    return coverage.full_validation(r.document, r.source, r.dest).agg(F.count(F.lit(1)).alias("faults"))


#: A mapping document with one fault of every kind, over the worked example's schemas.
FAULTY = {
    "mapping_version": "", "source": "retail", "destination": "shop", "generated_at": "today",
    "tables": [
        {"source_table": "customer", "destination_collection": "customers", "confidence": 1.5, "reasoning": "One. Two.", "unmapped_source_fields": ["c_custkey", "ghost"],
         "unmapped_destination_fields": ["market.segment"], "field_mappings": [
             {"source_field": "c_custkey", "destination_field": "_id", "type_transform": "", "confidence": -0.1, "reasoning": "It is the key.", "notes": None},
             {"source_field": "c_name", "destination_field": "name", "type_transform": "VARCHAR -> String", "confidence": 0.9, "reasoning": "", "notes": None},
             {"source_field": "c_nationkey", "destination_field": "name", "type_transform": "INT -> String", "confidence": 0.9, "reasoning": "Both are names.", "notes": None},
             {"source_field": "c_acctbal", "destination_field": "made.up", "type_transform": "DECIMAL -> Number", "confidence": 0.9, "reasoning": "Both are sums.", "notes": None}]},
        {"source_table": "nope", "destination_collection": "nowhere", "confidence": 0.5, "reasoning": "A guess.", "unmapped_source_fields": [], "unmapped_destination_fields": [], "field_mappings": []},
    ],
}


@query("""SELECT * FROM (VALUES ('schema_violation', 'generated_at', 'is no ISO 8601 time'), ('schema_violation', 'mapping_version', 'is empty'), ('schema_violation', 'tables/0/confidence', 'is not between 0 and 1'),
       ('schema_violation', 'tables/0/reasoning', 'is not one sentence'), ('schema_violation', 'tables/0/field_mappings/0/type_transform', 'is empty'),
       ('schema_violation', 'tables/0/field_mappings/0/confidence', 'is not between 0 and 1'), ('schema_violation', 'tables/0/field_mappings/1/reasoning', 'is not one sentence'),
       ('coverage_error', 'nope', 'unknown source table'), ('coverage_error', 'customer.c_mktsegment', 'column is neither mapped nor declared unmapped'),
       ('coverage_error', 'customer.c_custkey', 'column is both mapped and declared unmapped'), ('coverage_error', 'customer.ghost', 'unknown column'),
       ('coverage_error', 'nowhere', 'unknown destination collection'), ('coverage_error', 'customers.account.balance', 'path is neither targeted nor declared unmapped'),
       ('coverage_error', 'customers.made.up', 'unknown path'), ('coverage_error', 'orders', 'source table is missing'),
       ('unresolved_path', 'customer.c_acctbal', 'made.up'), ('collision', 'customer.name', 'c_name, c_nationkey')) v(kind, key, detail)""")
def validation_faults(t, spark):
    bad = spark.createDataFrame([FAULTY], MAPPING_DOCUMENT)
    return coverage.full_validation(bad, reader.source_fields(spark, tpch.DDL), reader.dest_fields(spark, tpch.DOCUMENTS))


@query("""SELECT * FROM (VALUES ('adjudicate', 2::BIGINT, 11::BIGINT, 1::BIGINT), ('route', 2, 0, 1)) v(stage, calls, fields, most_tables)""")
def run_calls(t, spark):
    """The ledger of a run whose answers come from a function: one call a table to route, one a batch to choose."""

    def choose(frame, stage):
        first = [c[0]["path"] if len(c) else None for c in frame["candidates"]]
        if stage == "route":
            first = ["customers" if x == "customer" else "orders" for x in frame["name"]]
        return frame[["table", "name"]].assign(path=first, confidence=0.9, reasoning="The names agree.", notes=None, model="fast")

    who = adjudicate.Call(choose)
    r = map_schemas(reader.source_fields(spark, tpch.DDL), reader.dest_fields(spark, tpch.DOCUMENTS), who, router=who)
    by = r.calls.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.size("source_fields")).alias("fields"), F.max(F.size("source_tables")).cast("long").alias("most_tables"))
    return by.filter("stage in ('route', 'adjudicate')")

def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


