"""Queries that hold the library's parts one by one against DuckDB, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import mapping, tokens
from docweave.functions import text as tx
from docweave.operators import adjudicate, assemble, decisions, evaluation, ledger, migrate, pairing, prompts, shortlist
from docweave.plans import tpch
from docweave.plans.registry import query
from docweave.session import scratch, shared_dir
from docweave.sources import inference, reader
from docweave.sources.knowledge import ABBREVIATIONS, ALIASES, STOPWORDS, SYNONYMS, default_pack
from docweave.streaming.progress import last_by_key_stream, read_last
from docweave.types import BSON_CATEGORIES, SQL_CATEGORIES


def _pick(values: list, number: Column) -> Column:
    """The value at a row's number, going round."""
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _pick_sql(values: list, number: str) -> str:
    return f"([{', '.join(map(_quoted, values))}])[({number}) % {len(values)} + 1]"


def _map_sql(table: dict[str, str]) -> str:
    """A table of words to several words as a DuckDB map of lists."""
    return "MAP {" + ", ".join(f"{_quoted(k)}: [{', '.join(map(_quoted, v.split()))}]" for k, v in table.items()) + "}"


# ---- texts and names

_ANSWERS = [None, "", " NULL ", "n/a", "No Match", "-", "none", "address.city", "nothing"]


@query(f"""SELECT event_id, coalesce(lower(trim(x)) IN ('', 'null', 'none', 'n/a', 'no match', '-'), true) AS no_match FROM (SELECT event_id, {_pick_sql(_ANSWERS, 'event_id')} AS x FROM events)""")
def no_match(t, spark):
    return t("events").select("event_id", tx.is_no_match(_pick(_ANSWERS, F.col("event_id"))).alias("no_match"))


_NOTES = ["a → b", "’tis => so", " None ", "", "n/a", "plain", None]


@query(f"""SELECT item_id, replace(replace(text || coalesce(x, ''), '→', '->'), '=>', '->') AS arrows,
       CASE WHEN lower(trim(x)) IN ('', 'null', 'none', 'n/a', '-') THEN NULL ELSE replace(replace(x, '→', '->'), '’', '''') END AS notes
FROM (SELECT *, {_pick_sql(_NOTES, 'item_id')} AS x FROM benchmark)""")
def plain_texts(t, spark):
    x = _pick(_NOTES, F.col("item_id"))
    return t("benchmark").select("item_id", tx.ascii_arrows(F.concat("text", F.coalesce(x, F.lit("")))).alias("arrows"), tx.plain_notes(x).alias("notes"))


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def approx_tokens(t, spark):
    return t("documents").select("doc_id", tx.approx_tokens(F.col("text")).alias("tokens"))


@query("""SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS key FROM events""")
def call_keys(t, spark):
    return t("events").select("event_id", prompts.call_key("event_id", "event_type", "user_id").alias("key"))


_SHORT, _LONG = sorted(ABBREVIATIONS), sorted(ALIASES)
_STOPS = ", ".join(map(_quoted, STOPWORDS))
_NAMES_SQL = f"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN {_pick_sql(_LONG, 'p_partkey // 5')}
       ELSE {_pick_sql(_SHORT, 'p_partkey')} || '_of_' || upper(split_part(p_name, ' ', 1)) || {_pick_sql(_SHORT, 'p_partkey // 3')} || 'Cd' END AS name FROM part),
w AS (SELECT p_partkey, name, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'),
       '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x <> '' AND x NOT IN ({_STOPS})) AS words FROM n),
c AS (SELECT p_partkey, name, list_sort(list_distinct(list_filter(list_concat(coalesce({_map_sql(ALIASES)}[lower(name)], []),
       flatten(list_transform(words, lambda x: coalesce({_map_sql(ABBREVIATIONS)}[x], [x])))), lambda x: x NOT IN ({_STOPS})))) AS core FROM w)
"""


def _names(t) -> DataFrame:
    key = F.col("p_partkey")
    made = F.concat(_pick(_SHORT, key), F.lit("_of_"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), _pick(_SHORT, F.floor(key / 3)), F.lit("Cd"))
    return t("part").select("p_partkey", F.when(key % 5 == 0, _pick(_LONG, F.floor(key / 5))).otherwise(made).alias("name"))


@query(_NAMES_SQL + "SELECT p_partkey, name, array_to_string(core, ' ') AS core FROM c")
def core_tokens(t, spark):
    return _names(t).select("p_partkey", "name", F.array_join(tokens.core_tokens(F.col("name"), default_pack()), " ").alias("core"))


_GROUPS_SQL = ", ".join(f"({k}, {_quoted(w)})" for k, words in enumerate(SYNONYMS) for w in words)


@query(_NAMES_SQL + f""", g(id, word) AS (VALUES {_GROUPS_SQL}), u AS (SELECT p_partkey, core, unnest(core) AS word FROM c),
s AS (SELECT DISTINCT p_partkey, b.word FROM u JOIN g a USING (word) JOIN g b ON a.id = b.id WHERE NOT list_contains(core, b.word))
SELECT p_partkey, coalesce(string_agg(word, ' ' ORDER BY word), '') AS concepts FROM c LEFT JOIN s USING (p_partkey) GROUP BY p_partkey""")
def concept_tokens(t, spark):
    core = _names(t).withColumn("core", tokens.core_tokens(F.col("name"), default_pack()))
    return core.select("p_partkey", F.array_join(tokens.concept_tokens(F.col("core"), default_pack()), " ").alias("concepts"))


_SHARE = "len(list_intersect({0}, {1}))::DOUBLE / least(len({0}), len({1}))"


@query(f"""WITH w AS (SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN string_split(lower(p_name), ' ') END AS s, CASE WHEN p_partkey % 3 > 0 THEN string_split(lower(p_type), ' ') END AS d,
       list_distinct(list_concat(string_split(lower(p_type), ' '), [split_part(lower(p_name), ' ', 1)])) AS c FROM part),
k AS (SELECT p_partkey, list_distinct(s) AS s, list_distinct(d) AS d, c FROM w)
SELECT p_partkey, round(CASE WHEN s IS NULL THEN 0.0 ELSE least(1.0, greatest(CASE WHEN d IS NULL THEN 0.0
       ELSE 0.7 * {_SHARE.format('s', 'd')} + 0.3 * len(list_intersect(s, d))::DOUBLE / len(list_distinct(list_concat(s, d))) END, 0.6 * {_SHARE.format('s', 'c')})) END, 6)::DOUBLE AS score FROM k""")
def comment_score(t, spark):
    words = lambda c: F.split(F.lower(c), " ")
    own, key = F.when(F.col("p_partkey") % 7 > 0, words("p_name")), F.col("p_partkey")
    d = F.struct(F.when(key % 3 > 0, words("p_type")).alias("comment_core"), F.array_distinct(F.concat(words("p_type"), F.slice(words("p_name"), 1, 1))).alias("core"))
    pairs = t("part").select("p_partkey", F.struct(own.alias("comment_core")).alias("s"), d.alias("d"))
    return pairs.select("p_partkey", F.round(shortlist.comment_score("s", "d"), 6).alias("score"))


# ---- rules and values of pairs

_SOURCE_TYPES = ["BIGINT", "TINYINT(1)", "DECIMAL(12, 2)", "VARCHAR(25)", "CHAR(1)", "DATE", "DATETIME", "JSON", "BLOB", "POINT"]
_DEST_TYPES = ["ObjectId", "String", "Number", "ISODate", "Boolean", "Object", "Geo"]
_COMMENTS = ["A=Active, I=Idle", "no codes", None]
_PATHS = ["_id", "a.b", "c"]
_PAIRS_SQL = f"""WITH e AS (SELECT event_id AS id, {_pick_sql(_SOURCE_TYPES, 'event_id')} AS st, {_pick_sql(_DEST_TYPES, 'event_id // 10')} AS dt, {_pick_sql(_COMMENTS, 'event_id // 70')} AS comment,
       {_pick_sql(_PATHS, 'event_id // 210')} AS path, event_id % 4 = 0 AS is_pk FROM events),
b AS (SELECT *, upper(regexp_extract(st, '^[A-Za-z]+')) AS base, {_pick_sql(['integer', 'boolean', 'decimal', 'string', 'string', 'date', 'datetime', 'object', 'binary', 'string'], 'id')} AS s,
       {_pick_sql(['objectid', 'string', 'number', 'datetime', 'boolean', 'object', 'unknown'], 'id // 10')} AS d, st = 'CHAR(1)' AND coalesce(contains(comment, '='), false) AS code FROM e),
r AS (SELECT *, CASE WHEN path = '_id' AND is_pk THEN 'pk_to_objectid' WHEN d = 'objectid' THEN 'fk_to_objectid' WHEN code AND d = 'boolean' THEN 'code_to_boolean'
       WHEN code AND d = 'string' THEN 'code_to_enum_string' WHEN s = 'boolean' AND d = 'boolean' THEN 'tinyint_to_boolean' WHEN s = 'decimal' AND d = 'number' THEN 'decimal_to_number'
       WHEN s = 'integer' AND d = 'number' THEN 'int_to_number' WHEN s IN ('date', 'datetime') AND d = 'datetime' THEN 'datetime_to_isodate' WHEN d = 'string' THEN 'string_to_string'
       ELSE 'direct' END AS rule FROM b)
"""


def _pairs(t) -> DataFrame:
    key = F.col("event_id")
    p = F.struct(
        _pick(_SOURCE_TYPES, key).alias("sql_type"), (key % 4 == 0).alias("is_pk"), F.lit("other.id").alias("references"), _pick(_COMMENTS, F.floor(key / 70)).alias("comment"),
        F.lit("col").alias("name"), _pick(_PATHS, F.floor(key / 210)).alias("path"), _pick(_DEST_TYPES, F.floor(key / 10)).alias("bson_type"),
    )
    return t("events").select("event_id", p.alias("p")).withColumn("rule", mapping.rule("p"))


@query(_PAIRS_SQL + """SELECT id AS event_id, rule, CASE WHEN base IN ('CHAR', 'TINYINT', 'DECIMAL') AND contains(st, '(') THEN replace(st, ' ', '') ELSE base END
       || CASE WHEN rule LIKE 'code%' THEN ' code' ELSE '' END || ' -> ' || CASE WHEN rule LIKE '%objectid' THEN 'ObjectId' WHEN rule = 'code_to_enum_string' THEN 'String enum'
       WHEN rule = 'code_to_boolean' THEN 'Boolean' ELSE dt END || CASE WHEN contains(path, '.') THEN ' (nested path)' ELSE '' END AS label,
       rule IN ('pk_to_objectid', 'fk_to_objectid', 'code_to_boolean') AS needs_person FROM r""")
def pair_labels(t, spark):
    return _pairs(t).select("event_id", "rule", mapping.label("p", F.col("rule")).alias("label"), mapping.needs_person(F.col("rule")).alias("needs_person"))


@query(_PAIRS_SQL + """SELECT id AS event_id, CASE rule WHEN 'pk_to_objectid' THEN 'A new _id is generated; preserve col as a legacy key so that references can be remapped.'
       WHEN 'fk_to_objectid' THEN 'Resolve by a remap table from legacy keys of other.id once that collection is loaded.' WHEN 'code_to_enum_string' THEN 'Transform: A -> active, I -> idle'
       WHEN 'code_to_boolean' THEN 'Lossy: A -> true, I -> false.' WHEN 'tinyint_to_boolean' THEN 'Transform: 0 -> false, 1 -> true.'
       WHEN 'decimal_to_number' THEN 'DECIMAL(12,2) is exact and Number is a double; use Decimal128 or minor units where cents matter.'
       WHEN 'datetime_to_isodate' THEN CASE WHEN s = 'date' THEN 'A bare date becomes midnight UTC; check the time zone.' ELSE 'The source has no time zone; values are taken as UTC.' END END AS notes FROM r""")
def pair_notes(t, spark):
    return _pairs(t).select("event_id", mapping.notes("p", F.col("rule")).alias("notes"))


_SAID = ["Remap legacy keys.", "wrap the legacy id", "A -> active", "lossy", "copied", None]


@query(_PAIRS_SQL + f""", n AS (SELECT *, lower(coalesce({_pick_sql(_SAID, 'id // 7')}, '')) AS x FROM r)
SELECT id AS event_id, CASE rule WHEN 'pk_to_objectid' THEN NOT contains(x, 'wrap') AND regexp_matches(x, 'remap|legacy|generate|retain|preserve')
       WHEN 'fk_to_objectid' THEN NOT contains(x, 'wrap') AND regexp_matches(x, 'remap|lookup|mapping table|legacy|resolve')
       WHEN 'code_to_enum_string' THEN regexp_matches(x, '->|transform|lookup|map') WHEN 'code_to_boolean' THEN regexp_matches(x, '->|true|false|lossy') ELSE true END AS sound FROM n""")
def notes_sound(t, spark):
    return _pairs(t).select("event_id", mapping.notes_are_sound(F.col("rule"), _pick(_SAID, F.floor(F.col("event_id") / 7))).alias("sound"))


_VALUES = lambda kinds: ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in kinds.items())


@query(f"""WITH s(k, v) AS (VALUES {_VALUES(SQL_CATEGORIES)}), d(k, v) AS (VALUES {_VALUES(BSON_CATEGORIES)}), n AS (SELECT event_id, {_pick_sql([*SQL_CATEGORIES, 'GEOMETRY'], 'event_id')} AS a,
       {_pick_sql([*BSON_CATEGORIES, 'REGEX'], 'event_id')} AS b FROM events)
SELECT event_id, coalesce(s.v, 'string') AS source, coalesce(d.v, 'unknown') AS dest FROM n LEFT JOIN s ON s.k = a LEFT JOIN d ON d.k = b""")
def categories(t, spark):
    key = F.col("event_id")
    source, dest = tx.sql_category(F.lower(_pick([*SQL_CATEGORIES, "GEOMETRY"], key))), tx.bson_category(F.lower(_pick([*BSON_CATEGORIES, "REGEX"], key)))
    return t("events").select("event_id", source.alias("source"), dest.alias("dest"))


@query("SELECT event_id, props FROM events")
def xf_direct(t, spark):
    pair = tpch.field("events", "props", "JSON", "props", "Object")
    return migrate.migrate(t("events"), [pair], ["event_id"]).select("event_id", F.col("document.props").alias("props"))


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'about ' || p_size END AS x FROM part)
SELECT p_partkey, try_cast(x AS BIGINT) AS size, try_cast(x AS DOUBLE) AS price, try_cast(x AS INTEGER) <> 0 AS flag,
       CASE WHEN x IS NOT NULL AND try_cast(x AS BIGINT) IS NULL THEN 3 ELSE 0 END::BIGINT AS manual FROM s""")
def xf_bad_values(t, spark):
    """Values that their type can't hold: empty and marked, and the table's other rows go on."""
    key = F.col("p_partkey")
    x = F.when(key % 3 == 0, F.col("p_size").cast("string")).when(key % 3 == 1, F.concat(F.lit("about "), F.col("p_size").cast("string")))
    rows = t("part").select("p_partkey", *(x.alias(c) for c in ("a", "b", "c")))
    pairs = [tpch.field("part", "a", "INT", "size", "Number"), tpch.field("part", "b", "DECIMAL(9,2)", "price", "Number"), tpch.field("part", "c", "TINYINT(1)", "flag", "Boolean")]
    done = migrate.migrate(rows, pairs, ["p_partkey"])
    return done.select("p_partkey", "document.size", "document.price", "document.flag", migrate.manual_count().alias("manual"))


# ---- decisions of a run, from recorded answers

_DECIDED = "'t' || user_id % 7 AS tbl, 'f' || event_id AS name"


def _asked(t) -> DataFrame:
    """Questions from events: a column each, with two candidates."""
    key = F.col("event_id")
    two = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(s).cast("double").alias("total")) for p, s in (("a", 0.8), ("b", 0.5))))
    return t("events").select(
        F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("table"), F.concat(F.lit("f"), key.cast("string")).alias("name"), key.cast("int").alias("ord"), F.lit("c").alias("collection"),
        F.lit("VARCHAR(9)").alias("sql_type"), F.lit(False).alias("is_pk"), F.lit(None).cast("string").alias("references"), F.lit(None).cast("string").alias("comment"), two.alias("candidates"), F.lit(0).alias("batch"),
        key.alias("event_id"),
    )


def _records(t, **stages: tuple[Column, Column, Column]) -> DataFrame:
    """Recorded answers of stages, each by which events it has, its paths and its confidences."""
    out = None
    for stage, (which, path, sure) in stages.items():
        asked = _asked(t).filter(which)
        found = asked.select(
            F.lit(stage).alias("stage"), "table", F.concat_ws(".", "table", "name").alias("name"), path.alias("path"), sure.cast("double").alias("confidence"), F.lit("It fits.").alias("reasoning"),
            F.lit(None).cast("string").alias("notes"), F.lit(stage).alias("model"),
        )
        out = found if out is None else out.unionByName(found)
    return out


@query(f"""WITH e AS (SELECT event_id, {_DECIDED}, event_id % 11 > 0 AS asked, (event_id % 10) / 10.0 AS sure, event_id % 3 > 0 AS again FROM events)
SELECT tbl, name, CASE WHEN (NOT asked OR sure < 0.8) AND again THEN 'b' WHEN asked AND event_id % 4 > 0 THEN 'a' END AS path,
       CASE WHEN (NOT asked OR sure < 0.8) AND again THEN 0.9 WHEN asked THEN sure ELSE 0 END::DOUBLE AS sure, CASE WHEN (NOT asked OR sure < 0.8) AND again THEN 'escalated' ELSE 'cheap' END AS decided_by,
       (asked::INT + ((NOT asked OR sure < 0.8) AND again)::INT)::BIGINT AS passes, NOT asked AND NOT again AS forced FROM e""")
def cascade(t, spark):
    """Weak answers of the cheap adjudicator, and missing ones, go to the strong one."""
    key = F.col("event_id")
    cheap = adjudicate.Replay(_records(t, adjudicate=(key % 11 > 0, F.when(key % 4 > 0, "a").otherwise("none"), (key % 10) / 10)), strict=False)
    strong = adjudicate.Replay(_records(t, escalate=(key % 3 > 0, F.lit("b"), F.lit(0.9))), strict=False)
    done = decisions.adjudicate(_asked(t), cheap, strong)
    return done.select(
        F.col("table").alias("tbl"), "name", "path", F.col("model_confidence").alias("sure"), "decided_by", F.size("passes").cast("long").alias("passes"), F.col("forced_null").isNotNull().alias("forced")
    )


_DEST = "database string, dialect string, collection string, coll_ord int, ord int, path string, bson_type string, comment string, references string"


def _dest(spark, **types: str) -> DataFrame:
    return spark.createDataFrame([("d", "D", "c", 0, k, p, x, None, None) for k, (p, x) in enumerate(types.items())], _DEST)


def _settled(t, path: Column, sure: Column) -> DataFrame:
    """Decisions as an adjudicator leaves them."""
    who = adjudicate.Replay(_records(t, adjudicate=(F.lit(True), path, sure)))
    return decisions.adjudicate(_asked(t), who)


@query(f"""WITH e AS (SELECT event_id, {_DECIDED}, {_pick_sql(['a', 'b', 'ghost', None], 'event_id')} AS said, {_pick_sql(['a', 'spook', None], 'event_id // 4')} AS retry FROM events)
SELECT tbl, name, CASE WHEN said = 'ghost' THEN CASE WHEN retry = 'a' THEN 'a' END ELSE said END AS path, coalesce(said = 'ghost' AND retry = 'a', false) AS repaired,
       CASE WHEN said = 'ghost' AND coalesce(retry, '') <> 'a' THEN 'the proposed path is not in the schema: ghost' END AS forced FROM e""")
def path_retry(t, spark):
    """Paths that the schema lacks are asked for once more, and then dropped."""
    key = F.col("event_id")
    who = adjudicate.Replay(_records(t, path_retry=(F.lit(True), _pick(["a", "spook", None], F.floor(key / 4)), F.lit(0.9))), strict=False)
    held = decisions.guard_paths(_settled(t, _pick(["a", "b", "ghost", None], key), F.lit(0.9)), _dest(spark, a="String", b="String"), who)
    return held.select(F.col("table").alias("tbl"), "name", "path", "repaired", F.col("forced_null").alias("forced"))


@query(f"""WITH e AS (SELECT {_DECIDED}, CASE WHEN event_id % 5 > 0 THEN ['a', 'b'][event_id % 2 + 1] END AS path, (event_id % 10) / 10.0 AS sure FROM events),
m AS (SELECT *, CASE path WHEN 'a' THEN least(1.0, 0.5 * 0.8 + 0.5) WHEN 'b' THEN greatest(0.0, 0.5 * 0.5 + 0.5 * (0.5 - 0.8) / 0.2) END AS margin FROM e)
SELECT tbl, name, CASE WHEN path IS NULL THEN 0.0 ELSE round(least(1.0, 0.6 * sure + 0.4 * margin), 2) END::DOUBLE AS confidence FROM m""")
def finalize(t, spark):
    key = F.col("event_id")
    held = decisions.finalize(_settled(t, F.when(key % 5 > 0, _pick(["a", "b"], key)), (key % 10) / 10), _dest(spark, a="String", b="String"))
    return held.select(F.col("table").alias("tbl"), "name", "confidence")


@query(f"""WITH e AS (SELECT {_DECIDED}, (event_id % 10) / 10.0 AS sure, event_id % 2 = 0 AS again FROM events), f AS (SELECT *, round(least(1.0, 0.6 * sure + 0.36), 2) AS first FROM e)
SELECT tbl, name, CASE WHEN first < 0.75 AND again THEN 'b' ELSE 'a' END AS path, CASE WHEN first < 0.75 AND again THEN 'reflection' ELSE 'single' END AS decided_by,
       CASE WHEN first < 0.75 AND again THEN 0.54 ELSE first END::DOUBLE AS confidence FROM f""")
def reflection(t, spark):
    """Decisions in doubt get a second look, if there is one."""
    key, dest = F.col("event_id"), _dest(spark, a="String", b="String")
    first = decisions.finalize(_settled(t, F.lit("a"), (key % 10) / 10), dest)
    held = decisions.reflect(first, dest, adjudicate.Replay(_records(t, reflect=(key % 2 == 0, F.lit("b"), F.lit(0.9))), strict=False))
    return held.select(F.col("table").alias("tbl"), "name", "path", "decided_by", "confidence")


_REASONS = ["One fits.", "One. Two.", "", "First line\nsecond", "No stop"]


@query(f"""WITH e AS (SELECT event_id, {_pick_sql(_REASONS, 'event_id').replace(chr(10), "' || chr(10) || '")} AS x FROM events)
SELECT event_id, CASE x WHEN 'One. Two.' THEN CASE WHEN event_id % 3 = 0 THEN 'Both fit.' ELSE 'One.' END WHEN '' THEN 'The run recorded no reason for this mapping.'
       WHEN 'First line' || chr(10) || 'second' THEN CASE WHEN event_id % 3 = 0 THEN 'Both fit.' ELSE 'First line second.' END ELSE x END AS reasoning,
       x NOT IN ('One fits.', 'No stop') AS repaired FROM e""")
def rewrite_reasons(t, spark):
    """Reasons that are not one sentence are rewritten, or cut to their first one."""
    key = F.col("event_id")
    held = _settled(t, F.lit("a"), F.lit(0.9)).withColumn("reasoning", _pick(_REASONS, key))
    said = _records(t, rewrite=(key % 3 == 0, F.lit(None).cast("string"), F.lit(0.9))).withColumn("reasoning", F.lit("Both fit."))
    return decisions.repair_reasoning(held, adjudicate.Replay(said, strict=False)).select("event_id", "reasoning", "repaired")


@query("""WITH e AS (SELECT event_id, event_id % 2 = 0 AS coded, CASE event_id % 3 WHEN 0 THEN 'copied' WHEN 1 THEN 'F -> finished' END AS said FROM events)
SELECT event_id, CASE WHEN coded AND coalesce(said, 'copied') = 'copied' THEN 'Transform: F -> finished, O -> open' ELSE said END AS notes, coalesce(coded AND said = 'copied', false) AS repaired FROM e""")
def repair_notes(t, spark):
    """Notes that miss the mechanism of their rule are replaced by the rule's own."""
    key = F.col("event_id")
    held = _settled(t, F.lit("a"), F.lit(0.9)).withColumns(
        {"notes": F.when(key % 3 == 0, "copied").when(key % 3 == 1, "F -> finished"), "sql_type": F.when(key % 2 == 0, "CHAR(1)").otherwise("VARCHAR(9)"), "comment": F.lit("F=Finished, O=Open")}
    )
    return decisions.repair_notes(held, _dest(spark, a="String")).select("event_id", "notes", "repaired")


@query("""WITH e AS (SELECT event_id, event_id // 2 AS tbl, 0.8 - 0.04 * (event_id % 2) * (event_id // 2 % 3) AS sure FROM events WHERE event_id // 2 * 2 + 1 <= (SELECT max(event_id) FROM events)),
w AS (SELECT *, count(*) OVER (PARTITION BY tbl) AS n, (event_id // 2) % 3 <= 1 AS tie, (event_id // 2) % 5 = 0 AS second FROM e)
SELECT event_id, n = 2 AND CASE WHEN tie AND second THEN event_id % 2 = 0 ELSE event_id % 2 = 1 END AS lost,
       CASE WHEN n = 2 AND tie AND second AND event_id % 2 = 0 THEN 'tiebreak' WHEN n = 2 AND NOT (tie AND second) AND event_id % 2 = 1 THEN CASE WHEN tie THEN 'tiebreak' ELSE 'confidence' END END AS method FROM w""")
def tie_break(t, spark):
    """Two columns that claim one path about as surely: the adjudicator names the one that keeps it."""
    key, pair = F.col("event_id"), F.floor(F.col("event_id") / 2)
    last = t("events").agg(F.max("event_id").alias("last"))  # one row
    rows = _settled(t, F.lit("a"), F.lit(0.9)).join(last, pair * 2 + 1 <= F.col("last")).withColumns(
        {"table": pair.cast("string"), "confidence": F.round(0.8 - 0.04 * (key % 2) * (pair % 3), 2)}
    )
    first = rows.filter("event_id % 2 = 0")
    names = F.when(pair % 5 == 0, F.concat(F.lit("f"), (key + 1).cast("string"))).otherwise(F.col("name"))
    said = first.select(
        F.lit("tiebreak").alias("stage"), "table", "name", names.alias("path"), F.lit(0.9).alias("confidence"), F.lit("It fits.").alias("reasoning"), F.lit(None).cast("string").alias("notes"), F.lit("m").alias("model")
    )
    held = decisions.resolve_collisions(rows, adjudicate.Replay(said, strict=False))
    return held.select("event_id", "lost", F.when(F.col("lost"), F.col("method")).alias("method"))


# ---- reports

@query("""WITH p AS (SELECT p_retailprice / 2000 AS score, p_size > 25 AS is_true FROM part), m AS (SELECT min(score) FILTER (is_true) AS true_min, max(score) FILTER (is_true) AS true_max,
       min(score) FILTER (NOT is_true) AS other_min, max(score) FILTER (NOT is_true) AS other_max FROM p)
SELECT m.*, (SELECT count(*) FROM p WHERE is_true <> (score >= (true_min + other_max) / 2)) AS misplaced FROM m""")
def pair_separation(t, spark):
    return evaluation.separation(t("part").select((F.col("p_retailprice") / 2000).alias("score"), (F.col("p_size") > 25).alias("is_true")))


@query("""WITH p AS (SELECT c_mktsegment AS tbl, c_nationkey AS grp, avg((c_acctbal + 1000) / 11000) AS affinity, count(*) AS fields, count(*) FILTER (c_acctbal > 5000) AS placed FROM customer GROUP BY 1, 2),
a AS (SELECT grp, sum(affinity * fields) / sum(fields) AS score, sum(placed)::BIGINT AS placed, sum(fields)::BIGINT AS fields, count(*) FILTER (affinity < 0.45) AS forced FROM p GROUP BY grp)
SELECT round(score, 6) AS score, placed, fields, forced, CASE WHEN score >= 0.45 AND forced = 0 THEN 'aligned' WHEN score >= 0.38 THEN 'weak' ELSE 'unrelated' END AS verdict FROM a WHERE grp = 3""")
def pair_assessment(t, spark):
    rows = t("customer").filter("c_nationkey = 3").groupBy(F.col("c_mktsegment").alias("table")).agg(
        F.avg((F.col("c_acctbal") + 1000) / 11000).alias("affinity"), F.count(F.lit(1)).alias("fields"), F.count_if(F.col("c_acctbal") > 5000).alias("placed_fields")
    )
    return pairing.assess(rows).select(F.round("score", 6).alias("score"), F.col("placed_fields").alias("placed"), F.col("total_fields").alias("fields"), "forced", "verdict")


@query("""SELECT round(round(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE (event_id % 900 + 100) / 1e6 * 0.8 + (event_id % 90 + 10) / 1e6 * 3.2 END), 6) / 17, 6) AS cost_per_mapped_field FROM events""")
def cost_per_field(t, spark):
    calls = t("events").select(F.lit("pro").alias("model_id"), (F.col("event_id") % 900 + 100).alias("input_tokens"), (F.col("event_id") % 90 + 10).alias("output_tokens"), (F.col("event_id") % 7 == 0).alias("cache_hit"))
    return ledger.cost_per_field(ledger.totals(ledger.priced(calls, ledger.model_prices(spark))), 17)


@query("""WITH q AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT (SELECT count(*) FROM customer) AS fields, sum(n)::BIGINT AS offered, round(sum(n) / (SELECT count(*) FROM customer), 2) AS average FROM q""")
def shortlist_stats(t, spark):
    offered = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("candidates"))
    asked = t("customer").select("c_custkey").join(offered, "c_custkey", "left")
    return assemble.shortlist_stats(asked.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<bigint>"))))


@query("""SELECT count(*) FILTER (event_id % 11 = 0 OR event_id % 10 < 8) AS escalated, count(*) AS decisions, round(avg((event_id % 11 = 0 OR event_id % 10 < 8)::INT), 4) AS stage3_escalation_rate FROM events""")
def escalation_rate(t, spark):
    key = F.col("event_id")
    cheap = adjudicate.Replay(_records(t, adjudicate=(key % 11 > 0, F.lit("a"), (key % 10) / 10)), strict=False)
    strong = adjudicate.Replay(_records(t, escalate=(F.lit(True), F.lit("b"), F.lit(0.9))), strict=False)
    return assemble.escalation(decisions.adjudicate(_asked(t), cheap, strong))


@query("""WITH e AS (SELECT event_id, user_id % 3 AS tables, user_id % 13 AS fields, event_id % 2 = 0 AS typed FROM events) SELECT event_id FROM e WHERE tables > 1 OR (typed AND fields > 8)""")
def scope_violations(t, spark):
    many = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    calls = t("events").select("event_id", many(F.col("user_id") % 3).alias("source_tables"), many(F.col("user_id") % 13).alias("source_fields"), F.when(F.col("event_id") % 2 == 0, "typed").otherwise("names").alias("detail_level"))
    return prompts.check_scope(calls).select("event_id")


@query("SELECT event_type AS stage, count(*) AS calls FROM events GROUP BY 1")
def stage_calls(t, spark):
    return prompts.calls_by_stage(t("events").withColumnRenamed("event_type", "stage"))


@query("SELECT p_partkey AS ord, p_name AS name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_partkey LIMIT 4 OFFSET 2")
def read_columns(t, spark):
    """A page of one table's columns, as a tool call reads them."""
    brand = t("part").agg(F.min("p_brand")).first()[0]
    fields = t("part").select(F.col("p_brand").alias("table"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    return prompts.read_columns(fields, brand, 2, 4).select("ord", "name")


@query("""SELECT r_name AS tbl, 'Table ' || r_name || ' has the columns ' || string_agg(n_name, ', ' ORDER BY n_nationkey) || '.' || chr(10) || 'Collections: '
       || (SELECT string_agg(r_name, ', ' ORDER BY r_regionkey) FROM region) || '.' AS prompt FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def route_prompts(t, spark):
    source = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("table"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"))
    dest = t("region").select(F.col("r_regionkey").alias("coll_ord"), F.col("r_name").alias("collection"))
    return prompts.route_prompts(source, dest).select(F.col("table").alias("tbl"), "prompt")


@query("""WITH d AS (SELECT p_partkey, p_brand AS collection, replace(p_type, ' ', '.') AS path, ['ObjectId', 'String', 'Geo'][p_partkey % 3 + 1] AS kind, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS comment FROM part)
SELECT p_partkey, collection || '.' || path AS qualified, split_part(path, '.', -1) AS leaf, CASE WHEN contains(path, '.') THEN path[:length(path) - length(split_part(path, '.', -1)) - 1] ELSE '' END AS parent,
       kind = 'ObjectId' AS is_ref, CASE kind WHEN 'ObjectId' THEN 'objectid' WHEN 'String' THEN 'string' ELSE 'unknown' END AS category,
       path || ' (' || kind || CASE WHEN kind = 'ObjectId' THEN ', ref x._id' ELSE '' END || coalesce(', // ' || comment, '') || ')' AS "describe" FROM d""")
def describe_paths(t, spark):
    key = F.col("p_partkey")
    rows = t("part").select(
        "p_partkey", F.col("p_brand").alias("collection"), F.replace("p_type", F.lit(" "), F.lit(".")).alias("path"), _pick(["ObjectId", "String", "Geo"], key).alias("bson_type"),
        F.when(key % 2 == 0, F.col("p_name")).alias("comment"), F.when(key % 3 == 0, "x._id").alias("references"),
    )
    return prompts.derive_dest(rows).select("p_partkey", "qualified", "leaf", "parent", "is_ref", "category", "describe")


# ---- documents and schemas in their written forms

@query("""SELECT path, type, count(*) FILTER (path <> 'sub.late' OR event_id % 2 = 0) AS documents, min(event_id) FILTER (path <> 'sub.late' OR event_id % 2 = 0) AS first FROM events,
       (VALUES ('id', 'ObjectId'), ('at', 'ISODate'), ('sum', 'Decimal128'), ('n', 'Number'), ('none', 'Null'), ('tags', 'Array'), ('sub.ok', 'Boolean'), ('sub.deep.who', 'String'), ('sub.late', 'Number')) v(path, type)
GROUP BY path, type""")
def extended_json_paths(t, spark):
    """Types of Extended JSON leaves, paths of sub-documents, nulls, and a path that not all documents have."""
    key = F.col("event_id").cast("string")
    late = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "late": '), key)).otherwise("")
    text = F.concat(
        F.lit('{"_comment": "x", "id": {"$oid": "'), key, F.lit('"}, "at": {"$date": "2024-01-01"}, "sum": {"$numberDecimal": "1"}, "n": {"$numberLong": "'), key,
        F.lit('"}, "none": null, "tags": ["a"], "sub": {"ok": true, "deep": {"who": "'), F.col("event_type"), F.lit('"}'), late, F.lit("}}"),
    )
    return inference.infer_paths(t("events").select("event_id", text.alias("doc")), "doc", "event_id").drop("rank")


_TABLES_JSON = """{"database": "shop", "tables": {"_comment": "x", "a": [{"name": "id", "type": "BIGINT", "key": "PK"}, {"name": "b_id", "type": "INT", "references": "b.id"}], "b": {"columns": {"id": {"type": "INT", "primary_key": true},
 "code": {"type": "CHAR(3)", "unique": true, "nullable": false, "comment": "short"}}}, "c": {"note": "VARCHAR(9) -- free text"}}}"""


@query("""SELECT * FROM (VALUES ('a', 'id', 'BIGINT', false, true, false, false, NULL, NULL), ('a', 'b_id', 'INT', true, false, true, false, 'b.id', NULL), ('b', 'id', 'INT', false, true, false, false, NULL, NULL),
       ('b', 'code', 'CHAR(3)', false, false, false, true, NULL, 'short'), ('c', 'note', 'VARCHAR(9)', true, false, false, false, NULL, 'free text'))
       v("table", name, sql_type, nullable, is_pk, is_fk, is_unique, "references", comment)""")
def table_forms(t, spark):
    """A list of columns, an object of columns, and columns by name in one line each."""
    return reader.source_fields(spark, _TABLES_JSON).select("table", "name", "sql_type", "nullable", "is_pk", "is_fk", "is_unique", "references", "comment")


_COLLECTIONS_JSON = """{"collections": {"y": {"fields": {"_comment": "z", "at": "ISODate -- when", "x_id": "ObjectId -- ref -> x._id", "deep": {"er": {"leaf": "Boolean"}}, "whole": "Object"}},
 "x": [{"name": "_id", "type": "ObjectId"}, {"name": "sub", "fields": [{"name": "n", "type": "Number", "comment": "count"}]}]}}"""


@query("""SELECT * FROM (VALUES ('x', '_id', 'ObjectId', NULL, NULL), ('x', 'sub.n', 'Number', 'count', NULL), ('y', 'at', 'ISODate', 'when', NULL), ('y', 'x_id', 'ObjectId', 'ref -> x._id', 'x._id'),
       ('y', 'deep.er.leaf', 'Boolean', NULL, NULL)) v(collection, path, bson_type, comment, "references")""")
def collection_forms(t, spark):
    """Lists of fields, terse fields, nested objects; objects without fields are no destinations."""
    return reader.dest_fields(spark, _COLLECTIONS_JSON).select("collection", "path", "bson_type", "comment", "references")


_SAMPLES_JSON = """{"collections": {"people": [{"_id": {"$oid": "0"}, "age": null, "tags": []}, {"age": 7, "home": {"city": "x", "_comment": "y"}}, {"age": "old", "home": {"zip": {"$numberInt": "1"}}}]}}"""


@query("""SELECT * FROM (VALUES ('_id', 'ObjectId'), ('age', 'Number'), ('tags', 'Array'), ('home.city', 'String'), ('home.zip', 'Number')) v(path, bson_type)""")
def sample_documents(t, spark):
    """A schema from sample documents: the first type that is not null holds."""
    return reader.dest_fields(spark, _SAMPLES_JSON).select("path", "bson_type")


@query("SELECT * FROM (VALUES ('ddl', 'mysql_ddl'), ('tables', 'mysql_json'), ('collections', 'mongo_json'), ('samples', 'mongo_documents'), ('file', 'mysql_ddl')) v(name, format)")
def formats(t, spark):
    texts = {"ddl": tpch.DDL, "tables": _TABLES_JSON, "collections": _COLLECTIONS_JSON, "samples": _SAMPLES_JSON}
    rows = [(name, reader.detect_format(text)) for name, text in texts.items()] + [("file", reader.detect_format("-- empty", "x.SQL"))]
    return spark.createDataFrame(rows, "name string, format string")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_event_stream(t, spark):
    """The last event of every user, kept up to date by a stream."""
    folder = f"{shared_dir(spark).rstrip('/')}/docweave-{uuid.uuid4().hex}"
    held = scratch(t("events").select("user_id", "event_id", "event_type").repartition(3), "events")
    events = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 1).parquet(held.inputFiles()[0].rpartition("/")[0])
    stream = last_by_key_stream(events, "user_id", "event_id", f"{folder}/last").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
    stream.awaitTermination()
    return read_last(spark, f"{folder}/last", "user_id")
