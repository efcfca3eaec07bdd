"""Exact deduplication with a heavy-hitter split.

One pass over the texts yields a digest per document and, per partition, a Misra-Gries summary of the digests.
Summaries add up, and every digest with a 1/HEAVY_PARTS share or more survives the sum, as what counters fall short by is
allowed for. Their exact sizes and winners are computed with map-side combining (at most 4/3 HEAVY_PARTS rows) and
broadcast, so that copies of a very frequent text are resolved where they lie. All remaining digests are shuffled, a 40-byte row
per document, to a join with one winner a digest.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_PARTS, id_back, id_key, scratch, session, texts

_DELETE = b" \t\n\x0b\x0c\r"
_SCHEMA = "summary boolean, doc_id long, n long, digest binary"


def merge_counts(held: dict, more: dict, size: int) -> dict:
    """Misra-Gries summary of two summaries: at most ``size`` counters; each falls short by 1/size of the total at most."""
    for k, n in more.items():
        held[k] = held.get(k, 0) + n
    if len(held) > size:
        cut = sorted(held.values(), reverse=True)[size]
        held = {k: n - cut for k, n in held.items() if n > cut}
    return held


def _digests(size: int):
    def run(batches):
        schema = pa.schema([("summary", pa.bool_()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
        held: dict = {}
        for batch in batches:
            found = [t.as_py() for t in batch.column("text")]
            digest = [hashlib.sha256(t.encode().translate(None, _DELETE)).digest() for t in found]
            more: dict = {}
            for d in digest:
                more[d] = more.get(d, 0) + 1
            held = merge_counts(held, more, size)
            yield pa.record_batch(
                [pa.array([False] * len(digest)), batch.column("doc_id"), pa.array(map(len, found), pa.int64()), pa.array(digest, pa.binary())],
                schema=schema,
            )
        held = {k: n for k, n in held.items() if n > 1}
        if held:
            yield pa.record_batch(
                [pa.array([True] * len(held)), pa.nulls(len(held), pa.int64()), pa.array(held.values(), pa.int64()), pa.array(held, pa.binary())],
                schema=schema,
            )

    return run


def exact_dedup(docs: DataFrame, counters: int = 4 * HEAVY_PARTS) -> DataFrame:
    """Group documents whose texts are identical without white space and name the row of each group that stays.

    Returns a row per input row: doc_id, n_chars, digest, keep_id, group_size, kept. The row with the most code
    points stays, then the smallest doc_id, then (repeated rows) one of them. Texts of any length are digested whole. A null text counts as empty and
    empty texts are a group like any other; a null doc_id sorts last. An empty table gives an empty result. Other
    columns are ignored.
    """
    session(docs)
    # rows are numbered once and written, so that all that follows sees the same numbers
    made = texts(docs).mapInArrow(_digests(counters), _SCHEMA).withColumn("row", F.monotonically_increasing_id())
    made = scratch(made, "digests")
    rows = (
        made.filter(~F.col("summary"))
        .select("doc_id", F.col("n").alias("n_chars"), "digest", F.struct((-F.col("n")).alias("short"), id_key().alias("id"), "row").alias("place"))
    )
    total = made.filter(~F.col("summary")).count()
    # Counters never exceed true counts and fall short by total / counters at most: every digest with 1/HEAVY_PARTS of all
    # rows passes, and no more than HEAVY_PARTS * counters / (counters - HEAVY_PARTS) digests do.
    least = max(2, -(-total // HEAVY_PARTS) - total // counters)
    frequent = made.filter("summary").groupBy("digest").agg(F.sum("n").alias("least")).filter(F.col("least") >= least)
    winner = (F.min("place").alias("best"), F.count(F.lit(1)).alias("group_size"))
    winners = scratch(rows.join(F.broadcast(frequent.select("digest")), "digest").groupBy("digest").agg(*winner), "winners")
    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # minima are combined before the shuffle; the join holds one row a digest, and its rows stream or are split
    light = rest.join(rest.groupBy("digest").agg(*winner), "digest")
    return (
        heavy.unionByName(light)
        .withColumn("keep", F.col("best.id"))
        .select(
            "doc_id", "n_chars", "digest", id_back("keep", "keep_id"), "group_size", (F.col("best.row") == F.col("place.row")).alias("kept")
        )
    )


def op7_exact_dedup(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_dedup(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\x0C\r]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""
