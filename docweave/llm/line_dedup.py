"""Line deduplication by range-partitioned line hashes, giving per-document keep bitmaps instead of text.

1. One pass hashes every line's key (128 bits). Within a chunk of a partition only the smallest document that holds
   a key can be the first of all, so lines of the others are settled there; a line found in a third of all documents
   sends one document per chunk to the shuffle, not a third of all rows.
2. The other hashes are range-partitioned, sorted by document and position, and streamed: the first document of a
   hash stays, lines of later ones go. The hash table holds no text.
3. The positions to drop are gathered per document into a compressed bitmap.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_key, packed, scratch, session, texts, unpacked

MIN_CHARS = 10
#: Lines that are settled together in one task: bounds its memory.
CHUNK_LINES = 400_000
_LINES = "high long, low long, id long, version long, position int, settled boolean"
_ARROW = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("id", pa.int64()), ("version", pa.int64()), ("position", pa.int32()), ("settled", pa.bool_())])


def line_key(line: str) -> bytes:
    """UTF-8 of the line without white space at both ends, A-Z in lower case (bytes.lower changes ASCII only)."""
    return line.encode().strip(b" \t\n\x0b\x0c\r").lower()


def version(text: str) -> int:
    """Tells rows with the same doc_id but other texts apart; equals Spark's xxhash64(text)."""
    found = xxhash.xxh64_intdigest(text.encode(), 42)
    return found - 2**64 if found >= 2**63 else found


def _settle(digests: bytearray, ids: list, versions: list, lines: list, positions: list):
    """A chunk's lines: those whose key a smaller document of the chunk holds are settled as drops."""
    keys = np.frombuffer(bytes(digests), "<i8").reshape(-1, 2)
    counts = np.array(lines)
    doc, ver = np.repeat(np.array(ids, "i8"), counts), np.repeat(np.array(versions, "i8"), counts)
    pos = np.array(positions, "i4")
    order = np.lexsort((doc, keys[:, 1], keys[:, 0]))
    sorted_keys = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1)
    first = np.repeat(doc[order][new], np.diff(np.append(np.flatnonzero(new), len(order))))
    settled = np.empty(len(order), bool)
    settled[order] = doc[order] > first
    # the hash of a settled line is not needed any more
    high, low = (pa.array(keys[:, i], mask=settled) for i in (0, 1))
    return pa.record_batch([high, low, pa.array(doc), pa.array(ver), pa.array(pos), pa.array(settled)], schema=_ARROW)


def _hash_lines(batches):
    digests, ids, versions, lines, positions = bytearray(), [], [], [], []
    for batch in batches:
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            n = 0
            for k, line in enumerate(text.split("\n")):
                if len(line) >= MIN_CHARS and len(trimmed := line.strip(" \t\n\x0b\x0c\r")) >= MIN_CHARS:
                    digests += xxhash.xxh3_128_digest(trimmed.encode().lower())
                    positions.append(k)
                    n += 1
            if n:
                ids.append(key)
                versions.append(version(text))
                lines.append(n)
            if len(positions) >= CHUNK_LINES:
                yield _settle(digests, ids, versions, lines, positions)
                digests, ids, versions, lines, positions = bytearray(), [], [], [], []
    if positions:
        yield _settle(digests, ids, versions, lines, positions)


def pack_bits(positions, n_lines: int) -> bytes:
    """Deflated bitmap, a bit per line, first line in the lowest bit of the first byte; 1: the line stays."""
    keep = np.ones(n_lines, bool)
    keep[np.asarray(positions, "i8")] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def unpack_bits(packed: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), "u1"), bitorder="little")[:n_lines].astype(bool)


def _bitmaps(batches):
    for batch in batches:
        dropped = [np.unique(x) for x in batch.column("positions").to_pylist()]
        made = [pack_bits(x, int(x[-1]) + 1) for x in dropped]
        yield pa.record_batch(
            [batch.column("id"), batch.column("version"), pa.array([len(x) for x in dropped], pa.int64()), pa.array([int(x[-1]) + 1 for x in dropped], pa.int64()), pa.array(made, pa.binary())],
            names=["id", "version", "n_dropped", "n_bits", "bitmap"],
        )


def line_bitmaps(docs: DataFrame) -> DataFrame:
    """A row per document that loses lines: id (doc_id, null as the largest long), version (hash of its text),
    n_dropped, n_bits, bitmap (deflated; lines from n_bits on stay).

    Keys of MIN_CHARS code points or more that at least two documents hold lose all their lines except in the
    smallest doc_id. Repeated rows of a document count as one document and lose the same lines; a null doc_id is one
    document that sorts last. Null and empty texts have one empty line, which stays; very long texts are read whole, line by
    line. An empty table gives no rows; other columns are ignored.
    """
    session(docs)
    lines = scratch(texts(docs).select(id_key().alias("id"), "text").mapInArrow(_hash_lines, _LINES), "lines")
    ranged = lines.filter(~F.col("settled")).repartitionByRange("high", "low").sortWithinPartitions("high", "low", "id", "position")
    # The range partitioning and sorting already suit this window: no further shuffle, and rows stream through.
    first = F.first("id").over(Window.partitionBy("high", "low").orderBy("id", "position"))
    late = ranged.withColumn("first", first).filter(F.col("id") > F.col("first"))
    cols = ["id", "version", "position"]
    drops = late.select(*cols).unionByName(lines.filter("settled").select(*cols))
    return (
        drops.groupBy("id", "version")
        .agg(F.collect_list("position").alias("positions"))
        .mapInArrow(_bitmaps, "id long, version long, n_dropped long, n_bits long, bitmap binary")
    )


def kept_lines(text: str, bitmap: bytes | None, n_bits: int | None) -> list[str]:
    lines = text.split("\n")
    if bitmap is None:
        return lines
    keep = unpack_bits(bitmap, n_bits)
    return [x for k, x in enumerate(lines) if k >= n_bits or keep[k]]


def with_bitmaps(docs: DataFrame) -> DataFrame:
    """The documents (all columns) with n_dropped, n_bits and bitmap in a struct named kept__ (null: all lines stay).

    Rows as in line_bitmaps(). Only columns that begin with ``kept__`` would clash: op5_line_dedup() and rebuild() hand over
    the id, the text and a struct of the rest.
    """
    found = line_bitmaps(docs).select(
        F.col("id").alias("kept__id"), F.col("version").alias("kept__version"), F.struct("n_dropped", "n_bits", "bitmap").alias("kept__")
    )
    same = (id_key() == F.col("kept__id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("kept__version"))
    # The bitmaps are far smaller than the texts: hash them, and don't sort the texts.
    return docs.join(found.hint("shuffle_hash"), same, "left").drop("kept__id", "kept__version")


def _digest(batches):
    for batch in batches:
        counts, dropped, shas = [], [], []
        for text, kept in zip(batch.column("text").to_pylist(), batch.column("kept__").to_pylist(), strict=True):
            lines = kept_lines(text, kept and kept["bitmap"], kept and kept["n_bits"])
            counts.append(text.count("\n") + 1)
            dropped.append(counts[-1] - len(lines))
            shas.append(hashlib.sha256("\n".join(lines).encode()).hexdigest())
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas, pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def op5_line_dedup(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_lines, n_dropped, kept_sha256, a row per input row; odd rows as in line_bitmaps()."""
    return with_bitmaps(texts(docs)).mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _rebuild(batches):
    for batch in batches:
        new = [
            t if t is None or kept is None else "\n".join(kept_lines(t, kept["bitmap"], kept["n_bits"]))
            for t, kept in zip(batch.column("text").to_pylist(), batch.column("kept__").to_pylist(), strict=True)
        ]
        yield pa.record_batch([pa.array(new, pa.string()), batch.column("row")], names=["text", "row"])


def rebuild(docs: DataFrame) -> DataFrame:
    """The documents, same columns, with their dropped lines gone (n_chars, where there is one, follows).

    Documents all of whose lines go keep an empty text; a null text stays null; columns of any name are passed on; other odd rows
    as in line_bitmaps().
    """
    rows = packed(docs)
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("row", rows.schema["row"].dataType)])
    return unpacked(with_bitmaps(rows).mapInArrow(_rebuild, kind), docs)


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id > f.first AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
