"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Every shingle (five words; fewer words: all of them) is hashed once. The top bits of the hash name a bin, the least
hash of a bin stands for it. An empty bin takes the value of a non-empty bin that a fixed random probe order of its own
finds first, so each non-empty bin is as likely. Of every bin the lowest BITS bits are kept: equal bits by chance are
a share 2**-BITS of unequal bins, which likeness() takes out again.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_back, id_key, partitions, session, texts

BINS = 512
BITS = 4
WORDS = 5
SEED = 11


@cache
def _probes(bins: int) -> np.ndarray:
    """Row i: the order in which bin i, if empty, looks for a non-empty one."""
    rng = np.random.default_rng(SEED)
    return np.argsort(rng.random((bins, bins)), axis=1).astype("i4")


def shingle_spans(text: str, words: int) -> tuple[bytes, list[int], list[int]]:
    """The text's words (A-Z in lower case) joined by one space, as UTF-8, and where shingles start and end in it."""
    found = text.encode().lower().split()  # bytes: ASCII white space and A-Z only
    joined = b" ".join(found)
    if not found:
        return joined, [], []
    ends = np.cumsum(np.fromiter(map(len, found), "i8", len(found)) + 1)
    starts, ends = np.append(0, ends[:-1]), ends - 1
    if len(found) <= words:
        return joined, [0], [len(joined)]
    return joined, starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()


def bin_values(text: str, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> np.ndarray | None:
    """The low-order bits of each bin after densification; None for a text without words."""
    joined, starts, ends = shingle_spans(text, words)
    if not starts:
        return None
    digest = xxhash.xxh3_64_intdigest
    hashes = np.sort(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], "u8"))
    at = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype("i8")
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    values, full = np.zeros(bins, "u1"), np.zeros(bins, bool)
    values[at[first]] = (hashes[first] & np.uint64((1 << bits) - 1)).astype("u1")
    full[at[first]] = True
    empty = np.flatnonzero(~full)
    for width in (16, bins):  # most searches are short
        if not len(empty):
            break
        order = _probes(bins)[empty, :width]
        hit = full[order]
        found = hit.any(axis=1)
        source = order[np.arange(len(empty)), hit.argmax(axis=1)]
        values[empty[found]] = values[source[found]]
        empty = empty[~found]
    return values


def pack_values(values: np.ndarray | None, bits: int = BITS) -> str:
    """Base64 of the bins' bits, lowest first; empty for a text without words."""
    if values is None:
        return ""
    flat = (values[:, None] >> np.arange(bits, dtype="u1")) & 1
    return base64.b64encode(np.packbits(flat.ravel(), bitorder="little").tobytes()).decode()


def unpack_values(packed: str, bits: int = BITS) -> np.ndarray | None:
    if not packed:
        return None
    flat = np.unpackbits(np.frombuffer(base64.b64decode(packed), "u1"), bitorder="little").reshape(-1, bits)
    return (flat << np.arange(bits, dtype="u1")).sum(axis=1).astype("u1")


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of the shingle sets, corrected for equal bits by chance; two empty texts: 1."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def fingerprint(text: str | None) -> str:
    return pack_values(bin_values(text or ""))


def edited(text: str, nxt: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + nxt[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in _OUT.split(", ")]


def _rows(triples):
    """triples: (doc_id, text, values of the text, next text, its values)."""
    cols: list[list] = [[] for _ in _NAMES]
    for key, text, own, nxt, other in triples:
        new = edited(text, nxt)
        changed = bin_values(new)
        row = (key, len(text), hashlib.sha256(new.encode()).hexdigest(), pack_values(own), pack_values(changed), likeness(own, changed), likeness(own, other))
        for c, x in zip(cols, row, strict=True):
            c.append(x)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_NAMES)


def _inside(batches):
    """All documents of a sorted partition but the last, each with its follower."""
    held = None
    for batch in batches:
        out = []
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = bin_values(text)
            if held is not None:
                out.append((*held, text, own))
            held = (key, text, own)
        if out:
            yield _rows(out)


def _pairs(batches):
    for batch in batches:
        yield _rows(
            (key, text, bin_values(text), nxt, bin_values(nxt))
            for key, text, nxt in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True)
        )


def key_ranges(keys: DataFrame, count: int) -> list[int]:
    """Up to count - 1 bounds that cut the column key into ranges of about as many rows."""
    cuts = [k / count for k in range(1, count)]
    if not cuts:
        return []
    return sorted(set(keys.select(F.percentile_approx("key", cuts, 20 * count)).first()[0] or []))


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, which ends with the beginning of the next document's text.

    Ranges of doc_id are dealt to partitions and sorted, so neighbours meet in one stream; only the last text of each
    range meets the first one of the next range in a join with a row per range. Bounds and ends of ranges are worked out
    once, from the ids alone, so all plans and retried tasks see the same ones; the driver holds a row per range. A
    null text is empty, a null doc_id sorts last, repeated rows and rows of one id follow one another in the order of their texts;
    very long texts are read and edited whole; one document alone follows itself. An empty table gives an empty result. Other columns are ignored.
    """
    spark = session(docs)
    rows = texts(docs).select("doc_id", "text", id_key().alias("key"))
    count = partitions(spark)
    bounds = np.array(key_ranges(rows.select("key"), count), "i8")

    @F.pandas_udf(T.LongType())
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="left"))

    spans = rows.select("key").withColumn("part", range_of("key")).groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    spans = sorted(tuple(r) for r in spans.collect())
    following = [(last, spans[(k + 1) % len(spans)][1]) for k, (_, _, last) in enumerate(spans)]
    ring = F.broadcast(spark.createDataFrame(following, "last long, next long"))
    ends = F.broadcast(spark.createDataFrame(sorted({(x,) for pair in following for x in pair}), "key long"))
    # two texts at most for each end, whatever the number of rows with its id
    found = rows.join(ends, "key").groupBy("key").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    lasts = found.join(ring, F.col("key") == F.col("last")).select(id_back("key", "doc_id"), F.col("high").alias("text"), "next")
    firsts = found.select(F.col("key").alias("next"), F.col("low").alias("next_text"))
    joined = lasts.join(firsts, "next").select("doc_id", "text", "next_text")

    ordered = rows.withColumn("part", range_of("key")).repartitionById(count, F.col("part").cast("int")).sortWithinPartitions("key", "text")
    return ordered.mapInArrow(_inside, _OUT).unionByName(joined.mapInArrow(_pairs, _OUT))


op1_fingerprints = with_neighbours
