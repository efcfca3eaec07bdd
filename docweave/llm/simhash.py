"""SimHash near-duplicates by a Gray-order hierarchical index.

Texts become 64-bit fingerprints and equal ones become one row. Two fingerprints that differ in few bits agree in some
blocks of bits, so each is dealt to one bucket per choice of blocks that must agree: those bits are the bucket's root
pattern. Inside a bucket fingerprints are sorted by Gray rank and every FANOUT neighbours are put under a node that
holds the bits they share as a pattern and a mask; nodes are put under nodes in the same way. A search compares nodes
with nodes: the differences in the bits that both share, added up from the root down, are a lower bound for all
pairs below, and a pair of nodes above the bound is dropped whole. Pairs of nodes whose members are linked already
are dropped too, so large groups of near copies don't cost all their pairs, and only a spanning forest is returned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, few_files, id_back, id_key, lookup, partitions, pick_rows, scratch, session, texts
from .components import components
from .fingerprints import shingle_spans

WORDS = 4
SEED = 42
DISTANCE = 4
FANOUT = 8
#: Fingerprints that share a bucket by chance, at most about.
BUCKET = 256
#: Node pairs that are compared at once, those whose rows are, and rows that are indexed at once: they bound a task's memory.
PAIRS, BLOCK, ROWS = 1 << 14, 1 << 10, 1 << 18
#: Pairs that are verified between two looks at what is connected by then.
CHUNK = 256
#: Rows of whole buckets that are searched at once: more save no time, but take memory.
TOGETHER = 1 << 14


def simhash(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Bit set if set in more than half the shingles' XXH64 hashes; 0 for a text without words."""
    joined, starts, ends = shingle_spans(text, words)
    if not starts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], "<u8")
    total = np.zeros(64, "i8")
    for k in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[k : k + (1 << 15)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(words: int, seed: int):
    def run(batches):
        for batch in batches:
            made = np.array([simhash(t, words, seed) for t in batch.column("text").to_pylist()], "u8").view("i8")
            yield pa.record_batch([batch.column("doc_id"), pa.array(made)], names=["doc_id", "fp"])

    return run


def gray_rank(c: Column) -> Column:
    """Place of a 64-bit word in the Gray code's order, as an unsigned number."""
    for k in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, k))
    return c


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """Blocks into which 64 bits are cut so that chance fills a bucket with BUCKET of n fingerprints at most."""
    for blocks in range(distance + 2, 64):
        if n / 2 ** (64 * (blocks - distance) // blocks) <= BUCKET:
            return blocks
    return 63


def choices(blocks: int, distance: int = DISTANCE) -> list[int]:
    """Masks of the bits that agree: every choice of blocks - distance of the blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(x) for x in combinations(parts, blocks - distance)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype="i4")


class _Union:
    """Labels of rows; joins labels by pairs of rows."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if not (open_ := low != high).any():
                return
            parent = np.arange(len(self.label))
            np.minimum.at(parent, high[open_], low[open_])
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.label = parent[self.label]


def link_sorted(fp: np.ndarray, bucket: np.ndarray, distance: int = DISTANCE, label: np.ndarray | None = None, linked=None) -> np.ndarray:
    """fp: fingerprints, a row of 64-bit words each, sorted by bucket and Gray rank. Returns for each row the first row of its
    bucket that it is connected with by links of ``distance`` bits or fewer.

    ``label``: the first row with which a row is known to be connected. ``linked(a, b)``: which of the pairs of rows within the
    distance are links indeed, for arrays a and b; it is asked about rows that aren't connected yet.
    """
    n, width = fp.shape
    union = _Union(n)
    if label is not None:
        union.label = label.copy()
    if n < 2:
        return union.label

    def join(a: np.ndarray, b: np.ndarray) -> None:
        if linked is None:
            return union.join(a, b)
        for k in range(0, len(a), CHUNK):
            x, y = a[k : k + CHUNK], b[k : k + CHUNK]
            apart = union.label[x] != union.label[y]
            x, y = x[apart], y[apart]
            if len(x) and (yes := linked(x, y)).any():
                union.join(x[yes], y[yes])

    near = np.flatnonzero((bucket[1:] == bucket[:-1]) & (_popcount(fp[1:] ^ fp[:-1]) <= distance))
    join(near, near + 1)
    # levels of nodes, leaves first: value, mask, bucket, first child, end of children
    levels = [(fp, np.full((n, width), 2**64 - 1, "u8"), bucket, np.arange(n), np.arange(1, n + 1))]
    rows_of = [np.arange(n)]  # first row below each node
    while True:
        value, mask, of, _, _ = levels[-1]
        start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        rank = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
        first = np.flatnonzero(rank % FANOUT == 0)
        if len(first) == len(of):
            break
        differs = np.bitwise_or.reduceat(value ^ np.repeat(value[first], np.diff(np.append(first, len(of))), axis=0), first, axis=0)
        shared = np.bitwise_and.reduceat(mask, first, axis=0) & ~differs
        levels.append((value[first] & shared, shared, of[first], first, np.append(first[1:], len(of))))
        rows_of.append(rows_of[-1][first])
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    stack = [(top, roots, roots)]

    def uniform(level: int):
        """The label of all rows below a node, or -1."""
        low = np.minimum.reduceat(union.label, rows_of[level])
        return np.where(low == np.maximum.reduceat(union.label, rows_of[level]), low, -1)

    def rows_near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows below pairs of the lowest nodes that are within the distance."""
        _, _, _, first, end = levels[1]
        found = [(a[:0], b[:0])]
        for k in range(0, len(a), BLOCK):
            # a node of fewer rows than FANOUT repeats its last one
            x, y = (np.minimum(first[c] + np.arange(FANOUT)[:, None], end[c] - 1) for c in (a[k : k + BLOCK], b[k : k + BLOCK]))
            others = [word[y] for word in words]
            for row in x:
                apart = np.zeros(1, "u2")
                for j in range(0, width, 3):  # three words differ in 192 bits at most, which a byte holds
                    some = np.bitwise_count(words[j][row] ^ others[j])
                    for word, other in zip(words[j + 1 : j + 3], others[j + 1 : j + 3], strict=True):
                        some += np.bitwise_count(word[row] ^ other)
                    apart = apart + some
                at, of = np.nonzero(apart <= distance)
                found.append((row[of], y[at, of]))
        x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        return x[x < y], y[x < y]

    words = [np.ascontiguousarray(fp[:, k]) for k in range(width)]
    known: dict[int, np.ndarray] = {}
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIRS:
            stack += [(level, a[k : k + PAIRS], b[k : k + PAIRS]) for k in range(0, len(a), PAIRS)]
            continue
        if level not in known:
            known[level] = uniform(level)
        whole = known[level]
        open_ = (whole[a] < 0) | (whole[a] != whole[b])
        a, b = a[open_], b[open_]
        value, mask, _, first, end = levels[level]
        # the bits that both share include those that their parents shared: differences add up on the way down
        open_ = _popcount((value[a] ^ value[b]) & mask[a] & mask[b]) <= distance
        a, b = a[open_], b[open_]
        if not len(a):
            continue
        if level == 0:  # buckets of one row each
            continue
        if level == 1:
            a, b = rows_near(a, b)
            if len(a):
                join(a, b)
                known.clear()
            continue
        na, nb = end[a] - first[a], end[b] - first[b]
        each = na * nb
        which = np.repeat(np.arange(len(a)), each)
        k = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
        x, y = first[a][which] + k // nb[which], first[b][which] + k % nb[which]
        keep = x <= y
        stack.append((level - 1, x[keep], y[keep]))
    # the least label is the first row of the component
    return union.label


def _links(distance: int, limit: int):
    def marker(bucket, rows):
        return pa.record_batch([pa.array([bucket], pa.int64()), pa.array([rows], pa.int64()), pa.array([True])], names=["u", "v", "hot"])

    def edges(bucket, node, fp):
        new = np.append(True, bucket[1:] != bucket[:-1])
        several = ~(new & np.append(new[1:], True))
        bucket, node, fp = bucket[several], node[several], fp[several]
        stops, begin = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(fp)), 0
        while begin < len(fp):
            # the buckets that end within TOGETHER rows, or the next one alone
            end = int(stops[max(np.searchsorted(stops, begin + TOGETHER, "right") - 1, np.searchsorted(stops, begin, "right"))])
            ends = link_sorted(fp[begin:end], bucket[begin:end], distance)
            moved = np.flatnonzero(ends != np.arange(end - begin))
            if len(moved):
                yield pa.record_batch([pa.array(node[begin + moved]), pa.array(node[begin + ends[moved]]), pa.array([False] * len(moved))], names=["u", "v", "hot"])
            begin = end

    def run(batches):
        held, count = [], 0  # rows of whole buckets and of the one that is still coming in
        hot, seen = None, 0  # a bucket of more than ``limit`` rows, and how many so far: left to further rounds

        for batch in batches:
            words = [c for c in batch.schema.names if c[0] == "w"]
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            bucket, node, fp = column("bucket"), column("node"), np.column_stack([column(c) for c in words]).view("u8")
            if hot is not None:
                more = int(np.argmax(bucket != hot)) if (bucket != hot).any() else len(bucket)
                seen += more
                if more == len(bucket):
                    continue
                yield marker(hot, seen)
                hot, bucket, node, fp = None, bucket[more:], node[more:], fp[more:]
            held.append((bucket, node, fp))
            count += len(bucket)
            if count >= limit:
                bucket, node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[-1])  # the last bucket may go on
                yield from edges(bucket[:cut], node[:cut], fp[:cut])
                held, count = [(bucket[cut:], node[cut:], fp[cut:])], len(bucket) - cut
                if count >= limit:
                    hot, seen, held, count = int(bucket[-1]), count, [], 0
        if hot is not None:
            yield marker(hot, seen)
        if count:
            yield from edges(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def link_fingerprints(fps: DataFrame, masks: list[list[int]], distance: int, limit: int = ROWS, width: int | None = None) -> DataFrame:
    """fps: node long, w0, w1, ... long, distinct. ``masks``: the bits, by word, that agree in a bucket, one per choice.
    ``width``: words that are compared, all if not given; the others only choose buckets.

    Returns pairs u, v of nodes that connect what links of ``distance`` bits or fewer within the buckets connect: a
    spanning forest per bucket, not all pairs. A bucket of ``limit`` fingerprints or more, such as a huge group of near
    copies, is cut into parts, each searched alone. What that connects needs no further pairs: only fingerprints outside
    the bucket's largest component then meet all its parts. If these are many, every two parts meet in a bucket of their own.
    No task holds more than about ``limit`` rows, none is left out, and the parts spread over the cluster.
    """
    spark, words = fps.sparkSession, [c for c in fps.columns if c != "node"]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    # One hash per choice and agreeing bits: a chance collision adds a comparison, never a link.
    keys = F.array(*(F.xxhash64(F.lit(k), *(F.col(w).bitwiseAND(F.lit(signed(m))) for w, m in zip(words, mask, strict=True) if m)) for k, mask in enumerate(masks)))
    words = words[:width]
    ranks = [gray_rank(F.col(w)).bitwiseXOR(F.lit(-(2**63))) for w in words]

    def search(dealt: DataFrame) -> DataFrame:
        ordered = dealt.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", *ranks)
        held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 65536)  # rows of a few longs
        try:
            return scratch(ordered.select("bucket", "node", *words).mapInArrow(_links(distance, limit), "u long, v long, hot boolean"), "links")
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)

    dealt, out = fps.select("node", *words, F.explode(keys).alias("bucket")), None
    while True:
        found = search(dealt)
        pairs = found.filter("not hot").select("u", "v")
        out = pairs if out is None else out.unionByName(pairs)
        # a row per hot bucket, of ``limit`` rows or more each
        hot = scratch(found.filter("hot").select(F.col("u").alias("bucket"), F.col("v").alias("rows"), F.ceil(F.col("v") / max(1, limit // 4)).alias("parts")), "hot")
        total = hot.agg(F.sum("rows")).first()[0]
        if not total:
            return out
        split = scratch(lookup(dealt, hot, "bucket", "rows", total).filter("parts is not null").withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("parts"))), "split")
        within = lambda part: F.xxhash64("bucket", part).alias("bucket")
        out = out.unionByName(search(split.select("node", *words, within("own"))).filter("not hot").select("u", "v"))
        label = components(out)
        open_ = scratch(split.drop("rows").join(label.withColumnRenamed("u", "node"), "node", "left").withColumn("of", F.coalesce("m", "node")).drop("m"), "open")
        each = open_.groupBy("bucket", "of").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "of")).alias("most"))
        each = scratch(each.select("bucket", "rows", F.col("most.of").alias("most"), (F.col("rows") - F.col("most.n")).alias("few")), "buckets")
        rows = lookup(open_, each, "bucket", "rows", total).filter("few > 0").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        star = F.col("few") <= max(1, limit // 4)
        met = rows.filter(star & ((F.col("of") != F.col("most")) | (F.col("other") == F.col("own")))).select("node", *words, within("other"))
        dealt = scratch(met.unionByName(rows.filter(~star).select("node", *words, F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))), "dealt")


def _group(rows: DataFrame, words: list[str], masks, distance: int) -> DataFrame:
    """rows: doc_id, node, words. Adds size (rows of the node) and first (least id key of the component)."""
    total = rows.count()
    groups = scratch(few_files(rows.groupBy("node", *words).agg(F.min(id_key()).alias("least"), F.count(F.lit(1)).alias("size")), total), "groups")
    count = groups.count()
    found = components(link_fingerprints(groups.select("node", *words), masks(count), distance))
    # only linked nodes meet by their component, of which one may be huge; minima are combined before the shuffle
    linked = found.join(groups.select(F.col("node").alias("u"), "least"), "u")
    first = linked.join(linked.groupBy("m").agg(F.min("least").alias("first")), "m").select(F.col("u").alias("node"), "first")
    named = groups.join(first, "node", "left").select("node", "size", F.coalesce("first", "least").alias("first"))
    named = scratch(few_files(named, count), "named")
    return lookup(rows, named, "node", "size", total)


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """Group documents whose fingerprints are connected by links of ``distance`` differing bits or fewer.

    Returns a row per input row: doc_id, fp (signed long), component_id (the smallest doc_id of the group). Null and
    empty texts and texts of white space have fingerprint 0, linked like any other; very long texts are read whole; repeated
    rows give rows each; a
    null doc_id sorts last and a group of null ids alone has a null component_id. An empty table gives an empty
    result. Other columns are ignored.
    """
    session(docs)
    made = texts(docs).mapInArrow(_fingerprints(words, seed), "doc_id long, fp long")
    rows = scratch(made.select("doc_id", F.col("fp").alias("node"), F.col("fp").alias("w0")), "fingerprints")
    found = _group(rows, ["w0"], lambda n: [[m] for m in choices(blocks_for(n, distance), distance)], distance)
    return found.select("doc_id", F.col("node").alias("fp"), id_back("first", "component_id"))


def op2_simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates at a given likeness: the same index over wide SimHash fingerprints of the shingle sets, whose bound lets
# every pair at the likeness through, gives groups of candidates; inside a group shingle sets decide.

LIKE_WORDS, LIKENESS = 5, 0.8
#: Groups of more rows first meet one of them, and then go through the index.
SMALL = 9
#: Rows of a large group that meet as many others in one task.
PART = 512
#: 64-bit words of a wide fingerprint, those of them that buckets compare, and standard errors by which a pair at the likeness
#: may differ more than it should.
WIDE, HELD, ERRORS = 8, 4, 4.5
#: Shingles from which on a set's sums are as good as normal variates.
MANY = 64
#: Shingles from which on a set is compared as a sorted array: a Python set of it takes ten times the memory.
LONG = 512
#: Wide fingerprints that share a bucket by chance, at most about, and how likely a pair at the likeness shares one at least.
CROWD, MEET = 4096, 0.9995


def shingle_set(text: str, words: int = LIKE_WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    joined, starts, ends = shingle_spans(text, words)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], "u8"))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of shingle_set(), as bytes; two empty ones are alike."""
    x, y = np.frombuffer(a, "u8"), np.frombuffer(b, "u8")
    both = _common(x, y)
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _node(hashes: np.ndarray) -> int:
    """Names a shingle set: texts of equal sets are one node."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63


def _noted(words: int):
    def run(batches):
        for batch in batches:
            found = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            nodes = pa.array([_node(x) for x in found], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("version"), nodes, *_columns(found)], names=["doc_id", "version", "node", *WORDS_OF])

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            found = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array([_node(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "shingles"])

    return run


def _alike(likeness: float):
    def run(batches):
        for batch in batches:
            found = [similarity(a, b) >= likeness for a, b in zip(batch.column("u_set").to_pylist(), batch.column("v_set").to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(found, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """The pairs u, v whose shingle sets have the likeness. sets: node, shingles."""
    total = pairs.count()
    for side in ("u", "v"):
        # one node can be in very many pairs
        degree = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("size"))
        own = sets.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set")).join(degree, side)
        pairs = lookup(pairs, own, side, "size", total).drop("size")
    return scratch(pairs.select("u", "v", "u_set", "v_set").mapInArrow(_alike(likeness), "u long, v long"), "alike")


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE words of 64 bits from a shingle set: a bit is 1 if it is in more than half of the shingles' mixed hashes. In half of them it
    is that of one shingle, another one for each byte, so that sets of few shingles have no bits in common by ties. Without
    shingles all are 0."""
    total, even = np.zeros(64 * WIDE, "i8"), np.zeros(64 * WIDE, "u1")
    for k in range(0, len(hashes), 1 << 12):
        mixed = _mixed(hashes[k : k + (1 << 12)])
        total += np.unpackbits(mixed, axis=1, bitorder="little").sum(axis=0, dtype="u2")
        if not k:
            chosen = np.roll(mixed, 1, axis=1).argmin(axis=0)
            even = np.unpackbits(mixed[chosen, np.arange(8 * WIDE)], bitorder="little")
    return np.packbits(2 * total + even > len(hashes), bitorder="little").view("u8")


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """WIDE mixed hashes for each, as bytes."""
    x = hashes[:, None] + (np.arange(1, WIDE + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x.view("u1").reshape(len(x), -1)


def differing(likeness: float, shingles: int = 0) -> float:
    """Share of bits in which the wide fingerprints of two sets of this Jaccard similarity, of ``shingles`` each or more, differ, at most.

    Large sets of one size and similarity s have a cosine of 2s/(1+s), those of other sizes a greater one. Of small sets, whose
    sums are no normal variates, four shingles of five differ most: 3 bits in 16.
    """
    return max(float(np.arccos(2 * likeness / (1 + likeness)) / np.pi), 0 if shingles >= MANY else 3 / 16)


def wide_distance(likeness: float, width: int = WIDE, shingles: int = 0) -> int:
    """Bits in which ``width`` words of two such fingerprints differ at most, but for ERRORS standard errors."""
    bits, differs = 64 * width, differing(likeness, shingles)
    return int(bits * differs + ERRORS * (bits * differs * (1 - differs)) ** 0.5)


def samples(n: int, likeness: float = LIKENESS) -> list[list[int]]:
    """Masks, by word, of the bits that agree in a bucket: so many bits that chance fills a bucket with CROWD of n fingerprints at
    most, and so many choices of bits that a pair at the likeness shares a bucket with probability MEET. Up to CROWD
    fingerprints there is one bucket for all."""
    bits, differs = 64 * WIDE, differing(likeness)
    each = max(0, int(np.ceil(np.log2(max(1, n) / CROWD))))
    apart = np.arange(bits + 1)
    logs = np.append(0, np.cumsum(np.log(np.arange(1, bits + 1))))
    chance = np.exp(logs[bits] - logs - logs[::-1] + apart * np.log(differs) + (bits - apart) * np.log(1 - differs))
    agree = np.prod([np.maximum(bits - apart - k, 0) / (bits - k) for k in range(each)], axis=0)
    missed, count = chance * (1 - agree), 1
    while missed.sum() > 1 - MEET:
        missed, count = missed * (1 - agree), count + 1
    rng, order, out = np.random.default_rng(SEED), [], []
    for _ in range(count):
        if len(order) < each:  # every bit is used once before any is used again
            order = rng.permutation(bits).tolist()
        mask = [0] * WIDE
        for k in order[:each]:
            mask[k // 64] |= 1 << k % 64
        order = order[each:]
        out.append(mask)
    return out


WORDS_OF = [f"w{k}" for k in range(WIDE)]


def _columns(sets: list[np.ndarray]) -> list[pa.Array]:
    """The wide fingerprints of shingle sets, a column per word."""
    words = np.array([wide_fingerprint(x) for x in sets], "u8").reshape(len(sets), WIDE).view("i8")
    return [pa.array(words[:, k]) for k in range(WIDE)]


def _wide(batches):
    for batch in batches:
        found = [np.frombuffer(x, "u8") for x in batch.column("shingles").to_pylist()]
        yield pa.record_batch([batch.column("node"), batch.column("shingles"), *_columns(found)], names=["node", "shingles", *WORDS_OF])


def _search_alike(likeness: float):
    """Links of rows sorted by bucket and Gray rank, as a spanning forest of what the rows' labels don't connect yet."""
    distance, closer = wide_distance(likeness), wide_distance(likeness, shingles=MANY)

    def links(rows):
        node, of, words, sets = zip(*rows, strict=True)
        node, of, words, size = np.array(node), np.array(of), np.array(words, "i8").view("u8"), np.array([len(x) // 8 for x in sets])
        held: dict = {}

        def members(k: int) -> frozenset:
            if k not in held:
                held[k] = frozenset(np.frombuffer(sets[k], "u8").tolist())
            return held[k]

        def linked(a, b):
            out = np.zeros(len(a), bool)
            least = np.minimum(size[a], size[b])
            near = (_popcount(words[a] ^ words[b]) <= np.where(least < MANY, distance, closer)) & (least >= likeness * np.maximum(size[a], size[b]))
            for at in np.flatnonzero(near).tolist():
                x, y = int(a[at]), int(b[at])
                both = len(members(x) & members(y)) if max(size[x], size[y]) < LONG else _common(np.frombuffer(sets[x], "u8"), np.frombuffer(sets[y], "u8"))
                out[at] = both >= likeness * (size[x] + size[y] - both)
            return out

        _, first, back = np.unique(of, return_index=True, return_inverse=True)
        label = link_sorted(words, np.zeros(len(node), "i8"), distance, first[back], linked)
        new = np.flatnonzero(label != first[back])
        return pa.record_batch([pa.array(node[new], pa.int64()), pa.array(node[label[new]], pa.int64())], names=["u", "v"])

    def run(batches):
        at, rows = None, []
        for batch in batches:
            words = zip(*(batch.column(w).to_pylist() for w in WORDS_OF), strict=True)
            for bucket, *row in zip(batch.column("bucket").to_pylist(), batch.column("node").to_pylist(), batch.column("of").to_pylist(), words, batch.column("shingles").to_pylist(), strict=True):
                if bucket != at and rows:
                    yield links(rows)
                    rows = []
                at = bucket
                rows.append(row)
        if rows:
            yield links(rows)

    return run


def _link_alike(shared: DataFrame, sets: DataFrame, likeness: float) -> DataFrame | None:
    """shared: bucket, node: groups of candidates. Returns u, m as components() does, of the verified links of nodes that share a
    bucket; None if none do.

    All pairs of a small bucket are verified. A larger one, such as a huge group of near copies, first meets one of its rows;
    what that leaves outside its largest component then meets all its rows, in parts of PART by PART, where the index prunes and
    no pair is formed of rows that are connected by then. So no pair of a large bucket is ever a row of a table.
    """
    spark = shared.sparkSession
    sizes = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("star"))
    total = shared.count()
    rows = scratch(lookup(shared, sizes.select("bucket", "size", F.col("star.node").alias("star")), "bucket", "size", total), "open")
    small, large = rows.filter(F.col("size") <= SMALL), rows.filter(F.col("size") > SMALL)
    met = small.select("bucket", F.col("node").alias("x")).join(small.select("bucket", F.col("node").alias("y")), "bucket").filter("x < y").select("x", "y")
    met = met.unionByName(large.filter("node <> star").select(F.col("node").alias("x"), F.col("star").alias("y")))
    met = scratch(met.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "met")
    if met.isEmpty():
        return None
    found = verified(met, sets, likeness)
    drop_scratch(met)
    label = components(found)
    open_ = scratch(large.select("bucket", "node").join(label.withColumnRenamed("u", "node"), "node", "left").select("bucket", "node", F.coalesce("m", "node").alias("of")), "open")
    each = open_.groupBy("bucket", "of").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "of")).alias("most"))
    each = each.select("bucket", "size", F.col("most.of").alias("most"), (F.col("size") - F.col("most.n")).alias("few"))
    rows = scratch(lookup(open_, each, "bucket", "size", total).filter("few > 0"), "unconnected")
    if rows.isEmpty():
        return label
    part = lambda size, salt: F.pmod(F.xxhash64("node", "bucket", F.lit(salt)), F.ceil(F.col(size) / PART))
    every = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(size) / PART) - 1))
    many = rows.withColumn("p", part("size", 0)).withColumn("q", every("few"))
    few = rows.filter("of <> most").withColumn("q", part("few", 1)).withColumn("p", every("size"))
    dealt = scratch(many.unionByName(few).select(F.xxhash64("bucket", "p", "q").alias("bucket"), "node", "of").distinct(), "dealt")
    wide = scratch(sets.join(dealt.select("node").distinct(), "node", "left_semi").mapInArrow(_wide, "node long, shingles binary, " + ", ".join(f"{w} long" for w in WORDS_OF)), "wide")
    ranks = [gray_rank(F.col(w)).bitwiseXOR(F.lit(-(2**63))) for w in WORDS_OF]
    ordered = dealt.join(wide, "node").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", *ranks)
    new = scratch(ordered.mapInArrow(_search_alike(likeness), "u long, v long"), "links")
    for done in (open_, rows, dealt, wide):
        drop_scratch(done)
    return label if new.isEmpty() else components(found.unionByName(new))


def like_documents(docs: DataFrame, words: int = LIKE_WORDS, likeness: float = LIKENESS) -> DataFrame:
    """Group documents connected by pairs whose sets of shingles of ``words`` have a Jaccard similarity of ``likeness`` or more.

    Wide SimHash fingerprints are dealt to buckets and linked by the Gray-order index, as in near_duplicates(), within a bound that is loose.
    What that connects are candidates, verified by their whole sets of 64-bit shingle hashes, so no pair below the likeness is a
    link; of the pairs at 0.8 the buckets miss 1 - MEET at most by their formula, the bounds a few in 100,000 of the sets that differ most.
    Returns a row per input row: doc_id, version (hash of the text), component_id, first (its key), root (names the group, also where groups share a
    key). Texts without words are one group. Nulls, repeats and other columns as in near_duplicates().
    """
    session(docs)
    made = texts(docs).select("doc_id", "text", F.xxhash64("text").alias("version"))
    rows = scratch(made.mapInArrow(_noted(words), "doc_id long, version long, node long, " + ", ".join(f"{w} long" for w in WORDS_OF)), "fingerprints")
    own = F.min(F.struct(id_key().alias("key"), "version")).alias("own")
    total = rows.count()
    groups = scratch(few_files(rows.groupBy("node").agg(own, F.count(F.lit(1)).alias("size"), *(F.min(w).alias(w) for w in WORDS_OF)), total), "groups")
    near = link_fingerprints(groups.select("node", *WORDS_OF), samples(groups.count(), likeness), wide_distance(likeness, HELD), width=HELD)
    shared = components(near).select(F.col("m").alias("bucket"), F.col("u").alias("node"))
    drop_scratch(near)
    # one text of each node that has a candidate
    wanted = groups.join(shared.select("node").distinct(), "node", "left_semi").select("own.key", "own.version", F.lit(1).cast("long").alias("times"))
    sets = scratch(pick_rows(texts(docs), wanted).mapInArrow(_sets(words), "node long, shingles binary"), "sets")
    label = _link_alike(shared, sets, likeness)
    for done in (shared, sets):
        drop_scratch(done)
    rooted = groups.select("node", "size", F.col("own.key").alias("least"), F.col("node").alias("root"))
    if label is not None:
        rooted = rooted.drop("root").join(label.withColumnRenamed("u", "node"), "node", "left").select("node", "size", "least", F.coalesce("m", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("first"))
    named = scratch(rooted.join(first, "root").select("node", "size", "first", "root"), "named")
    found = lookup(rows.select("doc_id", "version", "node"), named, "node", "size", total)
    return found.select("doc_id", "version", "first", "root", id_back("first", "component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of like documents, same columns: the smallest doc_id's (one row if it repeats).

    Null ids come last, and of rows with one id the least text hash's stays. Null and empty texts and those of white space are
    a group; very long texts are compared whole; equal and repeated rows are one document; columns of any name are passed on;
    an empty table gives an empty result.
    """
    # groups of null ids alone share a key, as do those of a doc_id with several texts: each group is a root of its own
    keep = like_documents(docs).groupBy("root").agg(F.min(F.struct(id_key().alias("key"), "version")).alias("own"))
    return pick_rows(docs, keep.select("own.key", "own.version", F.lit(1).cast("long").alias("times")))
