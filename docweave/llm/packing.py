"""Best-fit packing into fixed-length sequences, improved by swap-based local search.

Documents longer than a sequence are cut into full pieces with the odd one first; full pieces need no packing. All
other pieces are dealt at random to shards of about SHARD pieces. A shard is packed by best fit, longest first, and
then pieces move and swap between underfull bins (one for none, one for one, two for one) while that increases the
sum of squared fills; bins that empty are gone. What is still in underfull bins meets the leftovers of other shards
in further rounds.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, session, texts

CAPACITY = 1024
END = 2
SHARD = 60_000
#: Bins at least so full are settled after a round; what is in others meets the leftovers of other shards.
FULL = 1020


TOKENIZER = "byte_bpe_50k"
#: Where pre-tokenizers could part: letters, marks, digits and signs of several scripts, white space, contractions, specials.
_PROBES = (
    "I'm we'll it'D 'tis  a\t\tb \r\n\n c   ", "x1 23 ４５ ⅷ ², 日本語テキスト한글 \u0301e\u0301", "a\u00a0b\u2003c\u200bd\x85e\x1cf\u2028g", "<|endoftext|> <|x|>\n<|endoftext|>", "\U0001f600\U0001f469\u200d\U0001f4bb…—‘’!?!",
)


@cache
def _library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{TOKENIZER}.json"))


def _library_ids(text: str) -> list[int]:
    return _library().encode(text, add_special_tokens=False).ids


@cache
def _encoder():
    """The library's vocabulary, merge order and special tokens in tiktoken, which is four times as fast. None where it can't be
    proved the same: ids must follow the order of the merges, and the library must give the same ids for the probes.
    """
    import json

    import public_tokenizers
    import tiktoken

    model = json.loads(_library().to_str())
    vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(sorted({*range(256)} - {*printable}))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    made = [vocabulary["".join(pair)] for pair in pairs]
    plain = {t: i for t, i in vocabulary.items() if t not in special}
    if model["model"]["type"] != "BPE" or made != sorted(set(made)) or len(plain) != 256 + len(made) or not all(c in byte_of for t in plain for c in t):
        return None
    # ids of bytes come first, then one id per merge: their order is the merges' order
    ranks = {bytes(byte_of[c] for c in t): i for t, i in plain.items()}
    found = tiktoken.Encoding(TOKENIZER, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return found if all(found.encode(x, allowed_special="all") == _library_ids(x) for x in _PROBES) else None


def token_ids(text: str) -> list[int]:
    """Ids without added ones; the string of a special token inside the text gives its id, as the library does."""
    fast = _encoder()
    return fast.encode(text, allowed_special="all") if fast else _library_ids(text)


def checked_ids(batch: list[str]) -> list[list[int]]:
    """Ids of a batch's texts; the library encodes one of them too, and all if that one differs."""
    found = [token_ids(t) for t in batch]
    k = len(batch) // 2
    return found if not batch or found[k] == _library_ids(batch[k]) else [_library_ids(t) for t in batch]


def _pieces(batches):
    for batch in batches:
        made: dict = defaultdict(list)
        for key, found in zip(batch.column("doc_id").to_pylist(), checked_ids(batch.column("text").to_pylist()), strict=True):
            ids = np.array([*found, END], "<u4")
            cuts = [0, *range(len(ids) % CAPACITY or CAPACITY, len(ids) + 1, CAPACITY)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                for name, x in zip(("doc_id", "piece", "start", "length", "ids_crc32"), (key, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                    made[name].append(x)
        yield pa.record_batch(
            [pa.array(made["doc_id"], pa.int64()), pa.array(made["piece"], pa.int32()), *(pa.array(made[c], pa.int64()) for c in ("start", "length", "ids_crc32"))],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins as lists of places in ``lengths``: longest first, each into the fullest bin that has room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    roomy = 0  # bit r: some bin has room r
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = roomy >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                roomy &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room[room - n].append(b)
        roomy |= 1 << (room - n)
    return bins


class _Bins:
    """Bins that take part in the search: their fill, and per length the bins that hold it, least full first."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], taking_part: list[int]):
        self.lengths, self.bins = lengths.tolist(), bins
        self.fill = {k: sum(self.lengths[i] for i in bins[k]) for k in taking_part}
        self.held: dict[int, list[tuple[int, int]]] = {}
        self.sizes = 0  # bit n: some bin may hold a piece of length n
        for k in taking_part:
            self._show(k)

    def _show(self, k: int) -> None:
        for n in {self.lengths[i] for i in self.bins[k]}:
            heapq.heappush(self.held.setdefault(n, []), (self.fill[k], k))
            self.sizes |= 1 << n

    def least_full(self, n: int, *but: int) -> int | None:
        """The least full bin with a piece of length n, other than ``but``. Entries that no longer hold are dropped."""
        heap, aside, found = self.held.get(n, []), [], None
        while heap:
            fill, k = heap[0]
            if self.fill[k] != fill or not any(self.lengths[i] == n for i in self.bins[k]):
                heapq.heappop(heap)
            elif k in but:
                aside.append(heapq.heappop(heap))
            else:
                found = k
                break
        for entry in aside:
            heapq.heappush(heap, entry)
        if not heap:
            self.sizes &= ~(1 << n)
        return found

    def gain(self, changes: dict[int, int]) -> int:
        """By how much the sum of squared fills grows if bins' fills change so."""
        return sum(d * (2 * self.fill[k] + d) for k, d in changes.items())

    def pay(self, moves: list[tuple[int, int, int]]) -> None:
        """Each (length, from, to): a piece of that length moves."""
        for n, a, b in moves:
            i = next(i for i in self.bins[a] if self.lengths[i] == n)
            self.bins[a].remove(i)
            self.bins[b].append(i)
            self.fill[a] -= n
            self.fill[b] += n
        for k in {k for _, a, b in moves for k in (a, b)}:
            self._show(k)


def _steps(bins: _Bins, k: int, capacity: int):
    """Exchanges that would make bin k fuller, most added first of each kind: moves of a piece, a longer one for a
    shorter one, two for one (with each longer piece the longest that fits beside it). Holders are the least full ones."""
    room = capacity - bins.fill[k]

    def longest(most: int):
        mask = bins.sizes & ((1 << (most + 1)) - 1)
        while mask:
            n = mask.bit_length() - 1
            mask ^= 1 << n
            yield n

    for n in longest(room):
        if (b := bins.least_full(n, k)) is not None:
            yield [(n, b, k)]
    own = sorted({bins.lengths[i] for i in bins.bins[k]})
    for a in own:
        for n in longest(room + a):
            if n <= a:
                break
            if (b := bins.least_full(n, k)) is not None and bins.fill[b] - n + a <= capacity:
                yield [(a, k, b), (n, b, k)]
    for a in own:
        for n in longest(room + a - 1):
            if 2 * n <= a:
                break
            if (b := bins.least_full(n, k)) is None or bins.fill[b] - n + a > capacity:
                continue
            m = next((m for m in longest(min(n, room + a - n)) if (c := bins.least_full(m, k, b)) is not None), 0)
            if n + m > a and m:
                yield [(a, k, b), (n, b, k), (m, c, k)]


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int = CAPACITY, seen=None) -> list[list[int]]:
    """Move and swap pieces between underfull bins while the sum of squared fills grows; empty bins go.

    A step is taken only if its exact gain over all bins concerned is positive, and the search ends when no bin has such a step
    left. (A full bin can't take part: any exchange that makes another bin fuller at its cost loses.) ``seen`` is called
    with the gain of each step.
    """
    held = _Bins(lengths, bins, [k for k in range(len(bins)) if lengths[bins[k]].sum() < capacity])
    todo = sorted(held.fill, key=lambda k: -held.fill[k])
    while todo:
        changed: dict[int, None] = {}
        for k in todo:
            while bins[k] and held.fill[k] < capacity:
                for moves in _steps(held, k, capacity):
                    by: Counter = Counter()
                    for n, a, b in moves:
                        by[a] -= n
                        by[b] += n
                    if (gain := held.gain(by)) > 0:
                        held.pay(moves)
                        changed |= dict.fromkeys(by)
                        if seen:
                            seen(gain)
                        break
                else:
                    break
        todo = sorted((k for k in changed if bins[k]), key=lambda k: -held.fill[k])
    return [b for b in bins if b]


def _pack(last: bool):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        bins = local_search(lengths, best_fit(lengths))
        out = group.copy()
        sequence, offset, settled = (np.empty(len(group), t) for t in ("i8", "i8", bool))
        for k, b in enumerate(bins):
            ends = np.cumsum(lengths[b])
            sequence[b], offset[b], settled[b] = (int(key[0]) << 32) | k, ends - lengths[b], last or ends[-1] >= FULL
        return out.assign(sequence_id=sequence, offset=offset, settled=settled)

    return run


_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(pieces: DataFrame, n_pieces: int, shard: int = SHARD) -> DataFrame:
    """Pack pieces of at most CAPACITY ids; adds sequence_id (any distinct longs) and offset (gapless from 0).

    Null doc_ids, equal and repeated pieces are packed each; columns other than _COLUMNS are left out; without pieces there
    is no row. ``pieces`` is a written table: rows are dealt by their place in it too, so shards hold ``shard`` rows on average
    whatever the input, however many rows share an id and a text, and a task's memory is bounded; the second round has the leftovers
    of many shards in one, the third those of the second.
    """
    names = [f.split()[0] for f in _COLUMNS.split(", ")]
    full = pieces.filter(F.col("length") == CAPACITY)
    whole = full.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_, parts = pieces.filter(F.col("length") < CAPACITY), [whole]
    count, base = n_pieces, 0
    for left in (2, 1, 0):
        shards = max(1, round(count / shard))
        dealt = open_.select(*names, (F.pmod(F.xxhash64(F.lit(left), "doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)) + base).alias("shard"))
        last = left == 0 or shards == 1
        made = scratch(dealt.groupBy("shard").applyInPandas(_pack(last), f"{_COLUMNS}, shard long, sequence_id long, offset long, settled boolean"), "packed")
        parts.append(made.filter("settled").select(*names, "sequence_id", "offset"))
        if last:
            break
        open_ = made.filter(~F.col("settled"))
        count, base = open_.count(), base + shards
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame) -> DataFrame:
    """A row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end mark alone; a very long one is encoded whole and cut into as many pieces as it takes.
    Repeated rows are packed each, equal lengths in any order; a null doc_id stays null. An empty table gives an empty
    result. Other columns are ignored.
    """
    session(docs)
    pieces = scratch(texts(docs).mapInArrow(_pieces, _COLUMNS), "pieces")
    return pack(pieces, pieces.filter(F.col("length") < CAPACITY).count())


op8_pack = pack_documents
