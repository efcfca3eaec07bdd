"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both agree for certain.

Pieces are merges of neighbouring characters, so no piece crosses a place between characters a and b if no piece of
the vocabulary holds a followed by b: the pieces before and after such a place don't depend on each other. A place of
this kind inside the overlap, at which both encodings start a piece, is a proven boundary. If an overlap has none, it
is widened, up to the whole rest of the text.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import session, texts

MODEL = "piece_bpe_32k.model"
#: Code points of a chunk and, at first, of an overlap.
CHUNK, OVERLAP = 16_384, 64
LIMIT = 4096
_MARK = "▁"


@cache
def _model(name: str):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pairs = set()
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i)
            pairs.update(zip(piece, piece[1:], strict=False))
    return model, pairs


def _starts(model, text: str) -> list[int]:
    """Code point offset at which each token starts. (The library gives bytes; the bytes of one character start alike.)"""
    begins = np.array([p.begin for p in model.encode(text, return_type="proto").pieces], "i8")
    lead = (np.frombuffer(text.encode(), "u1") & 0xC0) != 0x80
    return (np.append(np.cumsum(lead) - 1, len(text))[begins]).tolist()


def _proven(text: str, at: int, pairs: set) -> bool:
    a, b = (_MARK if c == " " else c for c in (text[at - 1], text[at]))
    return (a, b) not in pairs


def count_huge(text: str, name: str = MODEL, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, encoded in chunks of ``chunk`` code points."""
    model, pairs = _model(name)
    total, at, end = 0, 0, min(chunk, len(text))
    starts = _starts(model, text[:end])
    low = 0  # offset in the text from which tokens of the present chunk count
    while end < len(text):
        # the next chunk begins before the end of the present one, by ever more until both share a proven boundary
        width, splice = overlap, None
        while True:
            nxt = max(low, end - width)
            if nxt <= low and width > chunk:
                # nothing in the present chunk to splice at: extend it instead
                end = min(len(text), end + chunk)
                starts = _starts(model, text[at:end])
                if end == len(text):
                    break
                width = overlap
                continue
            more_end = min(len(text), nxt + chunk)
            more = _starts(model, text[nxt:more_end])
            own = {s + at for s in starts}
            common = [s + nxt for s in more if s and low < s + nxt < end and s + nxt in own and _proven(text, s + nxt, pairs)]
            if common:
                splice = common[len(common) // 2]
                break
            width *= 2
        if splice is None:
            break
        total += sum(low <= s + at < splice for s in starts)
        at, end, starts, low = nxt, more_end, more, splice
    return total + sum(s + at >= low for s in starts)


def _counts(name: str, limit: int, chunk: int):
    def run(batches):
        for batch in batches:
            found = batch.column("text").to_pylist()
            short = [t for t in found if len(t) <= chunk]
            counted = iter(map(len, _model(name)[0].encode(short, num_threads=1)) if short else ())
            n = [next(counted) if len(t) <= chunk else count_huge(t, name, chunk) for t in found]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in found], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, name: str = MODEL, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row; a narrow pass without a shuffle.

    A null text counts as empty (no bytes, no tokens); texts of more than ``chunk`` code points are counted by count_huge(),
    however long; repeated rows and null doc_ids give rows like any other; an
    empty table gives an empty result. Other columns are ignored. ``name`` is a file of the public tokenizers.
    """
    session(docs)
    return texts(docs).mapInArrow(_counts(name, limit, chunk), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


op6_token_counts = token_counts
