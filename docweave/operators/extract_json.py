"""A JSON object out of free text, for adjudicators that answer in prose."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_QUOTED = re.compile(r'"(?:\\.|[^"\\])*"?', re.S)


def _spans(text: str):
    yield text.strip()
    yield from (m[1].strip() for m in _FENCED.finditer(text))
    start = text.find("{")
    if start >= 0:
        # strings can hold braces: blank them out, keep places
        bare = _QUOTED.sub(lambda m: " " * len(m[0]), text[start:])
        depth = 0
        for m in re.finditer("[{}]", bare):
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                yield text[start : start + m.end()]
                return


def extract(text: str | None) -> dict | None:
    """The first object among: the whole text, its fenced blocks, its first balanced braces."""
    for span in _spans(text or ""):
        try:
            found = json.loads(span)
        except json.JSONDecodeError:
            continue
        if isinstance(found, dict):
            return found
    return None


@F.pandas_udf(T.StringType())
def extract_json(text: pd.Series) -> pd.Series:
    """The object as compact JSON with sorted keys, or null."""
    found = (extract(t) for t in text)
    return pd.Series([None if x is None else json.dumps(x, sort_keys=True, separators=(",", ":")) for x in found], dtype="object")
