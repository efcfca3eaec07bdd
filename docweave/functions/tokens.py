"""Tokens of names and comments at two strengths, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import literal_map, split_identifier
from docweave.sources.knowledge import Knowledge


def _expand(key: Column, table: dict[str, list[str]], default: Column) -> Column:
    if not table:
        return default
    return F.coalesce(F.try_element_at(literal_map(table, "array<string>"), key), default)


def core_tokens(name: Column, pack: Knowledge) -> Column:
    """What a name says: its words without stop words, abbreviations spelt out, and the words of its alias; sorted."""
    none = F.array().cast("array<string>")
    stop = F.array(*map(F.lit, pack.stopwords)) if pack.stopwords else none
    words = F.array_except(split_identifier(name), stop)
    spelt = F.flatten(F.transform(words, lambda w: _expand(w, pack.abbreviations, F.array(w))))
    return F.array_sort(F.array_except(F.concat(_expand(F.lower(name), pack.aliases, none), spelt), stop))


def concept_tokens(core: Column, pack: Knowledge) -> Column:
    """Words that mean the same as one of the core, one step away and not in it; sorted."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.flatten(F.transform(core, lambda w: _expand(w, pack.synonyms, none))), core))


def flat(name: Column) -> Column:
    return F.array_join(split_identifier(name), "")
