"""Tables to collections. A schema has few tables, and each choice depends on those before, so the driver decides."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from docweave.functions.similarity import ratio


@dataclass
class Routing:
    pairs: dict[str, str] = field(default_factory=dict)
    confidence: dict[str, float] = field(default_factory=dict)
    reasoning: dict[str, str] = field(default_factory=dict)
    conflicts: list[str] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t, c, self.confidence.get(t), self.reasoning.get(t), i) for i, (t, c) in enumerate(self.pairs.items())]
        return spark.createDataFrame(rows, "table string, collection string, confidence double, reasoning string, table_ord int")


def closest(table: str, collections: list[str]) -> str:
    """The collection whose name is most like the table's; the first of equals."""
    return max(collections, key=lambda c: ratio(table.lower(), c.lower()))


def resolve(proposals: list[tuple[str, str, float, str]], collections: list[str]) -> Routing:
    """proposals: table, collection, confidence, reason, in order of tables. Each table gets a collection of its own while
    there are any: surest first, then earliest; an unknown collection counts as the closest one, at 0.5 at most.
    """
    out, known = Routing(), []
    for table, choice, sure, reason in proposals:
        if choice not in collections:
            choice, sure = closest(table, collections), min(sure, 0.5)
            out.conflicts.append(f"{table}: the proposed collection does not exist; took {choice}")
        known.append((table, choice, sure))
        out.confidence[table], out.reasoning[table] = sure, reason
    free, chosen = list(collections), {}
    for table, choice, _ in sorted(known, key=lambda p: -p[2]):
        if choice not in free:
            taken, choice = choice, closest(table, free) if free else choice
            out.conflicts.append(f"{table}: {taken} is taken; " + (f"took {choice}" if free else "shares it, as none is left"))
        if choice in free:
            free.remove(choice)
        chosen[table] = choice
    out.pairs = {table: chosen[table] for table, _, _ in known}
    return out
