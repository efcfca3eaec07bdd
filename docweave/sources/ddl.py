"""CREATE TABLE statements to column rows, by a tokenizer and a parser over its tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from docweave.types import SchemaError

_TOKENS = re.compile(
    r"""(?P<skip>\s+ | /\*.*?\*/ | --[^\n]* | \#[^\n]*)
      | (?P<text>'(?:[^']|'')*' | "(?:[^"]|"")*")
      | (?P<name>`[^`]*` | \w+)
      | (?P<mark>->|.)""",
    re.S | re.X,
)
#: Items of a table's body that are not columns begin with one of these words.
_CONSTRAINTS = frozenset("PRIMARY FOREIGN UNIQUE KEY INDEX CONSTRAINT CHECK FULLTEXT SPATIAL".split())
DEFAULT_TYPE = "VARCHAR(255)"


@dataclass(frozen=True)
class Column:
    table: str
    name: str
    sql_type: str = DEFAULT_TYPE
    nullable: bool = True
    is_pk: bool = False
    is_fk: bool = False
    is_unique: bool = False
    references: str | None = None
    comment: str | None = None

    @property
    def base_type(self) -> str:
        return base_and_args(self.sql_type)[0]


def base_and_args(sql_type: str) -> tuple[str, list[str]]:
    """DECIMAL(12, 2) as DECIMAL and its arguments; what is no type name is taken whole, in upper case."""
    m = re.match(r"\s*([A-Za-z_]+)\s*(?:\(([^)]*)\))?", sql_type or "")
    if not m:
        return (sql_type or "").strip().upper(), []
    return m[1].upper(), [x.strip() for x in (m[2] or "").split(",") if x.strip()]


def _tokens(text: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m[0]) for m in _TOKENS.finditer(text) if m.lastgroup != "skip"]


def _word(token: tuple[str, str]) -> str:
    """A bare word in upper case; quoted names and other tokens are none."""
    return token[1].upper() if token[0] == "name" and token[1][:1] != "`" else ""


def _name(token: tuple[str, str]) -> str:
    return token[1].strip("`")


def _items(tokens: list, at: int) -> tuple[list[list], int]:
    """The comma-separated items from just inside a parenthesis, and the place behind it."""
    items, depth = [[]], 0
    while at < len(tokens):
        mark = tokens[at][1] if tokens[at][0] == "mark" else ""
        if mark == ")" and depth == 0:
            return [x for x in items if x], at + 1
        if mark == "," and depth == 0:
            items.append([])
        else:
            items[-1].append(tokens[at])
            depth += (mark == "(") - (mark == ")")
        at += 1
    return [x for x in items if x], at


def _names_in(tokens: list) -> list[str]:
    return [_name(t) for t in tokens if t[0] == "name"]


def type_and_marks(table: str, name: str, tokens: list) -> Column:
    """A column from the tokens that follow its name: type, key marks and reference."""
    found = Column(table, name)
    at = 0
    if tokens and re.fullmatch(r"[A-Za-z_]+", tokens[0][1]):
        base, at = tokens[0][1], 1
        if at < len(tokens) and tokens[at][1] == "(":
            args, at = _items(tokens, at + 1)
            base += "(" + ",".join("".join(t[1] for t in a) for a in args) + ")"
        found = replace(found, sql_type=base)
    while at < len(tokens):
        word, following = _word(tokens[at]), _word(tokens[at + 1]) if at + 1 < len(tokens) else ""
        if word == "PRIMARY" and following == "KEY":
            found = replace(found, is_pk=True, nullable=False)
        elif word == "UNIQUE":
            found = replace(found, is_unique=True)
        elif word == "NOT" and following == "NULL":
            found = replace(found, nullable=False)
        elif word == "COMMENT" and tokens[at + 1 : at + 2] and tokens[at + 1][0] == "text":
            quoted = tokens[at + 1][1]
            found = replace(found, comment=quoted[1:-1].replace(quoted[0] * 2, quoted[0]) or None)
            break  # what follows a comment does not count
        elif word == "REFERENCES" and len(tokens) > at + 3 and tokens[at + 2][1] == "(":
            found = replace(found, is_fk=True, references=f"{_name(tokens[at + 1])}.{_name(tokens[at + 3])}")
        elif word == "FK" and tokens[at + 1 : at + 2] == [("mark", "->")]:
            target = []
            for kind, value in tokens[at + 2 :]:
                if kind != "name" and value != ".":
                    break
                target.append(value)
            found = replace(found, is_fk=True, references="".join(target))
        at += 1
    return replace(found, is_fk=found.is_fk and not found.is_pk)


def shorthand(table: str, name: str, text: str) -> Column:
    """A column from "INT PRIMARY KEY  -- comment"."""
    body, _, comment = text.partition("--")
    return replace(type_and_marks(table, name, _tokens(body)), comment=comment.strip() or None)


def _constrain(columns: dict[str, Column], item: list) -> None:
    words = [_word(t) for t in item]
    inner = next((_items(item, k + 1)[0] for k, t in enumerate(item) if t[1] == "("), [])
    if words[0] == "PRIMARY":
        for name in _names_in([t for x in inner for t in x]):
            if name in columns:
                columns[name] = replace(columns[name], is_pk=True, is_fk=False, nullable=False)
    elif "FOREIGN" in words:
        at = words.index("REFERENCES") if "REFERENCES" in words else -1
        own = _names_in([t for x in inner for t in x])
        if at >= 0 and len(own) == 1 and own[0] in columns and len(item) > at + 3:
            columns[own[0]] = replace(columns[own[0]], is_fk=not columns[own[0]].is_pk, references=f"{_name(item[at + 1])}.{_name(item[at + 3])}")
    elif words[0] == "UNIQUE":
        for name in _names_in([t for x in inner for t in x]):
            if name in columns:
                columns[name] = replace(columns[name], is_unique=True)


def parse_ddl(text: str) -> tuple[str, dict[str, list[Column]]]:
    """Database name and columns per table, in order of declaration."""
    tokens = _tokens(text)
    words = [_word(t) for t in tokens]
    database, tables, at = "source", {}, 0
    while at < len(tokens):
        # CREATE DATABASE x;  CREATE SCHEMA x;  USE x;
        if words[at] in ("CREATE", "USE"):
            k = at + 1 + (words[at + 1 : at + 2] in (["DATABASE"], ["SCHEMA"]))
            if database == "source" and tokens[k + 1 : k + 2] == [("mark", ";")] and tokens[k][0] == "name":
                database = _name(tokens[k])
        if words[at] == "CREATE" and words[at + 1 : at + 2] == ["TABLE"]:
            at += 2
            if words[at : at + 3] == ["IF", "NOT", "EXISTS"]:
                at += 3
            name = _name(tokens[at])
            if tokens[at + 1 : at + 2] == [("mark", ".")]:
                database = name if database == "source" else database
                at += 2
                name = _name(tokens[at])
            if tokens[at + 1 : at + 2] != [("mark", "(")]:
                continue
            items, at = _items(tokens, at + 2)
            columns: dict[str, Column] = {}
            for item in items:
                if _word(item[0]) not in _CONSTRAINTS and len(item) > 1 and item[0][0] == "name":
                    columns[_name(item[0])] = type_and_marks(name, _name(item[0]), item[1:])
            for item in items:
                if _word(item[0]) in _CONSTRAINTS:
                    _constrain(columns, item)
            if columns:
                tables[name] = list(columns.values())
            continue
        at += 1
    if not tables:
        raise SchemaError("There is no CREATE TABLE statement in this DDL.")
    return database, tables
