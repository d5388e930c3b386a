"""Schema changes: reading an ALTER statement, and planning the target table from it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from ..spec import Column, TableSpec, UniqueKey

_NAME = r"(?:`(?:[^`]|``)+`|[\w$]+)"


@dataclass
class Change:
    """One clause: what is done to which column."""

    kind: str  # add, drop, change, modify, rename, add_key, drop_key, other
    name: str = ""
    new_name: str = ""
    definition: str = ""
    place: str | None = None  # "" first, a name: after it


@dataclass
class Alter:
    """A parsed statement."""

    schema: str | None = None
    table: str | None = None
    changes: list[Change] = field(default_factory=list)
    renames_table: bool = False
    auto_increment: int | None = None

    def renamed(self) -> dict[str, str]:
        return {c.name: c.new_name for c in self.changes if c.kind in ("change", "rename") and c.new_name}

    def real_renames(self) -> dict[str, str]:
        """Renames that aren't to the same name."""
        return {a: b for a, b in self.renamed().items() if a != b}

    def dropped(self) -> set[str]:
        return {c.name for c in self.changes if c.kind == "drop"}


def split_clauses(text: str) -> list[str]:
    """Clauses at the commas outside brackets and quotes."""
    out, depth, quote, own = [], 0, "", []
    i = 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\" and quote != "`" and i + 1 < len(text):
                own.append(c)
                i += 1
                c = text[i]
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and depth == 0:
            out.append("".join(own).strip())
            own, c = [], ""
        own.append(c)
        i += 1
    return [x for x in [*out, "".join(own).strip()] if x]


def _bare(name: str) -> str:
    return name[1:-1].replace("``", "`") if name.startswith("`") else name


def parse(statement: str) -> Alter:
    """An ALTER statement, or its clauses alone."""
    out = Alter()
    text = statement.strip().rstrip(";")
    if m := re.match(rf"alter\s+table\s+(?:({_NAME})\s*\.\s*)?({_NAME})\s+", text, re.I):
        out.schema, out.table = m[1] and _bare(m[1]), _bare(m[2])
        text = text[m.end() :]
    for clause in split_clauses(text):
        out.changes.append(_clause(clause, out))
    return out


def _clause(clause: str, out: Alter) -> Change:
    plain = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", clause)  # words inside strings mean nothing
    if m := re.search(r"(?:^|\s)auto_increment\s*=?\s*(\d+)", plain, re.I):
        out.auto_increment = int(m[1])
    place = None
    if m := re.search(rf"\s(?:(first)|after\s+({_NAME}))\s*$", clause, re.I):
        place, clause = ("" if m[1] else _bare(m[2])), clause[: m.start()]
    if m := re.match(rf"rename\s+column\s+({_NAME})\s+to\s+({_NAME})$", clause, re.I):
        return Change("rename", _bare(m[1]), _bare(m[2]))
    if re.match(r"rename\s+(?!column\b|index\b|key\b)(?:to\s+|as\s+|=\s*)?\S", clause, re.I):
        out.renames_table = True
        return Change("other", definition=clause)
    if m := re.match(r"add\s+(?:constraint\s+\S+\s+)?(?:(primary)\s+key|unique(?:\s+key|\s+index)?)\s*(\S+?)?\s*\((.*)\)", clause, re.I):
        return Change("add_key", "PRIMARY" if m[1] else _bare(m[2] or ""), definition=m[3])
    if re.match(r"add\s+(?:index|key|fulltext|spatial|foreign|constraint|check|partition)\b", clause, re.I):
        return Change("other", definition=clause)
    if m := re.match(rf"add\s+(?:column\s+)?({_NAME})\s+(.+)$", clause, re.I | re.S):
        return Change("add", _bare(m[1]), definition=m[2], place=place)
    if re.match(r"drop\s+primary\s+key$", clause, re.I):
        return Change("drop_key", "PRIMARY")
    if m := re.match(rf"drop\s+(?:key|index)\s+({_NAME})$", clause, re.I):
        return Change("drop_key", _bare(m[1]))
    if m := re.match(rf"drop\s+(?:column\s+)?({_NAME})$", clause, re.I):
        return Change("drop", _bare(m[1]))
    if m := re.match(rf"change\s+(?:column\s+)?({_NAME})\s+({_NAME})\s+(.+)$", clause, re.I | re.S):
        return Change("change", _bare(m[1]), _bare(m[2]), m[3], place)
    if m := re.match(rf"modify\s+(?:column\s+)?({_NAME})\s+(.+)$", clause, re.I | re.S):
        return Change("modify", _bare(m[1]), definition=m[2], place=place)
    return Change("other", definition=clause)


_INTEGERS = {"tinyint": (8, T.ByteType()), "smallint": (16, T.ShortType()), "mediumint": (24, T.IntegerType()), "int": (32, T.IntegerType()), "integer": (32, T.IntegerType()), "bigint": (64, T.LongType())}
_WIDER = {8: T.ShortType(), 16: T.IntegerType(), 24: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}
_PLAIN = {
    "double": T.DoubleType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampType(), "date": T.DateType(), "json": T.StringType(), "text": T.StringType(), "mediumtext": T.StringType(), "longtext": T.StringType(),
    "tinytext": T.StringType(), "char": T.StringType(), "varchar": T.StringType(), "blob": T.BinaryType(), "mediumblob": T.BinaryType(), "longblob": T.BinaryType(), "tinyblob": T.BinaryType(), "varbinary": T.BinaryType(), "binary": T.BinaryType(),
    "geometry": T.BinaryType(), "point": T.BinaryType(), "float": T.FloatType(), "year": T.IntegerType(), "time": T.StringType(), "bool": T.BooleanType(), "boolean": T.BooleanType(),
}


def read_type(name: str, definition: str) -> Column:
    """A column from its declaration: type, unsigned, charset, null, default, generated."""
    m = re.match(r"(\w+)\s*(?:\(((?:[^()']|'(?:[^'\\]|\\.)*')*)\))?(.*)$", definition.strip(), re.S)
    kind, args, rest = m[1].lower(), m[2] or "", m[3]
    plain = re.sub(r"'(?:[^'\\]|\\.)*'", "''", rest).lower()
    col = Column(name, T.StringType(), "not null" not in plain and "primary key" not in plain)
    if kind in _INTEGERS:
        bits, spark = _INTEGERS[kind]
        unsigned = "unsigned" in plain
        col = replace(col, type=_WIDER[bits] if unsigned else spark, unsigned_bits=bits if unsigned else 0)
    elif kind in ("decimal", "numeric"):
        p, s = ([int(x) for x in args.split(",")] + [0])[:2] if args else (10, 0)
        # beyond 38 digits Spark has no number: the digits are carried as text
        col = replace(col, type=T.DecimalType(p, s) if p <= 38 else T.StringType())
    elif kind == "bit":
        col = replace(col, type=T.BooleanType() if (args or "1") == "1" else T.LongType())
    elif kind == "enum":
        col = replace(col, enum=tuple(x[1:-1].replace("''", "'") for x in split_clauses(args)))
    elif kind in _PLAIN:
        size = int(args) if args.isdigit() else 0
        col = replace(col, type=_PLAIN[kind], json=kind == "json", approximate=kind == "float", binary_length=size if kind == "binary" else 0, max_length=size if kind in ("char", "varchar") else 0)
    else:
        raise ValueError(f"no such type: {kind}")
    if m := re.search(r"(?:charset|character\s+set)\s*=?\s*(\w+)", rest, re.I):
        col = replace(col, charset=m[1].lower())
    if m := re.search(r"\bdefault\s+('(?:[^'\\]|\\.|'')*'|[\w.+-]+(?:\(\d*\))?)", rest, re.I):
        col = replace(col, default=None if m[1].lower() == "null" else m[1])
    if m := re.search(r"(?:generated\s+always\s+)?\bas\s*\((.*)\)\s*(?:virtual|stored|persistent)?", rest, re.I | re.S):
        col = replace(col, generated=m[1])
    return replace(col, auto_increment=bool(re.search(r"\bauto_increment\b(?!\s*=)", plain)))


def apply_to(spec: TableSpec, alter: Alter) -> TableSpec:
    """The target's spec."""
    cols, keys = list(spec.columns), list(spec.keys)
    renamed = alter.real_renames()

    def index(name: str) -> int:
        for i, c in enumerate(cols):
            if c.name.lower() == name.lower():
                return i
        raise ValueError(f"no such column: {name}")

    def put(col: Column, place: str | None, at: int | None) -> None:
        cols.insert(0 if place == "" else index(place) + 1 if place is not None else len(cols) if at is None else at, col)

    for c in alter.changes:
        if c.kind == "add":
            put(read_type(c.name, c.definition), c.place, None)
        elif c.kind == "drop":
            del cols[index(c.name)]
        elif c.kind in ("change", "modify"):
            at = index(c.name)
            del cols[at]
            put(read_type(c.new_name or c.name, c.definition), c.place, at)
        elif c.kind == "rename":
            cols[index(c.name)] = replace(cols[index(c.name)], name=c.new_name)
        elif c.kind == "drop_key":
            keys = [k for k in keys if k.name.lower() != c.name.lower()]
        elif c.kind == "add_key":
            names = tuple(_bare(re.sub(r"\(\d+\)|\s+(?:asc|desc)$", "", x, flags=re.I).strip()) for x in split_clauses(c.definition))
            keys.append(UniqueKey(c.name or "_".join(names), names))
    names = {c.name: c for c in cols}
    rebuilt = []
    for k in keys:
        own = tuple(renamed.get(x, x) for x in k.columns)
        if all(x in names for x in own):
            rebuilt.append(replace(k, columns=own, nullable=any(names[x].nullable for x in own) and k.name != "PRIMARY", auto_increment=names[own[0]].auto_increment))
    out = spec.with_columns(cols, rebuilt)
    return replace(out, next_id=alter.auto_increment if alter.auto_increment is not None else spec.next_id)


def instant(alter: Alter) -> bool:
    """Can the change be made in the schema alone: new columns at the end that are null in old rows?"""
    new = [read_type(c.name, c.definition) if c.kind == "add" and c.place is None else None for c in alter.changes]
    return bool(new) and all(c is not None and c.nullable and c.default is None and c.generated is None for c in new)
