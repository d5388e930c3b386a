"""End-to-end cases: a table, its snapshot, a log of raw row events, an ALTER statement, and the rows (or the refusal) that must come of it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from shiftwell.migrate import Migration
from shiftwell.operators import cdc, checks
from shiftwell.operators.copy import first_by_key
from shiftwell.plans.alter import read_type
from shiftwell.sources.changelog import event_schema
from shiftwell.sources.store import TableStore
from shiftwell.spec import Options, TableSpec, UniqueKey


@dataclass
class Case:
    name: str
    columns: dict[str, str]
    key: tuple[str, ...]
    alter: str
    rows: list = field(default_factory=list)
    events: list = field(default_factory=list)  # (op, before, after), raw values
    want: list | None = None
    fails: str | None = None
    options: dict = field(default_factory=dict)
    more_keys: dict = field(default_factory=dict)
    spec: dict = field(default_factory=dict)


IDI = {"id": "int not null auto_increment", "i": "int not null", "color": "varchar(32)"}
ROWS = [(1, 11, "red"), (2, 13, "green"), (3, 17, "blue")]
DML = [("I", None, (4, 19, "brown")), ("U", (1, 11, "red"), (1, 12, "orange")), ("D", (2, 13, "green"), None), ("U", (3, 17, "blue"), (7, 17, "blue"))]
AFTER = [(1, 12, "orange"), (4, 19, "brown"), (7, 17, "blue")]
C12 = {"id": "int not null auto_increment", "c1": "int not null", "c2": "int not null"}
C12_ROWS, C12_DML, C12_AFTER = [(1, 2, 3), (2, 4, 6)], [("I", None, (3, 6, 9)), ("U", (1, 2, 3), (1, 5, 8)), ("D", (2, 4, 6), None)], [(1, 5, 8), (3, 6, 9)]
TEXT = "汉字 átŕîø"
at = lambda *x: dt.datetime(*x)


def text_case(name: str, charset: str, codec: str, value: str, kind: str = "varchar(128)") -> Case:
    """Text of a charset: bytes in the log."""
    return Case(name, {"id": "int", "t": f"{kind} charset {charset}"}, ("id",), "engine=innodb", [(1, "a")], [("I", None, (2, value.encode(codec))), ("U", (1, b"a"), (1, value.encode(codec)))], [(1, value), (2, value)])


CASES = [
    Case("trivial", IDI, ("id",), "engine=innodb", ROWS, DML, AFTER),
    Case("analyze-before-cutover", IDI, ("id",), "engine=innodb", ROWS, DML, AFTER, options={"analyze_before_cutover": True}),
    Case("attempt-instant", IDI, ("id",), "engine=innodb", ROWS, DML, AFTER, options={"attempt_instant": True}),
    Case("autoinc-copy-deletes", {"id": "int", "i": "int"}, ("id",), "engine=innodb", [(1, 1), (2, 2), (3, 3)], [("D", (3, 3), None), ("D", (2, 2), None)], [(1, 1)]),
    Case("autoinc-user-defined", {"id": "int", "i": "int"}, ("id",), "AUTO_INCREMENT=7", [(1, 1)], [], [(1, 1)]),
    Case("autoinc-zero", {"id": "int", "i": "int"}, ("id",), "engine=innodb", [(0, 23), (1, 1)], [("I", None, (2, 2))], [(0, 23), (1, 1), (2, 2)]),
    Case("bigint-change-nullable", {"id": "bigint", "val": "bigint not null"}, ("id",), "change val val bigint", [(1, 2**60)], [("I", None, (2, None)), ("U", (1, 2**60), (1, -5))], [(1, -5), (2, None)]),
    Case("binary-to-varbinary", {"id": "int", "data": "binary(6) not null"}, ("id",), "MODIFY data varbinary(32)", [(1, b"abcdef")], [("I", None, (2, b"ab"))], [(1, b"abcdef"), (2, b"ab\0\0\0\0")]),
    Case("bit-add", {"id": "int", "i": "int"}, ("id",), "add column is_good bit null default 0", [(1, 5)], [("I", None, (2, 6))], [(1, 5, False), (2, 6, False)]),
    Case("bit-dml", {"id": "int", "i": "int", "is_good": "bit null"}, ("id",), "modify column is_good bit not null default 0", [(1, 5, True), (2, 5, None)], [("I", None, (3, 6, None)), ("U", (1, 5, True), (1, 5, False))], [(1, 5, False), (2, 5, False), (3, 6, False)]),
    Case("compound-pk", {"id": "int", "i": "int", "v": "varchar(128)"}, ("id", "v"), "engine=innodb", [(1, 11, "eleven"), (1, 12, "twelve")], [("U", (1, 11, "eleven"), (1, 11, "other")), ("I", None, (2, 1, "x")), ("D", (1, 12, "twelve"), None)], [(1, 11, "other"), (2, 1, "x")]),
    Case("compound-pk-ts", {"id": "int", "i": "int", "ts0": "datetime(6)"}, ("id", "ts0"), "engine=innodb", [(1, 1, at(2024, 1, 1, 1, 2, 3, 4))], [("U", (1, 1, at(2024, 1, 1, 1, 2, 3, 4)), (1, 2, at(2024, 1, 1, 1, 2, 3, 5)))], [(1, 2, at(2024, 1, 1, 1, 2, 3, 5))]),
    text_case("utf8", "utf8", "utf8", TEXT), text_case("utf8mb4", "utf8mb4", "utf8", TEXT + " 🎉"), text_case("latin1", "latin1", "cp1252", "átîø€"), text_case("latin1text", "latin1", "cp1252", "ÀÉÖ", "text"),
    text_case("gbk-charset", "gbk", "gbk", "测试gbk"), text_case("convert-utf8mb4-ascii", "ascii", "ascii", "plain"),
    Case("mixed-charset", {"id": "int", "a": "varchar(9) charset latin1", "b": "varchar(9) charset utf8mb4"}, ("id",), "engine=innodb", [], [("I", None, (1, "é".encode("cp1252"), "é".encode()))], [(1, "é", "é")]),
    Case("alter-charset", {"id": "int", "t": "varchar(99) charset latin1"}, ("id",), "MODIFY t varchar(99) charset utf8mb4", [(1, "é")], [("I", None, (2, "ø".encode("cp1252")))], [(1, "é"), (2, "ø")]),
    Case("datetime", {"id": "int", "d": "datetime(6)"}, ("id",), "engine=innodb", [(1, at(1999, 12, 31, 23, 59, 59, 999999))], [("I", None, (2, at(2016, 10, 31, 11, 22, 33, 21)))], [(1, at(1999, 12, 31, 23, 59, 59, 999999)), (2, at(2016, 10, 31, 11, 22, 33, 21))]),
    Case("datetime-1970", {"id": "int", "d": "datetime null"}, ("id",), "add column name varchar(1)", [(1, at(1970, 1, 1)), (2, None)], [("I", None, (3, at(1970, 1, 1, 0, 0, 1)))], [(1, at(1970, 1, 1), None), (2, None, None), (3, at(1970, 1, 1, 0, 0, 1), None)]),
    Case("datetime-to-timestamp", {"id": "int", "t": "datetime null"}, ("id",), "change column t t timestamp null", [(1, at(2024, 6, 1, 12))], [("I", None, (2, at(2024, 6, 1, 13))), ("I", None, (3, None))], [(1, at(2024, 6, 1, 9)), (2, at(2024, 6, 1, 10)), (3, None)], options={"timezone": "+03:00"}),
    Case("timestamp-to-datetime", {"id": "int", "t": "timestamp"}, ("id",), "change column t t datetime not null", [(1, at(2024, 6, 1, 12))], [("U", (1, at(2024, 6, 1, 12)), (1, at(2024, 6, 2, 12)))], [(1, at(2024, 6, 2, 12))]),
    Case("datetime-to-timestamp-pk-fail", {"id": "int", "t": "datetime"}, ("id", "t"), "change column t t timestamp", fails="part of the key"),
    Case("datetime-with-zero", {"id": "int", "t": "varchar(32)"}, ("id",), "modify t datetime null", [(1, "0000-00-00 00:00:00")], [("I", None, (2, "2024-01-02 03:04:05")), ("I", None, (3, "1970-00-00 00:00:00"))], [(1, None), (2, at(2024, 1, 2, 3, 4, 5)), (3, None)], options={"allow_zero_dates": True}),
    Case("fail-datetime-with-zero", {"id": "int", "t": "varchar(32)"}, ("id",), "modify t datetime null", [(1, "0000-00-00 00:00:00")], fails="CAST_INVALID_INPUT"),
    Case("decimal", {"id": "int", "d": "decimal(30,10) not null"}, ("id",), "engine=innodb", [(1, Decimal("0.0000000001"))], [("I", None, (2, Decimal("12345678901234567890.0123456789")))], [(1, Decimal("0.0000000001")), (2, Decimal("12345678901234567890.0123456789"))]),
    Case("discard-fk", {"id": "int", "p": "int"}, ("id",), "engine=innodb", [(1, 2)], [], [(1, 2)], options={"discard_foreign_keys": True}, spec={"foreign_keys_child": 1}),
    Case("fail-fk", {"id": "int", "p": "int"}, ("id",), "engine=innodb", fails="child-side", spec={"foreign_keys_child": 1}),
    Case("fail-fk-parent", {"id": "int"}, ("id",), "engine=innodb", fails="parent-side", options={"discard_foreign_keys": True}, spec={"foreign_keys_parent": 1}),
    Case("drop-null-add-not-null", {"id": "int", "c1": "int null", "c2": "int not null"}, ("id",), "drop column c1, add column c1 int not null default 47", [(1, None, 5)], [("I", None, (2, 9, 6))], [(1, 5, 47), (2, 6, 47)]),
    Case("enum", {"id": "int", "e": "enum('red', 'green', 'blue')"}, ("id",), "change e e enum('red', 'green', 'blue', 'yellow') null", [(1, "red")], [("I", None, (2, 3)), ("U", (1, 1), (1, 2)), ("I", None, (3, None))], [(1, "green"), (2, "blue"), (3, None)]),
    Case("enum-pk", {"id": "int", "e": "enum('red', 'green', 'blue') not null"}, ("id", "e"), "engine=innodb", [(1, "red"), (1, "blue")], [("U", (1, 1), (1, 2)), ("D", (1, 3), None), ("I", None, (2, 3))], [(1, "green"), (2, "blue")]),
    Case("enum-to-varchar", {"id": "int", "e": "enum('red', 'green', 'blue')"}, ("id",), "change e e varchar(32) not null default ''", [(1, "red")], [("I", None, (2, 2)), ("I", None, (3, None))], [(1, "red"), (2, "green"), (3, "")]),
    Case("fail-drop-pk", {"id": "int", "i": "int"}, ("id",), "change id id int, drop primary key", fails="no primary or unique key"),
    Case("fail-float-unique-key", {"f": "float not null", "i": "int"}, ("f",), "add column v varchar(32)", fails="float"),
    Case("fail-no-shared-uk", {"id": "int", "i": "int"}, ("id",), "drop primary key, add primary key (i)", fails="no unique key is shared"),
    Case("fail-no-unique-key", {"i": "int"}, (), "add column v varchar(32)", fails="no primary or unique key"),
    Case("fail-rename-table", {"id": "int"}, ("id",), "rename as something_else", fails="renames the table"),
    Case("update-pk-column", {"id": "int", "i": "int"}, ("id",), "engine=innodb", [(1, 1), (2, 2)], [("U", (1, 1), (9, 1)), ("U", (2, 2), (1, 2)), ("U", (9, 1), (2, 1))], [(1, 2), (2, 1)]),
    Case("generated-columns", {"id": "int", "a": "int", "b": "int", "sum_ab": "int as (a + b) virtual"}, ("id",), "engine=innodb", [(1, 2, 3, 5)], [("I", None, (2, 5, 7, None)), ("U", (1, 2, 3, 5), (1, 4, 4, None))], [(1, 4, 4, 8), (2, 5, 7, 12)]),
    Case("generated-columns-add", {"id": "int", "a": "int", "b": "int"}, ("id",), "add column sum_ab int as (a + b) virtual", [(1, 2, 3)], [("I", None, (2, 5, 7))], [(1, 2, 3, 5), (2, 5, 7, 12)]),
    Case("generated-columns-rename", {"id": "int", "a": "int", "b": "int", "sum_ab": "int as (a + b) virtual"}, ("id",), "change sum_ab total_ab int as (a + b) virtual", [(1, 2, 3, 5)], [("I", None, (2, 1, 1, None))], [(1, 2, 3, 5), (2, 1, 1, 2)], options={"approve_renames": True}),
    Case("geometry", {"id": "int", "g": "geometry"}, ("id",), "engine=innodb", [(1, b"\x00\x01")], [("I", None, (2, b"\x02\x00"))], [(1, b"\x00\x01"), (2, b"\x02\x00")]),
    Case("json", {"id": "int", "j": "json"}, ("id",), "engine=innodb", [(1, '{"a": 1}')], [("I", None, (2, '["汉"]')), ("U", (1, '{"a": 1}'), (1, None))], [(1, None), (2, '["汉"]')]),
    Case("keyword-column", IDI, ("id",), "add column `index` int unsigned", ROWS, DML, [(*r, None) for r in AFTER]),
    Case("modify-change-case", C12, ("id",), "modify C2 int not null default 0", C12_ROWS, C12_DML, C12_AFTER),
    Case("modify-change-case-pk", C12, ("id",), "modify ID int", fails="no (primary or unique key|unique key is shared)|key columns are not shared"),
    Case("rename", C12, ("id",), "change column c2 c3 int not null", C12_ROWS, C12_DML, C12_AFTER, options={"approve_renames": True}),
    Case("rename-not-approved", C12, ("id",), "change column c2 c3 int not null", fails="renamed"),
    Case("rename-none-comment", {"id": "int", "c1": "int"}, ("id",), "add column exchange_rate double comment 'change rate used for pay in your own currency'", [(1, 2)], [("I", None, (2, 3))], [(1, 2, None), (2, 3, None)]),
    Case("rename-reorder-column", C12, ("id",), "change column c2 c2a int not null after id", C12_ROWS, C12_DML, [(a, c, b) for a, b, c in C12_AFTER], options={"approve_renames": True}),
    Case("rename-reorder-columns", C12 | {"c3": "int not null"}, ("id",), "change column c2 c2a int not null, change column c3 c3 int not null after id", [(1, 2, 3, 4)], [("I", None, (2, 5, 6, 7))], [(1, 4, 2, 3), (2, 7, 5, 6)], options={"approve_renames": True}),
    Case("reorder-columns", C12, ("id",), "change column c2 c2 int not null after id", C12_ROWS, C12_DML, [(a, c, b) for a, b, c in C12_AFTER]),
    Case("shared-uk", {"id": "int not null", "i": "int not null"}, ("id",), "drop primary key, add primary key (id, i)", [(1, 1), (2, 2)], [("I", None, (3, 3)), ("U", (1, 1), (1, 5))], [(1, 5), (2, 2), (3, 3)]),
    Case("swap-uk", {"id": "int not null", "i": "int not null"}, ("id",), "drop primary key, add unique key (id)", [(1, 1)], [("D", (1, 1), None), ("I", None, (2, 2))], [(2, 2)]),
    Case("swap-pk-uk", {"id": "bigint not null", "i": "int not null", "s": "varchar(9) not null"}, ("id",), "drop primary key, drop key its_uidx, add primary key (i, s), add unique key id_uidx(id)", [(1, 1, "a")], [("U", (1, 1, "a"), (1, 2, "b")), ("I", None, (5, 5, "c"))], [(1, 2, "b"), (5, 5, "c")], more_keys={"its_uidx": ("i", "s")}),
    Case("unsigned", {"id": "int", "iu": "int unsigned not null", "bu": "bigint unsigned not null"}, ("id",), "engine=innodb", [(1, 4294967295, Decimal(2**64 - 1))], [("I", None, (2, -1, Decimal(-1))), ("I", None, (3, 7, Decimal(8)))], [(1, 4294967295, Decimal(2**64 - 1)), (2, 4294967295, Decimal(2**64 - 1)), (3, 7, Decimal(8))]),
    Case("unsigned-modify", {"id": "bigint", "s": "smallint unsigned", "m": "mediumint unsigned", "t": "tinyint unsigned"}, ("id",), "modify s int unsigned, modify m bigint, modify t smallint", [(1, 65535, 16777215, 255)], [("I", None, (2, -1, -6777216, -1))], [(1, 65535, 16777215, 255), (2, 65535, 10000000, 255)]),
    Case("unsigned-rename", {"id": "int", "iu": "int unsigned not null"}, ("id",), "change column iu iu_renamed int unsigned not null", [(1, 5)], [("U", (1, 5), (1, -2))], [(1, 4294967294)], options={"approve_renames": True}),
    Case("varbinary", {"id": "binary(4) not null", "info": "varchar(9) not null"}, ("id",), "engine=innodb", [(b"ab\0\0", "x")], [("U", (b"ab", "x"), (b"ab", "y")), ("I", None, (b"\xf1\x02", "z"))], [(b"ab\0\0", "y"), (b"\xf1\x02\0\0", "z")]),
    Case("panic-duplicate-on-new-unique-index", {"id": "int", "name": "varchar(255) not null"}, ("id",), "add unique index name_index(name)", [(1, "John"), (2, "John")], fails="Duplicate entry 'John' for key 'name_index'", options={"panic_on_warnings": True}),
    Case("panic-duplicate-after-type-change", {"id": "int", "name": "varchar(255) not null"}, ("id",), "modify column name varchar(4) not null", [(1, "John Smith"), (2, "John Travolta")], fails="Data truncated|Duplicate entry 'John'", options={"panic_on_warnings": True}, more_keys={"name_uidx": ("name",)}),
    Case("panic-batch-middle", {"id": "int", "email": "varchar(255) not null"}, ("id",), "add unique index email_idx(email)", [(1, "a"), (2, "b")], [("I", None, (3, "a")), ("D", (3, "a"), None)], fails="Duplicate entry 'a'", options={"panic_on_warnings": True}),
    Case("panic-update-pk-with-duplicate", {"id": "int", "email": "varchar(100) not null"}, ("id",), "ADD UNIQUE KEY email_unique (email)", [(1, "u1"), (2, "u2")], [("U", (2, "u2"), (4, "u1"))], fails="Duplicate entry 'u1'", options={"panic_on_warnings": True}),
]


def raw(c) -> T.StructField:
    """The log's type of a column: enum indices, signed numbers, bytes of a charset."""
    kind = T.IntegerType() if c.enum else T.BinaryType() if c.charset and isinstance(c.type, T.StringType) else c.type
    return T.StructField(c.name, kind)


@pytest.mark.parametrize("case", CASES, ids=lambda c: c.name)
def test_case(spark, tmp_path, case):
    columns = tuple(read_type(n, d) for n, d in case.columns.items())
    keys = tuple(UniqueKey(n, tuple(k), any(c.nullable for c in columns if c.name in k) and n != "PRIMARY") for n, k in ({"PRIMARY": case.key} | case.more_keys).items() if k)
    spec = TableSpec("t", columns, keys, **case.spec)
    source, target = TableStore(spark, str(tmp_path), "t"), TableStore(spark, str(tmp_path), "_t_gho")
    schema = T.StructType([T.StructField(c.name, c.type) for c in columns])
    source.swap(source.write_version(spark.createDataFrame(case.rows, schema)), applied_seq=0)
    log = spark.createDataFrame([(k, 0, "d", "t", *e) for k, e in enumerate(case.events, 1)], event_schema([raw(c) for c in columns]))
    m = None

    def migrated():
        nonlocal m
        m = Migration(source, target, spec, case.alter, Options(max_retries=1, **case.options))
        m.validate()
        rows = first_by_key(m.form(source.read()), m.mapped_key)
        if m.options.panic_on_warnings and (found := checks.warnings(rows, m.target_spec, m.mapped_key) or checks.batch_warnings(rows, m.events(log), m.target_spec, m.mapped_key)):
            raise ValueError("; ".join(found))
        out = cdc.apply_log(rows, m.events(log), m.mapped_key, m.values)
        return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in out.select(*(c.name for c in m.target_spec.columns)).collect()), key=str)

    if case.fails:
        with pytest.raises(Exception, match=case.fails):
            migrated()
    else:
        assert migrated() == sorted(case.want, key=str)
