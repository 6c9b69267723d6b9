"""Schemas from DDL text without a session, so that modules can be imported anywhere."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_PLAIN = {
    "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
}
_TOKEN = re.compile(r"\s*([A-Za-z_][A-Za-z_0-9]*|\d+|[<>(),:])")


class _Reader:
    def __init__(self, text: str):
        self.tokens = _TOKEN.findall(text)
        assert "".join(self.tokens) == re.sub(r"\s", "", text), text

    def next(self, want: str | None = None) -> str:
        token = self.tokens.pop(0)
        assert want is None or token == want, (want, token)
        return token

    def peek(self) -> str:
        return self.tokens[0] if self.tokens else ""

    def kind(self) -> T.DataType:
        name = self.next().lower()
        if name in _PLAIN:
            return _PLAIN[name]
        if name == "decimal":
            self.next("(")
            precision = int(self.next())
            self.next(",")
            scale = int(self.next())
            self.next(")")
            return T.DecimalType(precision, scale)
        self.next("<")
        if name == "array":
            out = T.ArrayType(self.kind())
        elif name == "map":
            key = self.kind()
            self.next(",")
            out = T.MapType(key, self.kind())
        else:
            assert name == "struct", name
            out = self.fields(":")
        self.next(">")
        return out

    def fields(self, mark: str) -> T.StructType:
        found = []
        while True:
            name = self.next()
            if mark:
                self.next(mark)
            kind, nullable = self.kind(), True
            if self.peek().lower() == "not":
                self.next()
                self.next("null")
                nullable = False
            found.append(T.StructField(name, kind, nullable))
            if self.peek() != ",":
                return T.StructType(found)
            self.next(",")


def ddl(text: str) -> T.StructType:
    """The schema that ``text`` names: ``a long not null, b array<struct<c: string>>``."""
    reader = _Reader(text)
    schema = reader.fields("")
    assert not reader.tokens, reader.tokens
    return schema
