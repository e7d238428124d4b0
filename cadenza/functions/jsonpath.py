"""A small path and filter language over JSON documents.

Steps, joined by `|`: `.`, `.a.b`, `.[]`, `.a[].b[]`, `select(E)`, `sort_by(.p)`. E compares paths with literals by
== != < <= > >=, joins with `and` / `or` (equal precedence, from the left) and `not(E)`. A query is parsed on the
driver into steps over VARIANT columns, so documents are never touched row by row in Python.

Names are letters and underscores. Missing keys are null; a field of anything but an object, an iteration of
anything but an array, and an order comparison of anything but numbers are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UsageError(ValueError):
    """A query or an argument that doesn't make sense."""


_LEX = re.compile(r'\s*(?:(?P<op>==|!=|<=|>=|<|>|\||\(|\)|\.|\[\])|(?P<num>-?\d+(?:\.\d+)?)|"(?P<str>(?:[^"\\]|\\.)*)"|(?P<name>[A-Za-z_]+))', re.S)


@dataclass(frozen=True)
class Path:
    """Keys in order; None stands for an iteration."""

    keys: tuple[str | None, ...]


@dataclass(frozen=True)
class Test:
    kind: str
    left: object
    right: object = None


@dataclass(frozen=True)
class Step:
    kind: str
    body: object


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise UsageError(f"unexpected {text[at:].strip()[:1]!r}")
        kind = m.lastgroup or ""
        value = m[kind]
        out.append((kind, re.sub(r"\\(.)", r"\1", value, flags=re.S) if kind == "str" else value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _lex(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        kind, got = self.peek()
        if value is not None and (kind == "str" or got != value):
            raise UsageError(f"expected {value!r}, found {got or 'the end'!r}")
        self.at += 1
        return kind, got

    def query(self) -> list[Step]:
        steps = [self.step()]
        while self.peek() == ("op", "|"):
            self.take()
            steps.append(self.step())
        if self.peek()[0] != "end":
            raise UsageError(f"unexpected {self.peek()[1]!r}")
        return steps

    def step(self) -> Step:
        kind, value = self.peek()
        if kind == "name":
            self.take()
            self.take("(")
            if value == "select":
                body: object = self.expression()
            elif value == "sort_by":
                body = self.path()
                if None in body.keys:
                    raise UsageError("sort_by takes a path without iteration")
            else:
                raise UsageError(f"unknown function {value!r}")
            self.take(")")
            return Step(value, body)
        return Step("path", self.path())

    def path(self) -> Path:
        self.take(".")
        keys: list[str | None] = []
        if self.peek() == ("op", "[]"):
            self.take()
            keys.append(None)
        elif self.peek()[0] == "name":
            keys.append(self.take()[1])
        while True:
            if keys and self.peek() == ("op", "[]"):
                self.take()
                keys.append(None)
            elif keys and self.peek() == ("op", "."):
                self.take()
                kind, name = self.take()
                if kind != "name":
                    raise UsageError("a name must follow a dot")
                keys.append(name)
            else:
                return Path(tuple(keys))

    def expression(self) -> Test:
        left = self.term()
        while self.peek() in (("name", "and"), ("name", "or")):
            left = Test(self.take()[1], left, self.term())
        return left

    def term(self) -> Test:
        if self.peek() == ("name", "not"):
            self.take()
            self.take("(")
            inner = self.expression()
            self.take(")")
            return Test("not", inner)
        left = self.operand()
        kind, op = self.peek()
        if kind == "op" and op in ("==", "!=", "<", "<=", ">", ">="):
            self.take()
            return Test(op, left, self.operand())
        return Test("true", left)

    def operand(self) -> object:
        kind, value = self.peek()
        if (kind, value) == ("op", "."):
            path = self.path()
            if None in path.keys:
                raise UsageError("a comparison takes a path without iteration")
            return path
        self.take()
        if kind == "num":
            return float(value) if "." in value else int(value)
        if kind == "str":
            return value
        if kind == "name" and value in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[value]
        raise UsageError(f"unexpected {value or 'the end'!r}")


def parse(query: str) -> list[Step]:
    return _Parser(query).query()


def _kind(v: Column) -> Column:
    """object, array, number, string, boolean or null."""
    s = F.upper(F.schema_of_variant(v))
    return (
        F.when(v.isNull() | F.is_variant_null(v), "null").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").otherwise("number")
    )


def _field(v: Column, name: str) -> Column:
    got = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(_kind(v) == "object", got).otherwise(F.raise_error(F.concat(F.lit(f"cannot take .{name} of "), _kind(v))).cast("variant"))


def _at(v: Column, path: Path) -> Column:
    for name in path.keys:
        v = _field(v, name or "")
    return v


def _text(v: Column | object) -> tuple[Column, Column]:
    """(kind, text) of a value or literal, for strict equality."""
    if isinstance(v, Column):
        kind = _kind(v)
        number = F.try_variant_get(v, "$", "double").cast("string")
        return kind, F.when(kind == "number", number).when(kind == "null", "null").otherwise(F.to_json(v))
    if v is None:
        return F.lit("null"), F.lit("null")
    if isinstance(v, bool):
        return F.lit("boolean"), F.lit("true" if v else "false")
    if isinstance(v, (int, float)):
        return F.lit("number"), F.lit(float(v)).cast("string")
    return F.lit("string"), F.to_json(F.to_variant_object(F.array(F.lit(v)))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array(F.lit(v))))) - 2)


def _number(v: Column | object, op: str) -> Column:
    kind, _ = _text(v)
    value = F.try_variant_get(v, "$", "double") if isinstance(v, Column) else F.lit(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else F.lit(None).cast("double")
    return F.when(kind == "number", value).otherwise(F.raise_error(F.lit(f"{op} needs numbers")).cast("double"))


def _test(v: Column, t: Test) -> Column:
    if t.kind == "and":
        return F.when(_test(v, t.left), _test(v, t.right)).otherwise(False)
    if t.kind == "or":
        return F.when(_test(v, t.left), True).otherwise(_test(v, t.right))
    if t.kind == "not":
        return ~_test(v, t.left)
    left = _at(v, t.left) if isinstance(t.left, Path) else t.left
    if t.kind == "true":
        kind, text = _text(left)
        return (kind != "null") & (text != "false")
    right = _at(v, t.right) if isinstance(t.right, Path) else t.right
    if t.kind in ("==", "!="):
        (ka, a), (kb, b) = _text(left), _text(right)
        same = (ka == kb) & (a == b)
        return same if t.kind == "==" else ~same
    a, b = _number(left, t.kind), _number(right, t.kind)
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[t.kind]


def query(df: DataFrame, text: str, column: str = "doc", key: str = "id") -> DataFrame:
    """The values that a query gives for each document: (key, ord array, value variant), in order of ord.

    A JSON string column is parsed first."""
    v = F.parse_json(column) if isinstance(df.schema[column].dataType, T.StringType) else F.col(column)
    rows = df.select(key, F.array().cast("array<long>").alias("ord"), v.alias("v"))
    for step in parse(text):
        if step.kind == "path":
            for name in step.body.keys:
                if name is None:
                    items = F.when(_kind(F.col("v")) == "array", F.try_variant_get("v", "$", "array<variant>")).otherwise(F.raise_error(F.concat(F.lit("cannot iterate "), _kind(F.col("v")))).cast("array<variant>"))
                    rows = rows.select(key, "ord", F.posexplode(items).alias("n", "v")).select(key, F.concat("ord", F.array(F.col("n").cast("long"))).alias("ord"), "v")
                else:
                    rows = rows.withColumn("v", _field(F.col("v"), name))
        elif step.kind == "select":
            rows = rows.where(_test(F.col("v"), step.body))
        else:
            items = F.when(_kind(F.col("v")) == "array", F.try_variant_get("v", "$", "array<variant>")).otherwise(F.raise_error(F.lit("sort_by needs an array")).cast("array<variant>"))

            def by_number(x: Column, body: Path = step.body) -> Column:
                at = _at(x, body)
                return F.struct(F.try_variant_get(at, "$", "double").alias("n"), F.coalesce(F.try_variant_get(at, "$", "string"), F.lit("null")).alias("s"))

            # A stable order: the place in the array settles ties.
            keyed = F.transform(items, lambda x, i: F.struct(by_number(x).alias("k"), i.alias("i"), x.alias("x")))

            def order(a: Column, b: Column) -> Column:
                both = a["k"]["n"].isNotNull() & b["k"]["n"].isNotNull()
                less = F.when(both, a["k"]["n"] < b["k"]["n"]).otherwise(a["k"]["s"] < b["k"]["s"])
                more = F.when(both, a["k"]["n"] > b["k"]["n"]).otherwise(a["k"]["s"] > b["k"]["s"])
                return F.when(less, -1).when(more, 1).otherwise((a["i"] - b["i"]).cast("int"))

            rows = rows.withColumn("v", F.to_variant_object(F.transform(F.array_sort(keyed, order), lambda e: e["x"])))
    return rows.select(key, "ord", F.col("v").alias("value"))


def answer(df: DataFrame, text: str, column: str = "doc", key: str = "id") -> DataFrame:
    """(key, result): one value as it is, several or none as an array, in JSON."""
    rows = query(df, text, column, key).select(key, F.struct("ord", F.to_json("value").alias("j")).alias("x"))
    values = df.select(key).join(rows.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs")), key, "left")
    texts = F.transform(F.coalesce("xs", F.array().cast("array<struct<ord:array<bigint>,j:string>>")), lambda x: F.coalesce(x["j"], F.lit("null")))
    return values.select(key, F.when(F.size(texts) == 1, texts[0]).otherwise(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))).alias("result"))


def _exists(schema: T.DataType, path: list[str]) -> bool:
    for name in path:
        while isinstance(schema, T.ArrayType):
            schema = schema.elementType
        if not isinstance(schema, T.StructType) or name not in schema.names:
            return False
        schema = schema[name].dataType
    return True


def project(df: DataFrame, fields: str) -> tuple[DataFrame, list[str]]:
    """Columns by dotted paths, named by their paths; arrays are projected by element. Paths that the schema lacks are returned apart."""
    wanted = [f.strip() for f in fields.split(",") if f.strip()]
    good = [f for f in wanted if _exists(df.schema, f.split("."))]
    return df.select(*(F.col(f).alias(f) for f in good)), [f for f in wanted if f not in good]


def check_options(human: bool = False, jq: str | None = None, fields: str | None = None) -> None:
    if human and (jq or fields):
        raise UsageError("a human report can't be queried")
    if jq and fields:
        raise UsageError("give a query or fields, not both")
