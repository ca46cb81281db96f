"""Canonical text of JSON records under a schema, as Spark expressions: equal records give equal text.

Presence and type come from the VARIANT of the text, number and list text from a string map, which keeps
numbers as written; of duplicate keys the last counts. Floats in exponent form of extreme size are printed
from a double and are out of contract, as are integers of 19 digits or more written with a fraction ".0".
Text behind a record, and a number of a declared field that no double can hold, make it unreadable ("serde").
Objects inside lists keep the order of their keys, or have them sorted at every depth with the lexicographic order.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kinds import Kind
from .schema import Field, Schema

LOWEST, HIGHEST = -(2**63), 2**64 - 1
HIGHEST_INT = 2**31 - 1
NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
#: Failures of a record as a whole.
UNREADABLE, NO_OBJECT, OUT_OF_RANGE = -3, -2, -1
#: These stand in JSON text while it is worked on, where none has them.
MARK, END = "\x02", "\x03"


def prepare(spark: SparkSession) -> None:
    """Let the last of duplicate keys count, as JSON readers do. This stays set in the session: plans read it late."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def lower_escapes(text: Column, guard: Column | None = None) -> Column:
    """JSON text with control characters as \\u and lower-case hex. A backslash that is itself escaped starts no escape.

    `guard` is a column that has such escapes if text has them: text is then computed once.
    """
    parts = F.split(F.replace(text, F.lit("\\\\"), F.lit(MARK)), r"\\u00")
    low = F.transform(parts, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.translate(F.substring(s, 1, 2), "ABCDEF", "abcdef"), F.substring(s, 3, HIGHEST_INT))))
    return F.when((text if guard is None else guard).contains("\\u00"), F.replace(F.array_join(low, "\\u00"), F.lit(MARK), F.lit("\\\\"))).otherwise(text)


def quoted(c: Column) -> Column:
    """A JSON string literal: short escapes, other controls as \\u and lower-case hex, all else as it is."""
    text = F.to_json(F.struct(c.alias("v")))
    text = lower_escapes(F.substring(text, F.lit(6), F.length(text) - 6), F.lit("\\u00"))
    return F.when(c.rlike("[\\x00-\\x1f]"), text).otherwise(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def member(v: Column, name: str) -> Column:
    """A member of an object as VARIANT, NULL if it is absent. Paths have no escapes: odd names are looked up in a map."""
    if set(name) & set("'\"?\\") or not name:
        return F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), name)
    return F.variant_get(v, f"$['{name}']", "variant")


def type_name(kind: Column) -> Column:
    """JSON type name from schema_of_variant."""
    names = F.create_map(*[F.lit(n) for n in ("VOID", "null", "BOOLEAN", "bool", "STRING", "string", "ARRAY", "array", "OBJECT", "object")])
    return F.coalesce(F.try_element_at(names, F.substring_index(kind, "<", 1)), F.lit("number"))


def accepts(kind: Kind, spark_kind: Column, text: Column) -> Column:
    """Whether a value of this VARIANT type fits the field's kind."""
    if kind.name in ("string", "cid", "ref"):
        return spark_kind == "STRING"
    if kind.name == "bool":
        return spark_kind == "BOOLEAN"
    if kind.name == "float":
        return spark_kind.rlike(NUMBER)
    if kind.name == "list":
        return spark_kind.startswith("ARRAY")
    whole = text.try_cast("decimal(38,0)")
    wide = spark_kind.rlike(r"^DECIMAL\(\d+,0\)$") & text.rlike(r"^-?[0-9]+$") & whole.between(F.lit(str(LOWEST)).cast("decimal(38,0)"), F.lit(str(HIGHEST)).cast("decimal(38,0)"))
    return ((spark_kind == "BIGINT") | wide) & (text != "-0")


def plain_number(text: Column) -> Column:
    """Exponent form as other printers have it: 1.0E16 to 1e16, 1.0E-5 to 0.00001 and 1.0E7 to 10000000.0."""
    digits = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    wide = text.try_cast("double").cast("decimal(38,18)")
    trimmed = F.regexp_replace(wide.cast("string"), r"0+$", "")
    plain = F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)
    short = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E", "e")
    return F.when(~text.contains("E"), text).when(digits.between(-5, 15), plain).otherwise(short)


def marked(text: Column) -> Column:
    """JSON text with marks around the numbers outside strings. No quantifier can go back, so long strings need no stack."""
    string, number = r'"(?:[^"\\]++|\\.)*+"', r"-?[0-9][0-9.E+-]*+"
    return F.replace(F.regexp_replace(text, F.lit(f"({string})|({number})"), F.lit(f"$1{MARK}$2{END}")), F.lit(MARK + END), F.lit(""))


def sorted_keys(text: Column) -> Column:
    """Marked text with the keys of objects sorted: it goes through a VARIANT, which keeps them so, and numbers as strings.

    \\u0001n stands before a number and \\u0001e behind it, \\u0001u for \\u0001 itself.
    """
    there = [("\\u0001", "\\u0001u"), (MARK, '"\\u0001n'), (END, '\\u0001e"')]
    for old, new in there:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.to_json(F.try_parse_json(text))
    for new, old in reversed(there):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def plain_numbers(text: Column) -> Column:
    """Marked text without the marks, and numbers as other printers have them."""
    return F.array_join(F.transform(F.split(text, f"[{MARK}{END}]"), lambda s, i: F.when(i % 2 == 1, plain_number(s)).otherwise(s)), "")


def parse(c: Column) -> tuple[Column, Column]:
    """The record as VARIANT and as a map of texts."""
    return F.try_parse_json(c), F.from_json(c, "map<string,string>")


def ends(c: Column) -> Column:
    """Whether nothing follows the first value of the text: only an object without others inside is seen to at a glance.

    Else the text must be one element of a list and, should it close that list itself, one member of an object.
    """
    alone = F.coalesce(F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1, F.lit(False))
    inside = F.coalesce(F.size(F.json_object_keys(F.concat(F.lit('{"k":'), c, F.lit("}")))) == 1, F.lit(False))
    return c.rlike(r"^\s*\{[^{}]*\}\s*$") | (alone & (~c.contains("]") | inside))


class Canon:
    """Expressions that canonicalise a JSON text column under a schema.

    key_order: "schema" (field order) or "lexicographic" (UTF-8 byte order of names).
    strict_lists: also check the elements of lists, an extension.

    The work is in steps, each a set of columns made of earlier ones: of a table they are columns of their own, so
    that each is computed once; of a single expression they are bound by a lambda.
    """

    def __init__(self, schema: Schema, key_order: str = "schema", strict_lists: bool = False):
        check_order(key_order)
        self.schema, self.key_order, self.strict_lists = schema, key_order, strict_lists

    def _parsed(self, c: Column) -> dict[str, Column]:
        v, texts = parse(c)
        return {"v": v, "texts": texts, "ends": ends(c)}

    def _looked_up(self, x: Callable[[str], Column], fields: list[Field]) -> dict[str, Column]:
        """The VARIANT type and the text of the root and of each field."""
        texts = x("texts")
        repeats = F.size(F.array_distinct(F.map_keys(texts))) < F.size(texts)
        out = {"root": F.when(x("ends"), F.schema_of_variant(x("v")))}
        for i, f in enumerate(fields):
            last = F.try_element_at(F.filter(F.map_entries(texts), lambda e: e["key"] == f.name), F.lit(-1))["value"]  # noqa: B023
            got = member(x("v"), f.name)
            out[f"kind{i}"] = F.schema_of_variant(got)
            out[f"text{i}"] = F.when(repeats, last).otherwise(F.element_at(texts, f.name))
            if self.strict_lists and f.kind.name == "list":
                out[f"items{i}"] = F.coalesce(self._elements_ok(got, f.kind.inner), F.lit(False))
        return out

    def _marked(self, x: Callable[[str], Column], fields: list[Field], orders: set[str]) -> dict[str, Column]:
        """The lists' texts with marks, as far as they have numbers to be printed anew or keys to be sorted."""
        out = {}
        for i, f in enumerate(fields):
            if f.kind.name == "list":
                text = x(f"text{i}")
                exponents = text.rlike("[0-9]E")
                out[f"exponents{i}"] = exponents
                out[f"marked{i}"] = F.when(exponents | text.contains("{") if "lexicographic" in orders else exponents, marked(text))
        return out

    def _ordered(self, x: Callable[[str], Column], fields: list[Field], orders: set[str]) -> dict[str, Column]:
        lists = [i for i, f in enumerate(fields) if f.kind.name == "list" and "lexicographic" in orders]
        return {f"ordered{i}": F.when(x(f"text{i}").contains("{"), sorted_keys(x(f"marked{i}"))) for i in lists}

    def _judged(self, x: Callable[[str], Column], fields: list[Field], orders: set[str]) -> dict[str, Column]:
        """Whether each field is there and wrong, its printed member in each order, and whether a number is out of range."""
        out = {}
        for i, f in enumerate(fields):
            kind, text = x(f"kind{i}"), x(f"text{i}")
            ok = accepts(f.kind, kind, text)
            if self.strict_lists and f.kind.name == "list":
                ok = ok & x(f"items{i}")
            out[f"wrong{i}"] = F.coalesce(kind.isNotNull() & ((kind == "VOID") | ~ok), F.lit(False))
            # Of numbers alone the map has text in quotation marks: an infinity.
            over = kind.rlike(NUMBER) & text.startswith('"')
            if f.kind.name == "list":
                over = over | (kind.startswith("ARRAY") & ~kind.startswith("ARRAY<STRING") & text.rlike('[\\[,:]"-?Infinity"'))
            out[f"over{i}"] = F.coalesce(over, F.lit(False))
            body = quoted(text) if f.kind.name in ("string", "cid", "ref") else plain_number(text) if f.kind.name == "float" else text
            bodies = {"part": body}
            if f.kind.name == "list":
                plain = F.when(x(f"exponents{i}"), plain_numbers(x(f"marked{i}"))).otherwise(text)
                bodies = {"part": lower_escapes(plain, text)} if "schema" in orders else {}
                if "lexicographic" in orders:
                    ordered = x(f"ordered{i}")
                    unmarked = F.replace(F.replace(ordered, F.lit(MARK), F.lit("")), F.lit(END), F.lit(""))
                    by_name = F.when(~text.contains("{"), plain).when(x(f"exponents{i}"), plain_numbers(ordered)).otherwise(unmarked)
                    bodies["by_name"] = lower_escapes(by_name, text)
            for key, body in bodies.items():
                out[f"{key}{i}"] = F.when(kind.isNotNull(), F.concat(quoted(F.lit(f.name)), F.lit(":"), body))
        return out

    def _failed(self, x: Callable[[str], Column], views: dict[str, list[tuple[int, Field]]]) -> dict[str, Column]:
        """The first failure in each view, fields by number: of the root, or 2n for its field n absent, 2n + 1 for it wrong."""
        root, out = x("root"), {}
        for view, fields in views.items():
            over = F.lit(False)
            for i, _ in fields:
                over = over | x(f"over{i}")
            first = F.when(root.isNull(), UNREADABLE).when(~root.startswith("OBJECT"), NO_OBJECT).when(over, OUT_OF_RANGE)
            for n, (i, f) in enumerate(fields):
                if f.required:
                    first = first.when(x(f"kind{i}").isNull(), 2 * n)
                first = first.when(x(f"wrong{i}"), 2 * n + 1)
            out[f"first_{view}"] = first
        return out

    def _error(self, x: Callable[[str], Column], view: str, fields: list[tuple[int, Field]]) -> Column:
        """The error of the first failure, looked up: code as a chain of cases would be too long for the JIT compiler."""
        failures = [("serde", None, None, "serialization error: not JSON"), ("type_mismatch", "<root>", "object", "field `<root>` expected object, got "), ("serde", None, None, "serialization error: number out of range")]
        for _, f in fields:
            failures += [("missing_field", f.name, None, f"missing required field: {f.name}"), ("type_mismatch", f.name, f.kind.label(), f"field `{f.name}` expected {f.kind.label()}, got ")]
        first = x(f"first_{view}")
        code, field, expected, message = (F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), first - UNREADABLE + 1) for values in zip(*failures))
        kinds = F.array(x("root"), *[x(f"kind{i}") for i, _ in fields])
        actual = F.when(expected.isNotNull(), type_name(F.element_at(kinds, F.shiftright(first, 1) + 2)))
        return F.when(first.isNotNull(), F.struct(code.alias("code"), field.alias("field"), expected.alias("expected"), actual.alias("actual"), F.concat(message, F.coalesce(actual, F.lit(""))).alias("message")))

    def _text(self, x: Callable[[str], Column], view: str, fields: list[tuple[int, Field]], order: str) -> Column:
        """The canonical text of a view in this order of keys, NULL if anything failed."""
        if order == "schema":
            parts = [x(f"part{i}") for i, _ in fields]
        else:
            parts = [x(f"by_name{i}" if f.kind.name == "list" else f"part{i}") for i, f in sorted(fields, key=lambda n: n[1].name.encode())]
        return F.when(x(f"first_{view}").isNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))

    def _joined(self, x: Callable[[str], Column], view: str, fields: list[tuple[int, Field]]) -> Column:
        """struct(canonical, error) of a view."""
        return F.struct(self._text(x, view, fields, self.key_order).alias("canonical"), self._error(x, view, fields).alias("error"))

    def _fields(self) -> tuple[list[tuple[int, Field]], list[tuple[int, Field]]]:
        """All fields by number, and those of the identity, all of them required."""
        every = list(enumerate(self.schema.fields))
        own = [(i, replace(f, required=True)) for i, f in every if f.identity]
        return every, own

    def _steps(self, c: Column, fields: list[Field], views: dict[str, list[tuple[int, Field]]], orders: set[str]) -> list[Callable]:
        return [
            lambda x: self._parsed(c), lambda x: self._looked_up(x, fields), lambda x: self._marked(x, fields, orders),
            lambda x: self._ordered(x, fields, orders), lambda x: self._judged(x, fields, orders), lambda x: self._failed(x, views),
        ]

    def _expression(self, c: Column, fields: list[tuple[int, Field]]) -> Column:
        known = [f for _, f in fields]
        views = {"whole": list(enumerate(known))}
        steps = self._steps(c, known, views, {self.key_order})

        def bound(n: int, env: dict[str, Column]) -> Column:
            if n == len(steps):
                return self._joined(env.__getitem__, "whole", views["whole"])
            made = steps[n](env.__getitem__)
            if not made:
                return bound(n + 1, env)
            row = F.array(F.struct(*[v.alias(k) for k, v in made.items()]))
            return F.element_at(F.transform(row, lambda s: bound(n + 1, env | {k: s[k] for k in made})), 1)

        return bound(0, {})

    def _elements_ok(self, got: Column, inner: Kind) -> Column:
        items = F.try_variant_get(got, "$", "array<variant>")
        return F.forall(items, lambda x: accepts(inner, F.schema_of_variant(x), x.try_cast("string")))

    def encode(self, c: Column) -> Column:
        """struct(canonical, error): the record's canonical text, or why it has none; the first failing field counts."""
        return self._expression(c, self._fields()[0])

    def identity_projection(self, c: Column) -> Column:
        """The same over identity fields alone, all of them required; other fields aren't looked at."""
        own = self._fields()[1]
        self._warn(own)
        return self._expression(c, own)

    def _warn(self, own: list) -> None:
        if not own:
            warnings.warn(f"schema {self.schema.name!r} has no identity field: every record projects to {{}}", stacklevel=3)

    def columns(self, df: DataFrame, column: str, whole: str, own: str, orders: dict[str, str] | None = None) -> DataFrame:
        """df with columns `whole` (what encode() gives) and `own` (identity_projection()), everything computed once.

        `orders` names further columns, of canonical text in another order of keys.
        """
        every, mine = self._fields()
        self._warn(mine)
        orders = orders or {}
        x = lambda k: F.col(f"__canonical_{k}")
        rows, made = df, []
        for step in self._steps(F.col(column), [f for _, f in every], {"whole": every, "own": mine}, {self.key_order, *orders.values()}):
            cols = {f"__canonical_{k}": v for k, v in step(x).items()}
            rows, made = rows.withColumns(cols) if cols else rows, made + list(cols)
        further = {name: self._text(x, "whole", every, order) for name, order in orders.items()}
        return rows.withColumns({whole: self._joined(x, "whole", every), own: self._joined(x, "own", mine), **further}).drop(*made)

    @staticmethod
    def decode(c: Column) -> Column:
        """Canonical text as VARIANT; the schema plays no part."""
        return F.parse_json(c)

    def strict(self, c: Column) -> Column:
        """Canonical text; raises the error of a record that has none."""
        r = self.encode(c)
        return F.element_at(F.transform(F.array(r), lambda x: F.when(x["error"].isNotNull(), F.raise_error(x["error"]["message"])).otherwise(x["canonical"])), 1)


def check_order(key_order: str) -> None:
    if key_order not in ("schema", "lexicographic"):
        raise ValueError("key_order is schema or lexicographic")


def error(code: str, field: str | None, expected: str | None, actual, message: Column) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(F.lit(code).alias("code"), text(field).alias("field"), text(expected).alias("expected"), text(actual).alias("actual"), message.alias("message"))


def cid(canonical: Column) -> Column:
    """Content id: SHA-256 in hex of the canonical text."""
    return F.sha2(canonical, 256)


def refuse_clashes(df: DataFrame, made: tuple[str, ...]) -> None:
    """Raise if df has a column of one of these names."""
    taken = sorted({c.lower() for c in df.columns} & set(made))
    if taken:
        raise ValueError(f"the table already has columns named {', '.join(taken)}: rename them")


def encode_table(df: DataFrame, column: str, schema: Schema, orders: dict[str, str] | None = None, **options) -> DataFrame:
    """df with columns canonical, error, cid, identity and identity_hash for the JSON text in `column`.

    `orders` names further columns, of canonical text in another key order: `{"by_name": "lexicographic"}`.
    Raises if df has a column of one of these names already.
    """
    orders = orders or {}
    for key_order in orders.values():
        check_order(key_order)
    names = ("canonical", "error", "cid", "identity", "identity_hash")
    refuse_clashes(df, (*names, *(n.lower() for n in orders)))
    prepare(df.sparkSession)
    whole, own = "__canonical_record", "__canonical_identity"
    rows = Canon(schema, **options).columns(df, column, whole, own, orders)
    return rows.withColumns({
        "canonical": F.col(f"{whole}.canonical"), "error": F.col(f"{whole}.error"), "cid": cid(F.col(f"{whole}.canonical")),
        "identity": F.col(f"{own}.canonical"), "identity_hash": cid(F.col(f"{own}.canonical")),
    }).drop(whole, own)


def encode_struct(schema: Schema, columns: dict[str, Column] | None = None) -> Column:
    """Canonical text from typed columns, where SQL NULL means absent; null if a required column is absent.

    Booleans, integers and doubles are printed by Spark; lists are arrays of any type that to_json prints.
    """
    cols = columns or {f.name: F.col(f.name) for f in schema.fields}
    parts, missing = [], F.lit(False)
    for f in schema.fields:
        c = cols[f.name]
        body = quoted(c.cast("string")) if f.kind.name in ("string", "cid", "ref") else F.to_json(c) if f.kind.name == "list" else plain_number(c.cast("double").cast("string")) if f.kind.name == "float" else c.cast("string")
        parts.append(F.when(c.isNotNull(), F.concat(quoted(F.lit(f.name)), F.lit(":"), body)))
        if f.required:
            missing = missing | c.isNull()
    return F.when(~missing, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
