"""Reads of VARIANT values that answer null unless the JSON kind is the one asked for."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with `value` computed once however often `then` reads it, also inside other lambdas.

    The value is what an aggregate over no items begins with and `then` its end. An item of a transformed array would
    do as well, but Spark works out the type of that array, through all that is nested in it, for every row, and copies the result.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda known, _: known, then)


def once(x: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`x` with new columns that are worked out once a row, whatever reads or filters them.

    A plain column may be copied into each expression that reads it, and into filters pushed below it; what comes out of
    a generator is not. Filters on the columns of `x` still go through to the files.
    """
    return x.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def strict_json(raw: Column) -> Column:
    """A text as VARIANT if all of it is one JSON value, else null; white space around the value is no text.

    Spark's parser stops after the first value. So the text is read as the first item of an array whose second is a
    hash of the text: what stands after the value takes that place or breaks the array.
    """
    mark = F.xxhash64(raw)
    read = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(","), mark.cast("string"), F.lit("]")))
    whole_text = lambda a: (F.size(a) == 2) & F.coalesce(F.try_variant_get(F.get(a, F.lit(1)), "$", "bigint") == mark, F.lit(False))
    return let(F.try_variant_get(read, "$", "array<variant>"), lambda a: F.when(whole_text(a), F.get(a, F.lit(0))))


def json_kind(v: Column) -> Column:
    """STRING, ARRAY, OBJECT, BIGINT, DOUBLE, BOOLEAN, VOID ..; null for null."""
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def read(v: Column, path: str, kind: str) -> Column:
    """The value at a path, cast to a type; null if there is none. Of a struct type, its fields are read in one walk over the object.

    Names are walked as fields of a struct: Spark's own walk leaves an absent path by an exception, which costs more than all
    the rest of a read, and most paths are absent in some dialect.
    """
    head, *rest = re.split(r"\[(\d+)\]", path, maxsplit=1)
    if rest:
        return read(F.get(listed(v, head), F.lit(int(rest[0]))), f"${rest[1]}", kind)
    names = head.split(".")[1:]
    for name in reversed(names):
        kind = f"struct<`{name}`:{kind}>"
    out = F.try_variant_get(v, "$", kind)
    for name in names:
        out = out.getField(name)
    return out


def sub(v: Column, path: str) -> Column:
    return v if path == "$" else read(v, path, "variant")


def _of_kind(v: Column, path: str, kind: str, made: str) -> Column:
    """The path is walked once; the kind is then that of the one value."""
    return let(sub(v, path), lambda x: F.when(F.schema_of_variant(x) == kind, F.try_variant_get(x, "$", made)))


def text(v: Column, path: str = "$") -> Column:
    """The string at a path; a number or an array there is null, not its text.

    Read as `binary`, which of all JSON kinds only strings can be cast to: so the kind needs no look of its own.
    """
    return read(v, path, "binary").cast("string")


def whole(v: Column, path: str = "$") -> Column:
    """The whole number at a path; a string of digits is null."""
    return _of_kind(v, path, "BIGINT", "bigint")


def flag(v: Column, path: str = "$") -> Column:
    return _of_kind(v, path, "BOOLEAN", "boolean")


def items(v: Column, path: str = "$") -> Column:
    """The array at a path as array<variant>; empty if it is none."""
    return F.coalesce(listed(v, path), F.array().cast("array<variant>"))


def listed(v: Column, path: str = "$") -> Column:
    """The array at a path as array<variant>; null if it is none. What is in it is not looked at, as its kind would be."""
    return read(v, path, "array<variant>")


def chars(v: Column) -> Column:
    """Characters of the value as compact JSON."""
    return F.char_length(F.to_json(v)).cast("long")


def flat_text(v: Column) -> Column:
    """A string, the joined texts of an array of parts, or any other value as JSON; null for an absent one."""
    joined = lambda parts: F.array_join(F.filter(F.transform(parts, lambda p: F.coalesce(text(p, "$.text"), text(p))), lambda p: p.isNotNull()), "")
    one = lambda w: F.when(json_kind(w) == "STRING", F.try_variant_get(w, "$", "string")).when(w.isNotNull(), F.to_json(w))
    return let(v, lambda w: let(listed(w), lambda parts: F.when(parts.isNotNull(), joined(parts)).otherwise(one(w))))


def quoted(c: Column) -> Column:
    """A string as JSON, quotes and escapes included; null for null."""
    return let(F.to_json(F.struct(c.alias("x"))), lambda j: F.when(c.isNotNull(), F.substring(j, F.lit(6), F.char_length(j) - 6)))


def json_fields(v: Column) -> Column:
    """An object's fields as map<string, JSON text>; null if it is no object."""
    return F.when(json_kind(v) == "OBJECT", F.transform_values(v.cast("map<string,variant>"), lambda _, x: F.to_json(x)))


def merged(under: Column, over: Column) -> Column:
    """Two maps as one, the second winning; a null one is empty."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(under, none), F.coalesce(over, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def json_object(fields: Column) -> Column:
    """A map<string, JSON text> as a JSON object, its keys in order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ","), F.lit("}"))
