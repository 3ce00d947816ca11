"""Closed JSON documents by declared rules: one column of violations, in the order in which they are checked.

A rule says what a value must be; the rules of a whole document become one expression. What stands where comes first (objects, unknown keys, missing keys, at every
depth), then the values in the order of their declaration, then what holds between them. Types are
told apart strictly: a truth value is no number, 1.0 is no whole number.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .validate import violations

#: A check is a condition and a name; a column of names stands for many.
Check = tuple[Column, str] | Column


@dataclass(frozen=True)
class Text:
    """A string that isn't blank, and one of choices where there are any (spelt just so)."""

    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Number:
    """A finite number, not a truth value; above, if given, is less than it."""

    above: float | None = None


@dataclass(frozen=True)
class Equal:
    """A constant: a string, a whole number or a truth value of just that type."""

    value: str | int | bool


@dataclass(frozen=True)
class Same:
    """A value that is the same JSON, whatever the order of keys."""

    json: str


@dataclass(frozen=True)
class Matches:
    """A string that equals a column of the row."""

    column: str


@dataclass(frozen=True)
class Object:
    """An object; closed ones have exactly the declared fields."""

    fields: dict[str, Rule]
    closed: bool = True


@dataclass(frozen=True)
class Positions:
    """A list as long as a column of structs, whose fields the items carry in the same places; rule holds for each item.

    Whole numbers, doubles and strings are compared by value.
    """

    requested: str
    fields: dict[str, str]
    rule: Object | None = None


Rule = Text | Number | Equal | Same | Matches | Object | Positions
KINDS = {str: ("STRING", "string"), bool: ("BOOLEAN", "boolean"), int: ("BIGINT", "bigint")}


#: What is read of a document by its path: values (VARIANT, absent: null), and objects' fields under their path with {} behind it.
Places = dict[str, Column]


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def _at(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _fields(v: Column) -> Column:
    """The fields of an object; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _read(rows: DataFrame, rule: Object, name: str) -> tuple[DataFrame, Places]:
    """rows with columns for all declared values of the document in column name, level by level, and these by path.

    A column that is read more than once is kept by Spark and not written out
    again, so each object is opened once, whatever is asked of its fields.
    """
    named = {"$": name}
    level: list[tuple[str, Rule]] = [("$", rule)]
    while level := [(p, r) for p, r in level if isinstance(r, Object)]:
        named |= {f"{p}{{}}": f"{name}{len(named) + i}" for i, (p, _) in enumerate(level)}
        rows = rows.withColumns({named[f"{p}{{}}"]: _fields(F.col(named[p])) for p, _ in level})
        inner = [(p, n, r) for p, rule_ in level for n, r in rule_.fields.items()]
        named |= {f"{p}.{n}": f"{name}{len(named) + i}" for i, (p, n, _) in enumerate(inner)}
        rows = rows.withColumns({named[f"{p}.{n}"]: F.try_element_at(F.col(named[f"{p}{{}}"]), F.lit(n)) for p, n, _ in inner})
        level = [(f"{p}.{n}", r) for p, n, r in inner]
    return rows, {p: F.col(n) for p, n in named.items()}


def _shape(rule: Rule, v: Column, path: str, places: Places) -> list[Check]:
    """Checks of objects and their keys, outer ones first."""
    if not isinstance(rule, Object):
        return []
    fields = places.get(f"{path}{{}}", _fields(v))
    inner = {n: places.get(f"{path}.{n}", F.try_element_at(fields, F.lit(n))) for n in rule.fields}
    out: list[Check] = [(fields.isNull(), f"{path}:not_an_object")]
    if rule.closed:
        # a field that is there is never null
        there = functools.reduce(operator.add, [x.isNotNull().cast("int") for x in inner.values()], F.lit(0))
        out += [(F.size(fields) > there, f"{path}:unknown_fields"), (there < len(inner), f"{path}:missing_fields")]
    for name, x in inner.items():
        out += _shape(rule.fields[name], x, f"{path}.{name}", places)
    return out


def _values(rule: Rule, v: Column, path: str, places: Places) -> list[Check]:
    kind = _kind(v)
    if isinstance(rule, Object):
        return [c for name, inner in rule.fields.items() for c in _values(inner, places.get(f"{path}.{name}", _at(v, name)), f"{path}.{name}", places)]
    if isinstance(rule, Text):
        text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        if rule.choices:
            return [(_no(text.isin(*rule.choices)), f"{path}:not_one_of")]
        return [(T.is_blank(text), f"{path}:not_a_nonblank_string")]
    if isinstance(rule, Number):
        x = F.when(kind.rlike("\\A(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
        good = F.abs(x) < float("inf")
        return [(_no(good if rule.above is None else good & (x > rule.above)), f"{path}:not_a_number" if rule.above is None else f"{path}:not_above_{rule.above:g}")]
    if isinstance(rule, Equal):
        name, cast = KINDS[type(rule.value)]
        return [(_no((kind == name) & (F.try_variant_get(v, "$", cast) == F.lit(rule.value))), f"{path}:not_equal")]
    if isinstance(rule, Same):
        return [(_no(F.to_json(v) == F.to_json(F.parse_json(F.lit(rule.json)))), f"{path}:not_the_same")]
    if isinstance(rule, Matches):
        return [(_no((kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.col(rule.column))), f"{path}:mismatch")]
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    wanted = F.col(rule.requested)
    inner = [] if rule.rule is None else [F.flatten(F.transform(items, lambda x: joined([*_shape(rule.rule, x, f"{path}[]", {}), *_values(rule.rule, x, f"{path}[]", {})])))]
    carried = lambda r, x: violations(*[(~_at(x, n, k).eqNullSafe(r[n]), f"{path}[].{n}:mismatch") for n, k in rule.fields.items()])
    return [(_no(F.size(items) == F.size(wanted)), f"{path}:not_as_many"), *inner, F.when(F.size(items) == F.size(wanted), F.flatten(F.zip_with(wanted, items, carried)))]


def joined(checks: list[Check]) -> Column:
    """Checks in order as one array of names."""
    parts: list[Column] = []
    plain: list[tuple[Column, str]] = []
    for c in checks:
        if isinstance(c, tuple):
            plain.append(c)
        else:
            parts += [violations(*plain), F.coalesce(c, F.array().cast("array<string>"))]
            plain = []
    return F.concat(*parts, violations(*plain))


def checked(documents: DataFrame, rule: Object, column: str = "document", also: Callable[[Places], list[tuple[Column, str]]] | None = None) -> DataFrame:
    """documents with violations of a column of JSON text ([0] is the first).

    also: checks between values, from the values by path, after all others. What is no JSON
    has just that violation. Everything stands in its row; nothing is shuffled.
    """
    rows, places = _read(documents.withColumn("__v", F.try_parse_json(column)), rule, "__v")
    v = F.col("__v")
    checks = [*_shape(rule, v, "$", places), *_values(rule, v, "$", places), *(also(places) if also else [])]
    out = rows.withColumn("violations", F.when(v.isNull(), F.array(F.lit("not_json"))).otherwise(joined(checks)))
    return out.select(*documents.columns, "violations")


def resolved(path: Column, base: str) -> Column:
    """An absolute path without empty parts, . and ..; relative ones start at base."""
    p = T.strip(path)
    whole = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p))
    parts = F.split(whole, "/")
    step = lambda s, x: F.when(x.isin("", "."), s).when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, x))
    walked = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(whole.rlike("/\\.{0,2}(/|\\z)"), walked).otherwise(whole)


#: Settings of a run: sections with exactly these fields, in the order in which their values are checked.
SETTINGS = Object({
    "cache_root": Text(), "output_root": Text(), "whisper": Object({"model_path": Text(), "device": Text(), "dtype": Text(("float16", "float32", "bfloat16"))}),
    "ocr": Object({"detector_model_path": Text(), "recognizer_model_path": Text(), "cudnn8_library_path": Text(), "python_executable": Text(), "device": Text(), "timeout_seconds": Number(0.0)}),
    "siglip": Object({"model_path": Text(), "device": Text()}), "qwen": Object({"model_path": Text(), "device": Text()}),
    "frozen_g1": Object({"unirumor_root": Text(), "phase4a_infer": Text(), "phase4a_config": Text(), "python_executable": Text(), "device": Text(), "timeout_seconds": Number(0.0)}),
    "schema_version": Equal(1), "profile": Equal("production"),
})
#: What a frame of a recogniser's output carries over from its request.
CARRIED = {"frame_rank": "bigint", "frame_index": "bigint", "timestamp_sec": "double", "frame_id": "string", "frame_path": "string"}


def settings(documents: DataFrame, base: str, column: str = "document") -> DataFrame:
    """documents with violations of run settings; relative paths start at base, and the two roots must differ when resolved."""
    root = lambda places, name: resolved(F.try_variant_get(places[f"$.{name}"], "$", "string"), base)
    return checked(documents, SETTINGS, column, lambda p: [(root(p, "cache_root") == root(p, "output_root"), "$:roots_not_distinct")])


def recognised(replies: DataFrame, models: str, version: int = 1, column: str = "document") -> DataFrame:
    """replies (session_id, requested: array of structs with the fields CARRIED, and the output as JSON) with violations of the output contract."""
    rule = Object({"schema_version": Equal(version), "status": Equal("ok"), "session_id": Matches("session_id"), "models": Same(models), "frames": Positions("requested", CARRIED, Object({}, closed=False))}, closed=False)
    return checked(replies, rule, column)
