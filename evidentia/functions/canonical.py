"""Canonical JSON: compact, keys sorted at every depth, text as it is but for quotes, backslashes and control characters.

The bytes are those that a JSON writer with sorted keys and shortest doubles
gives: 0.00001 is 1e-05, 10.0**16 is 1e+16, minus zero is -0.0, U+001F is \\u001f.
Documents are put in order by their type and written by the built-in writer. What
that one may spell otherwise (doubles with an exponent or more than 15 digits,
control characters without a short escape, the numbers and keys of a VARIANT) is found in the
text, and such rows alone are written again by an Arrow UDF. Short texts for
digests are spelt by expressions alone (see encoded).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control characters that have an escape of their own; the others get four lower-case hexadecimal digits.
SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
#: What the built-in writer may spell otherwise: an exponent, a number of more than 16 characters, an escape by code.
OTHERWISE = r"[0-9]E|[0-9.]{17}|\\u00"


def quoted(c: Column) -> Column:
    """A string with its quotes and escapes; null for null."""
    text = F.regexp_replace(c, '["\\\\]', "\\\\$0")
    for i in range(32):
        text = F.replace(text, F.lit(chr(i)), F.lit(SHORT.get(chr(i), f"\\u{i:04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike('[\\x00-\\x1f"\\\\]'), text).otherwise(c), F.lit('"'))


def encoded(c: Column, kind: T.DataType) -> Column:
    """Canonical JSON of strings, whole numbers, truth values and arrays of them; never null."""
    if isinstance(kind, T.StringType):
        text = quoted(c)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = c.cast("string")
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: encoded(x, kind.elementType)), ","), F.lit("]"))
    else:
        raise TypeError(f"no canonical JSON of {kind.simpleString()} by expressions")
    return F.coalesce(text, F.lit("null"))


def _in_order(c: Column, kind: T.DataType) -> tuple[Column, bool]:
    """c with the fields of structs and the keys of maps sorted at every depth and floats as doubles; whether that changes its type or order."""
    if isinstance(kind, T.FloatType):
        return c.cast("double"), True
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [(f.name, *_in_order(c.getField(f.name), f.dataType)) for f in fields]
        if fields == kind.fields and not any(p[2] for p in parts):
            return c, False
        return F.when(c.isNotNull(), F.struct(*[x.alias(n) for n, x, _ in parts])), True
    if isinstance(kind, T.ArrayType):
        if not _in_order(c, kind.elementType)[1]:
            return c, False
        return F.transform(c, lambda x: _in_order(x, kind.elementType)[0]), True
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("keys of canonical JSON are strings")
        return F.map_from_entries(F.transform(F.array_sort(F.map_keys(c)), lambda k: F.struct(k.alias("k"), _in_order(F.element_at(c, k), kind.valueType)[0].alias("v")))), True
    if isinstance(kind, (T.BinaryType, T.DatetimeType, T.DecimalType, T.AnsiIntervalType)):
        raise TypeError(f"no canonical JSON of {kind.simpleString()}")
    return c, False


def _has_variant(kind: T.DataType) -> bool:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.valueType] if isinstance(kind, T.MapType) else []
    return isinstance(kind, T.VariantType) or any(map(_has_variant, inner))


@F.pandas_udf(T.StringType())
def _rewritten(s: pd.Series) -> pd.Series:
    return s.map(lambda x: json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":")), na_action="ignore")


#: Said not to be deterministic so that no expression is moved across it or written out inside it.
_REWRITTEN = _rewritten.asNondeterministic()


def with_document(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with the canonical JSON of c, a struct, map, array or VARIANT, as the column name; a null value is the text null.

    Doubles that aren't finite are the strings NaN, Infinity and -Infinity. A VARIANT made from JSON
    text holds numbers with a point as decimals, without zeros at their end: 100.0 in that text is 100.
    """
    kind = df.select(c.alias("c")).schema["c"].dataType
    text = F.to_json(_in_order(c, kind)[0], {"ignoreNullFields": "false"})
    out = df.withColumn(name, F.coalesce(text, F.lit("null")))
    again = F.lit(True) if _has_variant(kind) else F.col(name).rlike(OTHERWISE)
    return out.withColumn(name, F.coalesce(_REWRITTEN(F.when(again, F.col(name))), F.col(name)))
