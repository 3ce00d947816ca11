"""Canonical JSON against the standard library's writer."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions import canonical

ODD = [0.0, -0.0, 1e-5, 1e-4, 123456.0, 1e15, 1e16, 1e17, 123456789012345680.0, 5e-324, 2.2e-322, 1.7976931348623157e308, 8.41e21, 2e-3, 1e23, 9.999999999999999e22, 0.1 + 0.2, 1 / 3, 2.0**-44, 1e22, 1e7, 9999999.999, 1e-3, 4.35, 100.0, 2.0**53, 2.0**63, float("nan"), float("inf"), -float("inf"), -1.5e-10, 12345678.9]


def dumps(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_doubles(spark):
    rng = random.Random(1)
    values = ODD + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(3000)] + [round(rng.uniform(0, 1000), rng.randint(0, 12)) for _ in range(2000)]
    values += [math.ldexp(1.0, k) for k in range(-1074, 1024)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    got = {r["i"]: r["t"] for r in canonical.with_document(df, "t", F.array("x")).collect()}
    wrong = [(x, got[i]) for i, x in enumerate(values) if got[i] != dumps([x if math.isfinite(x) else dumps(x)])]
    assert wrong == []


TEXTS = ["", "plain", 'q"b\\s/', "tab\tline\n\r\b\f", "".join(map(chr, range(32))), "\x7f é漢𝄞", "\\u001F", None, "a" * 50]


def typed(rng):
    text = lambda: rng.choice(TEXTS)
    number = lambda: rng.choice([None, *filter(math.isfinite, ODD), rng.random()])
    return {
        "z": number(),
        "a": rng.choice([None, {"y": rng.choice([None, [number() for _ in range(rng.randint(0, 4))]]), "x": text(), 'q"k': rng.randint(-9, 9)}]),
        "m": {k: rng.choice([None, [{"b": rng.choice([True, False, None]), "a": text()} for _ in range(rng.randint(0, 3))]]) for k in rng.sample(["b", "a", "", "𝄞", "", 'c"\x1f', "Z"], rng.randint(0, 6))},
        "l": rng.choice([None, 2**62, -3]),
        "n": rng.choice([None, 0.5, 3.0]),
    }


def free(rng, depth=0):
    """A value for VARIANT; numbers with a point are doubles where they are large or small."""
    kind = rng.randint(0, 8 if depth < 6 else 5)
    if kind > 6:
        return {rng.choice(["k", "j", "é", 'x"', "\x01", "𝄞", ""]) + str(rng.randint(0, 9)): free(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if kind == 6:
        return [free(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return [rng.choice([x for x in TEXTS]), rng.randint(-(10**12), 10**12), rng.choice([1.5, 0.1, 1e-7, 1.25e30, -2.75]), rng.random(), True, None][kind]


def test_random_nested_values(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        x, v = typed(rng), free(rng)
        if isinstance(v, (int, float, str)) or v is None:
            v = [v]
        rows.append((i, x["z"], x["a"] and (x["a"]["y"], x["a"]["x"], x["a"]['q"k']), x["m"], x["l"], x["n"], json.dumps(v), dumps(x | {"v": v})))
    kinds = T.StructType.fromDDL("i int, z double, a struct<y:array<double>,x:string,`q\"k`:int>, m map<string,array<struct<b:boolean,a:string>>>, l bigint, n float, v string, want string")
    df = spark.createDataFrame(rows, kinds).withColumn("v", F.parse_json("v"))
    df = df.select("i", "want", F.struct("z", "a", "m", "l", "n", "v").alias("d"))
    got = canonical.with_document(df, "t", F.col("d")).collect()
    wrong = [(r["t"], r["want"]) for r in got if r["t"] != r["want"]]
    assert [next((a[max(0, i - 40) : i + 40], b[max(0, i - 40) : i + 40]) for i in range(len(a)) if a[i : i + 1] != b[i : i + 1]) for a, b in wrong] == []
    assert len(got) == 400


def test_short_texts_and_what_is_refused(spark):
    texts = [x for x in TEXTS if x is not None]
    df = spark.createDataFrame([(i, x, [x, None, "b"], i > 2) for i, x in enumerate(texts)], "i int, x string, a array<string>, b boolean")
    one = [canonical.encoded(F.col(c), df.schema[c].dataType).alias(c) for c in ("i", "x", "a", "b")]
    assert [tuple(r) for r in df.select(*one).collect()] == [(dumps(i), dumps(x), dumps([x, None, "b"]), dumps(i > 2)) for i, x in enumerate(texts)]
    for kind in (T.BinaryType(), T.DoubleType()):
        with pytest.raises(TypeError, match="no canonical JSON"):
            canonical.encoded(F.lit(None), kind)
    for c in (F.struct(F.current_timestamp().alias("t")), F.create_map(F.lit(1), F.lit(2))):
        with pytest.raises(TypeError, match="canonical JSON"):
            canonical.with_document(df, "t", c)
