"""White space and case folding against the standard library, over all code points."""

import random
import sys

from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import observe


def test_phrases_are_found_as_in_case_folded_text(spark):
    rng = random.Random(6)
    every = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    # each character alone beside phrases that its folding may complete
    texts = [f"a{c}b" for c in every if len(c.casefold()) > 1 or c.casefold() < "\x80"]
    odd = [*text.FOLDS, "İ", "K", "é", "Ä"]
    for _ in range(4000):
        p = rng.choice(observe.PHRASES)
        for f in odd:
            if rng.random() < 0.5 and f.casefold() in p:
                p = p.replace(f.casefold(), f)
        p = "".join(x.upper() if rng.random() < 0.4 else x for x in p)
        cut = rng.randint(0, len(p))
        texts.append(rng.choice(["", "x ", "ſ"]) + (p if rng.random() < 0.6 else p[:cut] + rng.choice(odd) + p[cut:]) + rng.choice(["", "!", "ẞ"]))
    phrases = (*observe.PHRASES, "ss", "ffi", "k", "st", "fl")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("l", F.lower("t"))
    got = {r["i"]: r["found"] for r in df.select("i", text.contains_any(F.col("l"), phrases).alias("found")).collect()}
    assert [t for i, t in enumerate(texts) if got[i] != any(p in t.casefold() for p in phrases)] == []


def test_folds_of_all_code_points_are_known(spark):
    """No other character of the JVM's lower case hides or makes ASCII letters."""
    every = [chr(i) for i in range(128, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([("".join(every[i : i + 1000]),) for i in range(0, len(every), 1000)], "t string")
    for t, low in df.select("t", F.lower("t")).collect():
        a = t.casefold()
        for x in text.REST:
            low = low.replace(x, text.REST[x])
        ascii_of = lambda s: [c for c in s if c < "\x80"]
        assert ascii_of(low) == ascii_of(a)


def test_strip_equals_the_library(spark):
    ends = [c for c in map(chr, range(0x3010)) if c.isspace()] + ["x", "​", "᠎", "﻿"]
    texts = [a + b + "in ner" + c + a for a in ends for b, c in (("", ""), (" ", "\n"))] + ["", " ", "　\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r["i"]: r["s"] for r in df.select("i", text.strip(F.col("t")).alias("s")).collect()} == {i: t.strip() for i, t in enumerate(texts)}
