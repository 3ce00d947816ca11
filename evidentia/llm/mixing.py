"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RUN, column, dropped, saved

#: A document is taken at most so many times.
CAP = 3
#: Weights of the sources in order of name, repeating.
WEIGHTS = (1, 2, 3)
#: Newton steps end at a relative distance of so much from the target, or where doubles lie no closer.
NEAR = 1e-7
#: Steps looked at in one pass when the rounding is placed.
STEPS = 64
PASSES = 3
PHASES = 4


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, mean, big for each source: a row for each source only.

    Sources share the total of all sizes by weight; a target stops at CAP times its
    source's size and the excess is shared again by weight among the others.
    The number of sources is small against the rows; they are numbered by a
    sort and met in windows of one row a source.
    """
    from pyspark.sql import Window

    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.max("size").alias("big"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    rows = per.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    rows = rows.withColumn("weight", weight.cast("double")).withColumn("total", F.sum("source_size").over(whole).cast("double"))
    # A source stops at its cap before another if its size against its weight is less: one pass in that order settles all.
    rows = rows.withColumn("ratio", CAP * F.col("source_size") / F.col("weight"))
    up = Window.partitionBy(F.lit(0)).orderBy("ratio", "place")
    rows = rows.withColumn("w_left", F.sum("weight").over(whole) - F.sum("weight").over(up) + F.col("weight"))
    rows = rows.withColumn("t_left", F.col("total") - CAP * (F.sum("source_size").over(up) - F.col("source_size")))
    rows = rows.withColumn("stops", F.col("ratio") * F.col("w_left") <= F.col("t_left"))
    # the level (target a weight) of all that don't stop: that of the first of them
    level = F.min(F.when(~F.col("stops"), F.struct("ratio", "place", (F.col("t_left") / F.col("w_left")).alias("level")))).over(whole)["level"]
    return rows.select("source", "source_size", "n", "big", F.when(F.col("stops"), CAP * F.col("source_size").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def _rate(size: Column, mean: Column, tilt: Column) -> Column:
    return F.least(F.lit(float(CAP)), F.exp(F.least(F.lit(700.0), tilt * size / mean)))


def _state(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of one row a source; sent to every task only while it is small (both plans give the same rows)."""
    t = spark.createDataFrame(rows, schema)
    return F.broadcast(t) if len(rows) <= 100_000 else t


def tilts(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """source, mean, tilt: where the exponentially tilted rates meet each source's target.

    The dual of relative entropy under one token constraint a source and the
    bound CAP is concave in the tilt; its gradient and curvature are sums over
    documents, gathered by source and size. Each Newton step is one such
    distributed sum, of which the driver gets two numbers a source, and stays
    inside a bracket that every step narrows. Sums are of decimals, so they
    don't depend on the order of tasks.
    """
    exact = lambda x: F.sum(x.cast("decimal(30,6)")).cast("double")
    spark = sizes.sparkSession
    cells = saved(sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("docs")), "mix-cells")
    state = {}
    for r in goals.filter("source_size > 0").collect():
        full = r["target"] >= CAP * r["source_size"] * (1 - 1e-12)
        state[r["source"]] = {"mean": r["source_size"] / r["n"], "target": r["target"], "tilt": 1.0e9 if full else 0.0, "low": -1024.0, "high": 1.0e6, "done": full}
    while True:
        todo = [(k, v["mean"], v["tilt"]) for k, v in state.items() if not v["done"]]
        if not todo:
            break
        at = cells.join(_state(spark, todo, "s string, mean double, tilt double"), F.col("source").eqNullSafe(F.col("s")))
        r, n = _rate(F.col("size"), F.col("mean"), F.col("tilt")), F.col("docs") * F.col("size")
        sums = at.groupBy("s").agg(exact(n * r).alias("got"), exact(F.when(r < CAP, n * r * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        for x in sums.collect():
            v = state[x["s"]]
            if abs(x["got"] - v["target"]) <= NEAR * v["target"] + 1e-3 or v["high"] - v["low"] <= 1e-13 * max(1.0, abs(v["tilt"])):
                v["done"] = True
                continue
            v["low" if x["got"] < v["target"] else "high"] = v["tilt"]
            step = v["tilt"] + (v["target"] - x["got"]) / x["slope"] if x["slope"] > 0 else float("nan")
            # beyond the bracket: its middle, or four times as far while it is wide
            middle = max(1.0, 4 * v["low"]) if v["high"] - v["low"] > 4096 else (v["low"] + v["high"]) / 2
            v["tilt"] = step if v["low"] < step < v["high"] else middle
    return _state(spark, [(k, v["mean"], v["tilt"]) for k, v in state.items()], "source string, mean double, tilt double")


def _copies(rate: Column, shift: Column, u: Column) -> Column:
    return F.least(F.lit(CAP), F.greatest(F.lit(0), F.floor(rate + u + shift))).cast("long")


def _sized(docs: DataFrame, text: str) -> Column:
    """The number of words; null texts have none."""
    return F.coalesce(F.regexp_count(column(text), F.lit(WORD_RUN)), F.lit(0)).cast("long")


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """s, source_size, target, mean, tilt, steps for each source: all that a row's copies depend on besides its own key, size and source."""
    spark = docs.sparkSession
    sizes = saved(docs.select(column(key).alias("key"), column(source).alias("source"), _sized(docs, text).alias("size")), "mix-sizes")
    goals = saved(targets(sizes), "mix-goals")
    tilt = tilts(sizes, goals)
    of = goals.join(tilt.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "mean", "tilt")
    rows = saved(_rated(sizes.filter("size > 0"), of, "source", "key", "size").select("source", "size", "target", "rate", "u"), "mix-rows")
    steps = _state(spark, _shifts(rows), "source string, steps array<struct<limit:double,shift:double>>")
    out = saved(of.join(steps, F.col("s").eqNullSafe(F.col("source")), "left").drop("source"), "mix-plan")
    dropped(spark, sizes, goals, rows)
    return out


def _rated(rows: DataFrame, of: DataFrame, source: str, key: str, size: str) -> DataFrame:
    """rows with the columns of its source's row of `of`, rate and u. Sent to every task only while it is small."""
    of = F.broadcast(of) if of.count() <= 100_000 else of
    u = F.pmod(F.xxhash64(F.lit("mix"), column(key), column(size)), F.lit(1 << 40)) / float(1 << 40)
    at = rows.join(of, column(source).eqNullSafe(F.col("s")))
    return at.withColumns({"rate": F.coalesce(_rate(column(size), F.col("mean"), F.col("tilt")), F.lit(0.0)), "u": u})


def _taken(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """docs as one struct row each, with size, source_size, target, rate, copies."""
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("doc"), column(key).alias("key"), column(source).alias("source"), _sized(docs, text).alias("size"))
    done = _rated(rows, plan(docs, key, text, source), "source", "key", "size")
    copies = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(_copies(F.col("rate"), _moved(F.col("size"), F.col("steps")), F.col("u")))
    return done.withColumn("copies", copies)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, size, source_size, target, rate, copies, taken for every row of docs.

    rate is the document's exponentially tilted rate; copies is its rounding:
    floor(rate + u + shift), u being a hash of the key and size and shift the
    source's own, placed so that the words taken meet the target. What one
    document's step leaves open is closed by a further shift among the source's
    smaller documents. Nothing depends on the order or the partition of rows, so
    reruns agree. Null texts have size 0; null is a source of its own, the last.
    Rows that repeat a key, or have none, each have their own copies by their
    size; rows equal in key, size and source have equal copies. An empty table
    gives an empty result.
    """
    done = _taken(docs.select(column(key), column(text), column(source)), key, text, source)
    return done.select(F.col("key").alias(key), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _moved(size: Column, steps: Column) -> Column:
    """The sum of a source's shifts of which the limit reaches size."""
    return F.aggregate(steps, F.lit(0.0), lambda a, s: a + F.when(size <= s["limit"], s["shift"]).otherwise(0.0))


def _shifts(rows: DataFrame) -> list[tuple]:
    """(source, [(limit, shift)]): each source's shifts, found by passes of distributed sums.

    A pass tries STEPS shifts at once in the open bracket and keeps the one
    below the target; PHASES phases shift ever smaller documents (at most
    as large as what is still missing).
    """
    spark = rows.sparkSession
    state = {r["source"]: {"target": r["target"], "steps": [], "limit": float("inf"), "low": -1.0, "high": 1.0, "got": 0.0} for r in rows.groupBy("source").agg(F.first("target").alias("target")).collect()}
    for _ in range(PHASES):
        for _ in range(PASSES):
            few = [(k, [tuple(x) for x in v["steps"]], v["limit"], v["low"], v["high"]) for k, v in state.items()]
            at = rows.join(_state(spark, few, "s string, steps array<struct<limit:double,shift:double>>, limit double, low double, high double"), F.col("source").eqNullSafe(F.col("s")))
            at = at.select("s", "rate", "u", "size", (F.col("size") <= F.col("limit")).alias("moves"), "low", ((F.col("high") - F.col("low")) / STEPS).alias("width"), _moved(F.col("size"), F.col("steps")).alias("base"))
            # as one SQL string: the many sums of a pass are parsed at once
            sums = ", ".join(f"sum(least({CAP}L, greatest(0L, floor(rate + u + base + if(moves, low + {i} * width, 0.0D)))) * size)" for i in range(STEPS + 1))
            for x in at.groupBy("s").agg(F.expr(f"array({sums})").alias("got")).collect():
                v, got = state[x["s"]], x["got"]
                k = max((i for i in range(STEPS) if got[i] <= v["target"]), default=0)
                width = (v["high"] - v["low"]) / STEPS
                v["low"], v["high"], v["got"] = v["low"] + k * width, v["low"] + (k + 1) * width, got[k]
        for v in state.values():
            v["steps"].append((v["limit"], v["low"]))
            v["limit"], v["low"], v["high"] = max(0.0, v["target"] - v["got"]), 0.0, 1.0
    return [(k, v["steps"]) for k, v in state.items()]


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row repeated as often as the mix takes it (see mix), with docs' columns. Rows don't move: a row's copies follow from itself and its source's row."""
    done = _taken(docs, key, text, source).filter("copies > 0")
    return done.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
