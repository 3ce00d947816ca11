"""The scorer's response as JSON, checked in full against what was submitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.numeric import finite, is_close
from .validate import violations

LABELS = ("fake", "real")
TOP_K = 5


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, *kinds: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(f"\\A({'|'.join(kinds)})"), F.lit(False))


def _text(v: Column, path: str) -> Column:
    """A string of v; null for anything else."""
    return F.when(_is(_at(v, path), "STRING"), _at(v, path, "string"))


def _number(v: Column, path: str) -> Column:
    """A finite number of v; null for anything else, truth values too."""
    x = _at(v, path, "double")
    return F.when(_is(_at(v, path), "BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & finite(x), x)


def _count(v: Column, path: str) -> Column:
    """A whole number of at least zero; null for anything else."""
    x = _at(v, path, "bigint")
    return F.when(_is(_at(v, path), "BIGINT") & (x >= 0), x)


def _keys(v: Column, path: str = "$") -> Column:
    at = _at(v, path)
    return F.coalesce(F.when(_is(at, "OBJECT"), F.array_sort(F.json_object_keys(F.to_json(at)))), F.array().cast("array<string>"))


def _scores(v: Column, path: str) -> Column:
    """Whether v has exactly a finite number for each label there."""
    good = _keys(v, path) == F.array(*map(F.lit, LABELS))
    for label in LABELS:
        good = good & _number(v, f"{path}.{label}").isNotNull()
    return F.coalesce(good, F.lit(False))


def _constants(v: Column) -> list[tuple[Column, str]]:
    kinds = {str: ("STRING", "string"), int: ("BIGINT", "bigint"), bool: ("BOOLEAN", "boolean")}
    out = []
    for name, want in fixed.RESPONSE.items():
        kind, cast = kinds[type(want)]
        same = _is(_at(v, f"$.{name}"), kind) & (_at(v, f"$.{name}", cast) == F.lit(want))
        out.append((~F.coalesce(same, F.lit(False)), name))
    return out


def checked(cases: DataFrame) -> DataFrame:
    """cases with violations of their response, in the order in which they are checked ([0] is the first).

    cases: case_id, session_id, claim, submitted (array of unit ids, in order) and
    payload, the response's JSON. Everything stands in one row, so nothing is
    shuffled. Items of lists are checked one after another, each in full.
    """
    v = F.col("v")
    rows = cases.withColumn("v", F.try_parse_json("payload"))
    items = F.when(_is(_at(v, "$.unit_outputs"), "ARRAY"), _at(v, "$.unit_outputs", "array<variant>"))
    top = F.when(_is(_at(v, "$.top_k_selection_units"), "ARRAY"), _at(v, "$.top_k_selection_units", "array<variant>"))
    rows = rows.withColumns({"items": items, "top": top})
    one = lambda x: F.struct(_text(x, "$.unit_id").alias("id"), _text(x, "$.modality").alias("modality"), _number(x, "$.selection_score").alias("score"), _scores(x, "$.veracity_logits").alias("scores"), *[_number(x, f"$.veracity_logits.{c}").alias(c) for c in LABELS])
    rows = rows.withColumns({"out": F.transform("items", one), "top_ids": F.transform("top", lambda x: _text(x, "$.unit_id"))})
    ids = F.transform("out", lambda x: x["id"])
    no = lambda c: ~F.coalesce(c, F.lit(False))

    def of_item(x: Column, i: Column) -> Column:
        return F.array_compact(F.array(
            F.when(x["id"].isNull(), "unit_id"), F.when(x["id"].isNotNull() & no(F.array_contains("submitted", x["id"])), "unknown_unit"),
            F.when(F.array_contains(F.slice(ids, F.lit(1), i), x["id"]), "duplicate_unit"), F.when(no(x["modality"].isin("text", "ocr")), "modality"),
            F.when(x["score"].isNull(), "selection_score"), F.when(~x["scores"], "veracity_logits"),
        ))

    n_out, n_sent = F.coalesce(F.size("out"), F.lit(0)), F.size("submitted")
    prediction, number = _text(v, "$.prediction"), _at(v, "$.prediction_id", "bigint")
    first = violations(
        (no(_is(v, "OBJECT")), "payload"), *_constants(v), (no(_text(v, "$.case_id") == F.col("session_id")), "case_id"), (no(_text(v, "$.claim") == F.col("claim")), "claim"),
        (no(prediction.isin(*LABELS)), "prediction"), (no(_is(_at(v, "$.prediction_id"), "BIGINT") & (number == F.when(prediction == "fake", 0).when(prediction == "real", 1))), "prediction_id"),
        (~_scores(v, "$.sample_logits"), "sample_logits"), (~_scores(v, "$.probabilities"), "probabilities"),
        (no(_count(v, "$.input_unit_count_before_contract") == n_sent), "input_count"), (F.col("items").isNull(), "unit_outputs"),
    )
    inner = F.coalesce(F.flatten(F.transform("out", of_item)), F.array().cast("array<string>"))
    exposed = F.coalesce(ids, F.array().cast("array<string>"))
    last = []
    for label in LABELS:
        at, sample = f"$.max_pool_winner_by_class.{label}", _number(v, f"$.sample_logits.{label}")
        winner = _text(v, f"{at}.unit_id")
        own = F.filter("out", lambda x: x["id"] == winner)  # noqa: B023
        carried = F.get(own, F.lit(0))[label]
        last += [
            (winner.isNull() | no(F.array_contains(exposed, winner)), f"winner_{label}_unknown"), (~_scores(v, f"{at}.veracity_logits"), f"winner_{label}_scores"),
            (no(is_close(_number(v, f"{at}.veracity_logits.{label}"), sample)), f"winner_{label}_logit"), (no(is_close(carried, sample)), f"winner_{label}_unit"),
        ]
    for label in LABELS:
        last.append((no(is_close(F.array_max(F.transform("out", lambda x: x[label])), _number(v, f"$.sample_logits.{label}"))), f"sample_maximum_{label}"))  # noqa: B023
    rest = violations(
        (no(_count(v, "$.model_exposed_unit_count") == n_out), "exposed_count"), (no(_count(v, "$.truncated_unit_count") == n_sent - n_out), "truncated_count"), (n_out <= 0, "nothing_exposed"),
        (F.col("top").isNull(), "top_k"), (F.size("top_ids") > TOP_K, "top_k_size"), (F.exists("top_ids", lambda x: x.isNull()), "top_k_unit_id"),
        (F.size(F.array_distinct("top_ids")) != F.size("top_ids"), "top_k_duplicate"), (F.size(F.array_except("top_ids", exposed)) > 0, "top_k_unknown"),
        (no(_keys(v, "$.max_pool_winner_by_class") == F.array(*map(F.lit, LABELS))), "winners"), *last,
    )
    return rows.withColumn("violations", F.concat(first, inner, rest)).drop("v", "items", "top", "out", "top_ids")


def unit_outputs(cases: DataFrame) -> DataFrame:
    """case_id, unit_id, selection_score, fake, real of the accepted responses (those without violations)."""
    rows = checked(cases).filter(F.size("violations") == 0).select("case_id", F.explode(_at(F.try_parse_json("payload"), "$.unit_outputs", "array<variant>")).alias("x"))
    return rows.select("case_id", _text(F.col("x"), "$.unit_id").alias("unit_id"), _number(F.col("x"), "$.selection_score").alias("selection_score"), *[_number(F.col("x"), f"$.veracity_logits.{c}").alias(c) for c in LABELS])
