"""Digest-based scores and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .canonical import encoded


def _uniform(digest: Column, at: int) -> Column:
    """16 hex digits of a digest as a number from 0 to 1."""
    return F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float((1 << 64) - 1))


def unit_digest(claim: Column, unit_id: Column, source_type: Column, text: Column) -> Column:
    # a null is an empty field: concat_ws would leave it out and move the others
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in (claim, unit_id, source_type, text)]), 256)


def selection_score(digest: Column) -> Column:
    return F.round(_uniform(digest, 1), 12)


def logit(digest: Column, label: str) -> Column:
    return F.round(_uniform(digest, {"fake": 17, "real": 33}[label]) * 4.0 - 2.0, 12)


def session_id(requested: Column, canonical: Column) -> Column:
    """The requested id if it is safe, else one derived from the canonical request."""
    ok = requested.rlike("\\A[A-Za-z0-9_.-]{1,80}\\z")
    return F.when(F.coalesce(ok, F.lit(False)), requested).otherwise(F.concat(F.lit("session-"), F.substring(F.sha2(canonical, 256), 1, 16)))


def safe_component(c: Column) -> Column:
    return F.coalesce(c.rlike("\\A[A-Za-z0-9_.-]{1,100}\\z"), F.lit(False))


def canonical_json(**fields: Column | tuple[Column, T.DataType]) -> Column:
    """Canonical JSON of named fields: strings, or pairs of a column and its type (without doubles)."""
    parts = []
    for name in sorted(fields):
        c, kind = fields[name] if isinstance(fields[name], tuple) else (fields[name], T.StringType())
        parts += [F.lit(f'{"," if parts else ""}"{name}":'), encoded(c, kind)]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def visual_unit_id(index: Column, observation_type: Column, observation: Column, frame_ids: Column, evidence_refs: Column) -> Column:
    texts = T.ArrayType(T.StringType())
    canonical = canonical_json(index=(index, T.LongType()), observation_type=observation_type, observation=observation, frame_ids=(frame_ids, texts), evidence_refs=(evidence_refs, texts))
    return F.concat(F.lit("visual_"), F.substring(F.sha2(canonical, 256), 1, 20))
