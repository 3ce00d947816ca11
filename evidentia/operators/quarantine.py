"""Failures of single cases: the first violation of the earliest stage takes its case out, and no other case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stages of a case in the order in which they can fail.
STAGES = ("request", "transcripts", "transcript_exposure", "text_exposure", "visual", "composition", "scorer")
KIND = "struct<rank:int,place:bigint,stage:string,violation:string,exception_type:string>"


def failure(stage: str, violation: Column, place: Column | None = None, exception: Column | None = None) -> Column:
    """A failure that can be compared with others: null where violation is."""
    where = F.coalesce((F.lit(0) if place is None else place).cast("bigint"), F.lit(0).cast("bigint"))
    found = F.struct(F.lit(STAGES.index(stage)).cast("int").alias("rank"), where.alias("place"), F.lit(stage).alias("stage"), violation.alias("violation"), F.coalesce(F.lit(None).cast("string") if exception is None else exception, F.lit("ValueError")).alias("exception_type"))
    return F.when(violation.isNotNull(), found).cast(KIND)
