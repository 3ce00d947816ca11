"""What a text model sees of a claim: token counts by a plugged-in tokenizer, limits, and an audit of both."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import with_document
from ..functions.numeric import effective_limit
from .stages import staged

#: Fixed values of the audit.
POLICY, PADDING = "right_truncate_for_siglip_retrieval_only", "max_length"
#: Makes, once a task, what counts a batch's texts in tokens, special ones included.
Tokenizer = Callable[[], Callable[[list[str]], list[int]]]


def token_audits(claims: DataFrame, tokenizer: Tokenizer, configured: int, *limits: int, by: str = "case_id") -> DataFrame:
    """claims with an audit of each claim's tokens (a struct), and the same as canonical JSON (`document`).

    claims: by, claim, n_frames. The effective length is the least of the configured
    one and of the model's and the tokenizer's limits (those that lie between 0 and a million).
    A claim beyond it is cut at its right end for retrieval only. A case without frames isn't counted:
    its original count is null, its input has no tokens and its effective length is the configured one.
    A null claim is an empty one.
    """
    rows = claims.withColumn("__text", F.coalesce("claim", F.lit("")))
    shown = rows.filter("n_frames > 0").select(by, F.col("__text").alias("text"))
    kind = shown.schema[by].dataType.simpleString()

    def load() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        count = tokenizer()
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(1).to_pylist()), pa.int64())], names=[by, "n"])

    counts = staged(shown, load, f"{by} {kind}, n long")
    j = rows.join(counts, by, "left")
    limit = effective_limit(F.lit(configured), *map(F.lit, limits))
    some, n = F.col("n").isNotNull(), F.col("n")
    audit = F.struct(
        F.sha2("__text", 256).alias("claim_sha256"), F.lit(configured).alias("configured_max_length"), F.when(some, limit).otherwise(configured).alias("effective_max_length"), F.coalesce(F.least(n, limit), F.lit(0)).cast("long").alias("model_input_token_count"),
        F.lit(True).alias("original_claim_preserved_for_mdu"), n.alias("original_token_count"), F.lit(PADDING).alias("padding"), F.lit(POLICY).alias("policy"), F.coalesce(n > limit, F.lit(False)).alias("truncated"),
    )
    return with_document(j.withColumn("audit", audit).drop("__text", "n"), "document", F.col("audit"))
