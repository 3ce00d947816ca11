"""Retrieval for many claims against a plain version, with ties, copies and cases cut into many blocks."""

import numpy as np
import pytest

from evidentia.operators import retrieve

CLAIMS = "case_id string, claim_id long, embedding array<float>"
FRAMES = "case_id string, frame_index long, timestamp double, frame_path string, embedding array<float>"


def plain(claims, frames, n):
    out = {}
    unit = lambda v: np.array(v, np.float64) / max(np.sqrt((np.array(v, np.float64) ** 2).sum()), 1e-12)
    usable = lambda v: v and all(x is not None and np.isfinite(x) for x in v)
    time = lambda f: (f[2] is None, f[2] or 0.0, f[1], f[3])
    for case, claim, v in claims:
        if usable(v):
            scored = [(-round(float(unit(v) @ unit(f[4])), 9), *time(f)) for f in frames if f[0] == case and usable(f[4])]
            best = sorted(scored)[:n]
            if best:
                out[case, claim] = [(r, x[3], sorted(best, key=lambda b: b[1:]).index(x)) for r, x in enumerate(best, 1)]
    return out


@pytest.mark.parametrize(("block", "pack"), [(2048, 256), (7, 3)])
def test_claims_against_frames(spark, block, pack):
    rng = np.random.default_rng(7)
    vector = lambda: rng.integers(-1, 2, 4).astype(float).tolist()  # noqa: E731  few values, so many ties
    frames = [("big" if i % 3 else "small", i, None if i % 5 == 0 else float(i % 4), f"p{i % 2}", vector()) for i in range(150)]
    frames += [("big", 900, 1.0, "x", None), ("big", 901, 1.0, "x", []), ("big", 902, 1.0, "x", [1.0, None, 0.0, 0.0]), ("big", 903, 1.0, "x", [float("nan")] * 4), ("empty", 904, 1.0, "x", [])]
    claims = [("big" if i % 4 else "small", i, vector()) for i in range(24)] + [("none", 1, vector()), ("big", 99, None), ("empty", 2, vector())]
    got = {}
    for r in retrieve.retrieved_for_claims(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(frames, FRAMES), 4, block=block, pack=pack).collect():
        got.setdefault((r["case_id"], r["claim_id"]), []).append((r["retrieval_rank"], r["frame_index"], r["ordinal"]))
    assert {k: sorted(v) for k, v in got.items()} == plain(claims, frames, 4)
