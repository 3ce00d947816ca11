"""Manifest digests against the plain digest of the whole manifest."""

import hashlib
import json
import random

import pytest

from evidentia.operators import manifests


def plain(files):
    rows = [{"path": p, "size": n, "sha256": d} for p, n, d in sorted(files, key=lambda f: (f[0], f[2], f[1]))]
    return hashlib.sha256(json.dumps(rows, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize("run", [1024, 3])
def test_digests_equal_the_plain_one(spark, run):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", None, "é"]), rng.choice(["x/", "", 'q"\\', "漢𝄞", "\n"]) + str(rng.randint(0, 60)), rng.randint(0, 9), f"{rng.randint(0, 3):064x}") for _ in range(400)] + [("one", "f", 1, "0" * 64)]
    got = manifests.manifest_digests(spark.createDataFrame(rows, "group string, path string, size int, sha256 string").repartition(5), run=run)
    want = {g: [r[1:] for r in rows if r[0] == g] for g in {r[0] for r in rows}}
    assert {r["group"]: (r["n_files"], r["manifest_sha256"]) for r in got.collect()} == {g: (len(f), plain(f)) for g, f in want.items()}
    asked = spark.createDataFrame([("one", plain([("f", 1, "0" * 64)]).upper()), ("a", "0" * 64), ("gone", "0" * 64)], "group string, sha256 string")
    assert {r["group"]: r["violations"] for r in manifests.identity_violations(got, asked).collect()} == {"one": [], "a": ["sha256_mismatch"], "gone": ["missing"]}
