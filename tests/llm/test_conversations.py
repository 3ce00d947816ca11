"""Conversation repair against a right-to-left brute force, however the rows are cut into blocks."""

import hashlib
import zlib
from functools import cache

import numpy as np
import pytest
from oracle import rows_of_spark
from pyspark.sql import functions as F

from evidentia.llm import conversations, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines of rows (turn, role, text) in order, from the last row back."""
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    # what has been given out: "" nothing, s, u, a
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @cache
    def best(i, state, inserted):
        found = []
        if i == len(rows):
            found = [(0, "")] if state in ("", "a") else []
        else:
            found.append(prefixed(3, "D", best(i + 1, state, 0)))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                initial = rows[i][1][:1]
                if (state, initial) in after:
                    found.append(prefixed(more, "K", best(i + 1, after[state, initial], 0)))
                for r in "ua":
                    if (state, r) in after:
                        found.append(prefixed(2 + more, "R", best(i + 1, after[state, r], 0)))
        if inserted < 3:
            for r in "ua":
                if (state, r) in after:
                    found.append(prefixed(2, "I", best(i, after[state, r], inserted + 1)))
        return min((x for x in found if x), default=None)

    def prefixed(cost, edit, rest):
        return (rest[0] + cost, edit + rest[1]) if rest else None

    cost, audit = best(0, "", 0)
    lines, i, state = [], 0, ""
    for e in audit:
        if e == "D":
            i += 1
            continue
        role = rows[i][1] if e == "K" else "assistant" if state == "u" else "user"
        lines.append((role, "" if e == "I" else rows[i][2]))
        state = role[:1]
        i += e != "I"
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, tuple(lines)


def brute_of(rows):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    return {c: brute(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for c, v in talks.items()}


def found(repaired):
    out, lines = {}, {}
    for r in sorted(repaired.collect(), key=lambda r: r["piece"]):
        if not r["piece"]:
            assert r["conv_id"] not in out
            out[r["conv_id"]] = tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
        lines.setdefault(r["conv_id"], []).extend((m["role"], m["text"]) for m in r["messages"])
    return {c: (*v, tuple(lines[c])) for c, v in out.items()}


def random_rows(seed, talks, most):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "no", " ", "", "What?", None, "ok!\n", "a\x0b", "Fine. ", "x.", "y!", "so"]
    rows = []
    for c in range(talks):
        conv = None if c == 3 else c
        for _ in range(int(rng.integers(1, most))):
            turn = int(rng.integers(0, 2 * most))
            rows.append((conv, None if rng.random() < 0.1 else turn, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]))
    return rows + rows[:: max(2, talks // 3)]


@pytest.mark.parametrize(("block", "parts", "talks", "most"), [(1024, 4, 60, 12), (3, 3, 25, 12), (2, 5, 2, 60), (5, 4, 1, 90)])
def test_repair_equals_brute_force(spark, block, parts, talks, most):
    rows = random_rows(block, talks, most)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = found(conversations.repair(spark.createDataFrame(rows, SCHEMA), block_rows=block))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute_of(rows)


def test_blocks_join_to_the_whole():
    """Spans of blocks, however cut, give the same cheapest audit as one chart."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        turns = [("usat"[rng.integers(4)], int(rng.integers(4)), 1 + int(rng.integers(5) == 0)) for _ in range(int(rng.integers(1, 14)))]
        whole = conversations.parsed(turns)
        cut = int(rng.integers(len(turns) + 1))
        joined = {}
        for m, (cost, audit) in conversations.parsed(turns[:cut]).items():
            for e, (more, rest) in conversations.parsed(turns[cut:], m).items():
                value = cost + more, audit + rest
                joined[e] = min(joined.get(e, value), value)
        assert joined == whole


def damaged_rows(rows):
    out, every = [], set()
    for conv, turn, role, text in rows:
        every.add(conv)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if case == 1 else text.translate({46: None, 33: None, 63: None}) if case == 2 else text
        out += [(conv, turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out, every


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tmp_path, seed):
    rows = [(9, 0, "user", "Dropped or not.")] + random_rows(seed, 40, 9)
    if seed == 2:
        rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    clash = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit("x")).withColumn("copies", F.lit(5)).withColumn("a.b", F.lit(1))
    clash.write.parquet(f"{tmp_path}/conversations.parquet")
    left, every = damaged_rows(rows)
    empty = (0, 0, 0, 0, 0, 0, "", ())
    want = {c: brute_of(left).get(c, empty) for c in every}
    want = {c: (*w[:-1], hashlib.sha256("\n".join(f"{r}:{t}" for r, t in w[-1]).encode()).hexdigest()) for c, w in want.items()}
    got = queries.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got} == want


def test_one_long_conversation_is_spread(spark):
    """A conversation of 6,000 rows goes through blocks and pieces; its digest is that of the whole."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Line {i % 997}{'.' if i % 5 else ''}") for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    repaired = conversations.repair(df)
    assert repaired.count() > 4
    want = brute_without_recursion(rows)
    got = conversations.digests(repaired).collect()
    assert len(got) == 1
    assert (got[0]["cost"], got[0]["audit"]) == want[0]
    assert got[0]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in want[1]).encode()).hexdigest()


def brute_without_recursion(rows):
    seen, turns = set(), []
    for _, _, role, text in rows:
        turns.append((role[:1], conversations.fault_of(role, text, (role, text) in seen), 1))
        seen.add((role, text))
    chart = conversations.parsed(turns)
    best = min(chart[x] for x in (conversations.START, conversations.ANSWER))
    return best, conversations.edited([(r, t, 1) for _, _, r, t in rows], best[1])


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rows_of_spark(conversations.digests(conversations.repair(conversations.damaged(none), "copies")))[1] == []
