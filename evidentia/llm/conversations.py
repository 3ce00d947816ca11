"""Repair of conversations: error-correcting Earley parsing under a weighted role grammar.

The roles of a whole conversation must read (s?(ua)+)?: a system turn or none,
then pairs of user and assistant, or nothing at all. The grammar is written
left-recursively, so that every constituent starts at the front and a chart
column holds at most one item for each:

    Lead   -> Start system
    Ask    -> Start user | Lead user | Answer user
    Answer -> Ask assistant
    Talk   -> Start | Answer

and each terminal has error productions: a turn kept (cost 0), given the role
user or assistant (2), deleted (3), or inserted with an empty text (2). An item
keeps the smallest (cost, audit), the audit being the initials of the edits so
far. Two audits of one item with equal costs are never a prefix of each other
(an audit tells the path, so a longer one costs more), which is why the
smallest stays smallest whatever follows.

Conversations lie together in ranges of (conversation, turn, role, text), so a
conversation of any size is spread over tasks. Those that lie inside one task
and are short are parsed there; those that are long or cross the border of two
tasks are parsed in blocks of bounded size, from every constituent a block could
start with, and the blocks' spans are joined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, saved

START, LEAD, ASK, ANSWER = range(4)
#: (constituent, what stands before, initial of the terminal)
RULES = ((LEAD, START, "s"), (ASK, START, "u"), (ASK, LEAD, "u"), (ASK, ANSWER, "u"), (ANSWER, ASK, "a"))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A block has at most so many rows, and ends once it has so many characters of text.
BLOCK_ROWS, BLOCK_CHARS = 1024, 4_000_000
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: What the first fault of a row is.
SOUND, BLANK, DUPLICATE, CUT = range(4)
MESSAGES = "array<struct<role:string,text:string>>"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

#: A chart column: constituent -> (cost, audit).
Chart = dict[int, tuple[int, str]]


def closed(chart: Chart) -> Chart:
    """The column with every turn that could be inserted here."""
    changed = True
    while changed:
        changed = False
        for head, left, initial in RULES:
            if initial in ROLES and left in chart:
                cost, audit = chart[left]
                value = cost + INSERT, audit + "I"
                if head not in chart or value < chart[head]:
                    chart[head] = value
                    changed = True
    return chart


def scanned(chart: Chart, initial: str, fault: int, copies: int) -> Chart:
    """The next column: a row that stands copies times over, of which all but the first are duplicates."""
    out = {left: (cost + DELETE * copies, audit + "D" * copies) for left, (cost, audit) in chart.items()}
    if fault in (SOUND, CUT):
        more = DELETE * (copies - 1) + (TRUNCATED if fault == CUT else 0)
        rest = "D" * (copies - 1)
        for head, left, terminal in RULES:
            if left not in chart:
                continue
            cost, audit = chart[left]
            if terminal == initial:
                value = cost + more, audit + "K" + rest
            elif terminal in ROLES:
                value = cost + REROLE + more, audit + "R" + rest
            else:
                continue
            if head not in out or value < out[head]:
                out[head] = value
    return closed(out)


def parsed(turns: list[tuple[str, int, int]], start: int = START) -> Chart:
    """The last column over turns of (initial, fault, copies), from the constituent start."""
    chart = closed({start: (0, "")})
    for initial, fault, copies in turns:
        chart = scanned(chart, initial, fault, copies)
    return chart


def edited(rows: list[tuple[str, str, int]], audit: str, at: int = START) -> list[tuple[str, str]]:
    """The (role, text) that an audit leaves of rows (role, text, copies), after the constituent at."""
    out: list[tuple[str, str]] = []
    edits = iter(audit)

    def put(role: str | None, text: str) -> None:
        nonlocal at
        if at == START and role is not None and role[:1] == "s":
            at = LEAD
        else:
            at = ANSWER if at == ASK else ASK
        out.append((role if role is not None else ROLES["a" if at == ANSWER else "u"], text))

    for role, text, copies in rows:
        for _ in range(copies):
            edit = next(edits)
            while edit == "I":
                put(None, "")
                edit = next(edits)
            if edit == "K":
                put(role, text)
            elif edit == "R":
                put(None, text)
    for _ in edits:
        put(None, "")
    return out


def fault_of(role: str, text: str, seen: bool) -> int:
    last = text.rstrip(SPACE)[-1:]
    return BLANK if not last else DUPLICATE if seen else SOUND if last in ".!?" else CUT


class Tally:
    """Counts over rows in order; two neighbouring tallies can be added."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low: int | None = None
        self.high: int | None = None
        self.first: str | None = None
        self.last: str | None = None

    def add(self, turn: int | None, initial: str, fault: int, copies: int) -> None:
        if fault == BLANK:
            self.blank += copies
        else:
            self.duplicate += copies - (fault != DUPLICATE)
            self.truncated += fault == CUT
        self.illegal += copies - 1
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def follow(self, other: dict) -> None:
        """Add the tally of what comes next, as a record."""
        self.blank += other["blank"]
        self.duplicate += other["duplicate"]
        self.truncated += other["truncated"]
        self.illegal += other["illegal"]
        if self.last is not None and other["first"] is not None:
            self.illegal += self.last + other["first"] not in ("su", "ua", "au")
        self.last = self.last if other["last"] is None else other["last"]
        if other["low"] is not None:
            self.turns += other["turns"] - (other["low"] == self.high)
            self.low = other["low"] if self.low is None else self.low
            self.high = other["high"]

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _repaired(rows: list[tuple]) -> dict:
    """All of a conversation whose rows (turn, role, text, copies) lie together."""
    seen: set = set()
    tally, turns = Tally(), []
    for turn, role, text, copies in rows:
        fault = fault_of(role, text, (role, text) in seen)
        seen.add((role, text))
        tally.add(turn, role[:1], fault, copies)
        turns.append((role[:1], fault, copies))
    chart = parsed(turns)
    cost, audit = min(chart[x] for x in (START, ANSWER) if x in chart)
    messages = edited([x[1:] for x in rows], audit)
    return {"gaps": tally.gaps, "blank": tally.blank, "duplicate": tally.duplicate, "truncated": tally.truncated, "illegal": tally.illegal, "cost": cost, "audit": audit, "messages": [{"role": r, "text": t} for r, t in messages]}


def _batches(records: Iterator[dict], schema: pa.Schema, rows: int = 512, chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Records as batches of a bounded number of rows and characters (each record says its own under size)."""
    held: list[dict] = []
    size = 0
    for r in records:
        size += r.pop("size", 0)
        held.append(r)
        if len(held) >= rows or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(kinds: str, conv: pa.DataType) -> pa.Schema:
    one = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), MESSAGES: pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}
    return pa.schema([("conv", conv), *((n, one[k]) for n, k in (x.split(" ") for x in kinds.split(", ")))])


WALKED = f"part int, block int, at int, turn long, role string, text string, copies long, first boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, messages {MESSAGES}"


def _walk(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a range: whole conversations repaired; rows of the first, the last and of long ones passed on in blocks."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    conv_type: list[pa.DataType] = []

    def rows() -> Iterator[tuple]:
        for batch in batches:
            conv_type[:] = [batch.schema.field("conv").type]
            yield from zip(*(batch[n].to_pylist() for n in ("conv", "turn", "role", "text", "copies")))

    def records() -> Iterator[dict]:
        held: list[tuple] = []
        conv, any_before, is_open = None, False, True
        size = block = at = inside = 0
        seen: set = set()

        def passed(row: tuple) -> dict:
            nonlocal block, at, inside, size
            turn, role, text, copies = row
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            first = digest not in seen
            seen.add(digest)
            if at - inside >= block_rows or size > BLOCK_CHARS:
                block, inside, size = block + 1, at, 0
            at += 1
            size += len(text)
            return {"conv": conv, "part": part, "block": block, "at": at, "turn": turn, "role": role, "text": text, "copies": copies, "first": first, "size": len(text)}

        def whole() -> dict:
            out = _repaired([x for x in held if x[3]])
            return out | {"conv": conv, "size": sum(len(x[2]) for x in held)}

        for key, *row in rows():
            if not any_before or key != conv:
                if any_before and not is_open:
                    yield whole()
                # The first conversation of a range may have begun in the range before.
                conv, is_open, any_before = key, not any_before, True
                held, seen = [], set()
                size = block = at = inside = 0
            if is_open:
                yield passed(tuple(row))
                continue
            held.append(tuple(row))
            size += len(row[2])
            if len(held) > block_rows or size > BLOCK_CHARS:
                is_open, size = True, 0
                for x in held:
                    yield passed(x)
                held = []
        if any_before and not is_open:  # the last one may go on in the next range
            size = 0
            for x in held:
                yield passed(x)

    made = records()
    first = next(made, None)
    if first is None:
        return

    def all_records() -> Iterator[dict]:
        yield first
        yield from made

    yield from _batches(all_records(), _arrow(WALKED, conv_type[0]))


SPANS = "array<struct<start:int,end:int,cost:long,audit:string>>"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's tally and what it costs from every constituent to every other."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for batch in batches:
        out = []
        for conv, part, block, turns in zip(*(batch[n].to_pylist() for n in ("conv", "part", "block", "turns"))):
            tally = Tally()
            for t in turns:
                tally.add(t["turn"], t["initial"], t["fault"], t["copies"])
            charts = {s: parsed([(t["initial"], t["fault"], t["copies"]) for t in turns], s) for s in (START, LEAD, ASK, ANSWER)}
            spans = [{"start": s, "end": e, "cost": c, "audit": a} for s, chart in charts.items() for e, (c, a) in chart.items()]
            out.append({"conv": conv, "part": part, "block": block, **{k: v for k, v in vars(tally).items()}, "spans": spans})
        kinds = [("conv", batch.schema.field("conv").type), ("part", pa.int32()), ("block", pa.int32()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")), ("first", pa.string()), ("last", pa.string()), ("spans", span)]
        yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))


def _less(a: tuple | None, b: tuple | None) -> bool:
    """Whether the audit of chain a is smaller than that of chain b. Chains are (before, part of the audit, constituent)."""
    left, right = [], []
    while a is not b:
        left.append(a[1])
        right.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order joined: a row a block with its part of the audit and the constituent it starts after; the first also has the whole conversation's counts."""
    conv_type: list[pa.DataType] = []

    def blocks() -> Iterator[dict]:
        for batch in batches:
            conv_type[:] = [batch.schema.field("conv").type]
            yield from batch.to_pylist()

    def records() -> Iterator[dict]:
        conv, any_before = None, False
        tally, best, places = Tally(), {}, []

        def end() -> Iterator[dict]:
            x = best[START]
            if ANSWER in best and (best[ANSWER][0] < x[0] or (best[ANSWER][0] == x[0] and _less(best[ANSWER][1], x[1]))):
                x = best[ANSWER]
            cost, chain = x
            parts = []
            while chain[0] is not None:
                parts.append((chain[1], chain[0][2]))
                chain = chain[0]
            parts.reverse()
            whole = {"gaps": tally.gaps, "blank": tally.blank, "duplicate": tally.duplicate, "truncated": tally.truncated, "illegal": tally.illegal, "cost": cost, "audit": "".join(p[0] for p in parts)}
            for i, ((part, block), (audit, after)) in enumerate(zip(places, parts)):
                yield {"conv": conv, "part": part, "block": block, "piece": i, "pieces": len(parts), "after": after, "edits": audit, **(whole if not i else {}), "size": len(audit)}

        for b in blocks():
            if not any_before or b["conv"] != conv:
                if any_before:
                    yield from end()
                conv, any_before = b["conv"], True
                tally, best, places = Tally(), {START: (0, (None, "", START))}, []
            tally.follow(b)
            places.append((b["part"], b["block"]))
            new: dict = {}
            for s in b["spans"]:
                if s["start"] not in best:
                    continue
                cost, chain = best[s["start"]]
                value = cost + s["cost"], (chain, s["audit"], s["end"])
                old = new.get(s["end"])
                if old is None or value[0] < old[0] or (value[0] == old[0] and _less(value[1], old[1])):
                    new[s["end"]] = value
            best = new
        if any_before:
            yield from end()

    made = records()
    first = next(made, None)
    if first is None:
        return

    def all_records() -> Iterator[dict]:
        yield first
        yield from made

    yield from _batches(all_records(), _arrow(JOINED, conv_type[0]))


JOINED = "part int, block int, piece int, pieces int, after int, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        out = []
        for rows, edits, after in zip(*(batch[n].to_pylist() for n in ("rows", "edits", "after"))):
            out.append([{"role": r, "text": t} for r, t in edited([(x["role"], x["text"], x["copies"]) for x in rows], edits, after)])
        keep = batch.select(["conv", "piece", "pieces", *COUNTS, "audit"])
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(out, kind)], schema=pa.schema([*keep.schema, ("messages", kind)]))


def repair(conversations: DataFrame, copies: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, piece, pieces, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, messages.

    conversations has conv_id (any type that can be sorted), turn, role, text;
    other columns don't matter. copies names a column that says how often a row
    stands there; 0 means that only its conversation counts. A conversation has
    one row, or, where it is long or lay on a border between tasks, several pieces
    in order: messages are then spread over the pieces and the other columns
    stand in piece 0 only; a piece has about block_rows rows at most. messages are the repaired turns as (role, text).

    Null roles and texts are one space; a null turn comes first and counts for no
    gap; a null conv_id is a conversation. Rows with equal turns are taken by role,
    then text, so the result doesn't depend on the order of the rows; rows equal in
    all four follow each other as duplicates. A conversation without rows costs
    nothing and has an empty audit and no messages. An empty table gives none.
    """
    spark = conversations.sparkSession
    n = F.coalesce(column(copies).cast("long"), F.lit(0)) if copies else F.lit(1).cast("long")
    text = lambda name: F.coalesce(column(name).cast("string"), F.lit(" "))
    rows = conversations.select(column("conv_id").alias("conv"), column("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), n.alias("copies"))
    real = F.col("copies") > 0
    rows = rows.select("conv", F.when(real, F.col("turn")).alias("turn"), *(F.when(real, F.col(c)).otherwise(" ").alias(c) for c in ("role", "text")), F.greatest("copies", F.lit(0)).alias("copies"))
    keys = ["conv", "turn", "role", "text"]
    conv = rows.schema["conv"].dataType.simpleString()
    lying = rows.groupBy(*keys).agg(F.sum("copies").alias("copies")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    walked = saved(lying.mapInArrow(partial(_walk, block_rows=block_rows), f"conv {conv}, {WALKED}"), "talks")
    done = walked.filter("part is null").select("conv", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), *COUNTS, "audit", "messages")

    place = ["conv", "part", "block"]
    some = walked.filter("part is not null")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    lines = some.select(
        *place, "at", "turn", "copies", "first", digest.alias("digest"), F.substring("role", 1, 1).alias("initial"), F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)).alias("end")
    )
    # A text is new in its range where it comes first there; it is new in the conversation in the first of these ranges.
    ranges = lines.filter(F.col("first") & (F.col("copies") > 0)).groupBy("conv", "digest").agg(F.min("part").alias("new_in"))
    found = lines.filter("first").alias("l").join(ranges.alias("r"), [F.col(f"l.{x}").eqNullSafe(F.col(f"r.{x}")) for x in ("conv", "digest")], "left")
    flagged = found.select("l.*", F.coalesce(F.col("part") > F.col("new_in"), F.lit(False)).alias("seen")).unionByName(lines.filter("not first").withColumn("seen", F.lit(True)))
    fault = F.when(F.col("end") == "", BLANK).when(F.col("seen"), DUPLICATE).when(F.col("end").isin(".", "!", "?"), SOUND).otherwise(CUT)
    turn = F.when(F.col("copies") > 0, F.struct("at", "turn", "initial", fault.alias("fault"), "copies"))
    blocks = flagged.groupBy(*place).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = f"conv {conv}, part int, block int, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, spans {SPANS}"
    ordered = blocks.mapInArrow(_spans, spans).repartition("conv").sortWithinPartitions("conv", "part", "block")
    chosen = saved(ordered.mapInArrow(_joined, f"conv {conv}, {JOINED}"), "talk-blocks")
    texts = some.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "copies"))).alias("rows"))
    texts = texts.alias("t").join(chosen.alias("c"), [F.col(f"t.{x}").eqNullSafe(F.col(f"c.{x}")) for x in place])
    texts = texts.select("t.conv", "rows", "piece", "pieces", "after", "edits", *COUNTS, "audit")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    pieced = texts.mapInArrow(_pieces, f"conv {conv}, piece int, pieces int, {counts}, audit string, messages {MESSAGES}")
    return done.unionByName(pieced).withColumnRenamed("conv", "conv_id")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its pieces in order, the digest fed piece by piece."""
    head, digest, empty = None, None, True
    for batch in batches:
        out = []
        for i, messages in enumerate(batch["messages"].to_pylist()):
            if batch["piece"][i].as_py() == 0:
                if head is not None:
                    out.append((head, digest.hexdigest()))
                head, digest, empty = batch.slice(i, 1).drop_columns(["messages", "piece"]), hashlib.sha256(), True
            for m in messages:
                digest.update((("" if empty else "\n") + m["role"] + ":" + m["text"]).encode())
                empty = False
        if out:
            yield _with_digests(out)
    if head is not None:
        yield _with_digests([(head, digest.hexdigest())])


def _with_digests(found: list[tuple[pa.RecordBatch, str]]) -> pa.RecordBatch:
    t = pa.Table.from_batches([x[0] for x in found]).append_column("repaired_sha256", pa.array([x[1] for x in found]))
    return t.combine_chunks().to_batches()[0]


def digests(repaired: DataFrame) -> DataFrame:
    """One row a conversation of what repair gives: the counts, audit, repaired_sha256 of its role:text lines. Pieces are streamed in order."""
    line = lambda m: F.concat(m["role"], F.lit(":"), m["text"])
    cols = ["conv_id", *COUNTS, "audit"]
    one = repaired.filter("pieces = 1").select(*cols, F.sha2(F.array_join(F.transform("messages", line), "\n"), 256).alias("repaired_sha256"))
    many = repaired.filter("pieces > 1").select("piece", *cols, "messages").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return one.unionByName(many.mapInArrow(_digests, one.schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by pmod(crc32(conv_id:turn), 20).

    0 drops a row (copies 0), 1 empties its text, 2 takes . ! ? out of it, 3
    lets it stand twice, 4 gives it the role user. Nulls are one space, also in
    the key; a null turn stays null for sorting.
    """
    plain = lambda name: F.coalesce(column(name).cast("string"), F.lit(" "))
    case: Column = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))), F.lit(20))
    rows = conversations.select(column("conv_id").alias("conv_id"), column("turn").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), case.alias("case"))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("case") == 0, 0).when(F.col("case") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))
