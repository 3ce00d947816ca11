"""Line dedup: an exact set-similarity join over lines, in DataFrame functions only."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, column, dense, dropped, few, free_name, saved

#: Similarity from which two lines match, in tenths.
TENTHS = 8
#: Token counts are kept for so many hash buckets, whatever the vocabulary.
SKETCH_BITS = 18
WORD_CHAR = "[^\\x20\\x09-\\x0D]"


def _has_any(text: Column, parts: list[str]) -> Column:
    """Whether a text holds any of the parts; a search for bytes, which costs a fraction of a regular expression over the whole text."""
    return reduce(Column.__or__, [text.contains(x) for x in parts])


#: White space of WORD_SPLIT but for the space and the end of a line.
OTHER_SPACE = ["\t", "\x0b", "\x0c", "\r"]


def _words(text: Column) -> Column:
    """The words of a line; splitting at single spaces is quicker where that is enough."""
    odd = _has_any(text, [*OTHER_SPACE, "  "]) | text.startswith(" ") | text.endswith(" ") | (text == "")
    return F.when(odd, F.array_remove(F.split(text, WORD_SPLIT), "")).otherwise(F.split(text, " "))


def numbered_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, h, line, words: each line by its document's key, its text's hash and its place."""
    return docs.select(column(key).alias("doc"), F.xxhash64(column(text)).alias("h"), F.posexplode(F.split(column(text), "\n")).alias("line", "words"))


def token_levels(docs: DataFrame, text: str = "text") -> DataFrame:
    """A sketch of how often each token occurs, one row, one column x: twice the binary logarithm of its bucket's count.

    A token's bucket is the first SKETCH_BITS bits of its hash. The sketch holds
    what turns the hash's first seven bits into the level by exclusive or; it has a fixed
    size, 8 bytes a bucket.
    """
    words = F.when(_has_any(column(text), OTHER_SPACE), F.split(column(text), WORD_SPLIT)).otherwise(F.split(F.replace(column(text), F.lit("\n"), F.lit(" ")), " "))
    tokens = docs.select(F.explode(words).alias("w")).filter("w <> ''")
    counts = tokens.groupBy(F.shiftrightunsigned(F.xxhash64("w"), 64 - SKETCH_BITS).alias("bucket")).count()
    marks = counts.select("bucket", F.least(F.lit(63), F.floor(2 * F.log2("count")) + 1).alias("level"))
    turn = F.transform("x", lambda x, i: F.shiftleft(x.cast("long").bitwiseXOR(F.shiftright(i, SKETCH_BITS - 7).cast("long")), 57))
    return dense(marks, 1 << SKETCH_BITS, "int").select(turn.alias("x"))


def _hashes(line: Column) -> Column:
    """The hashes of a line's distinct tokens."""
    return F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))


def _by_rarity(hashes: Column, levels: Column) -> Column:
    """The tokens as numbers that sort by rarity, rarest first.

    The seven highest bits hold the sketch's level, the rest are the token's
    hash. Any total order of tokens gives an exact prefix filter; this one puts
    rare tokens first.
    """
    # every bucket has a level; said to be without nulls, the array is sorted as one of plain numbers
    level = lambda h: F.coalesce(levels[F.shiftrightunsigned(h, 64 - SKETCH_BITS).cast("int")], F.lit(0).cast("long"))
    return F.sort_array(F.transform(hashes, lambda h: h.bitwiseXOR(level(h))))


def _sketch(tokens: Column, marked: bool) -> Column:
    """64 bits of an odd sketch: each token, or if marked each with its seventh bit set, flips the one of them that its last six bits number."""
    place = lambda h: h.bitwiseAND(F.lit(63).cast("long")).cast("int")
    flip = lambda h: F.call_function("shiftleft", F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(1).cast("long")) if marked else F.lit(1).cast("long"), place(h))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(flip(h)))


def _prefix(n: Column) -> Column:
    """How many of the rarest tokens of a set of n hold one of any set with a similarity of 0.8: n - ceil(0.8 n) + 1. Sets of up to three tokens match equal sets only."""
    return F.when(n <= 3, F.lit(0)).otherwise(n - F.ceil(n * TENTHS / F.lit(10)) + 1).cast("int")


def token_classes(docs: DataFrame, levels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n, every, high, prefix, doc, h, line: one row for each token set, with its first line; ids follow the order of these lines.

    prefix holds the tokens among which two matching sets must share one (as
    32-bit numbers, only to find candidates); every and high are the set's odd sketch.
    """
    # not a filter by n, which the optimizer would push down with all of t in it
    # a subquery can't stand in a lambda, so the sketch is a column of each row, by reference
    lines = numbered_lines(docs, key, text).filter(F.col("words").rlike(WORD_CHAR)).withColumn("levels", levels.scalar())
    rows = lines.select("doc", "h", "line", _by_rarity(_hashes(F.col("words")), F.col("levels")).alias("t")).withColumn("n", F.size("t"))
    prefix = F.transform(F.slice("t", F.lit(1), _prefix(F.col("n"))), lambda x: F.hash(x))
    rows = rows.select("doc", "h", "line", "n", F.xxhash64("t").alias("k1"), F.hash("t").alias("k2"), _sketch(F.col("t"), False).alias("every"), _sketch(F.col("t"), True).alias("high"), prefix.alias("prefix"))
    # the row numbers' limit holds before the shuffle too, so a set with a third of all lines sends one row a task
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("doc", "h", "line"))
    first = rows.withColumn("nth", nth).filter("nth = 1").drop("nth", "k1", "k2")
    # ranges in order, rows in order, so the ids that Spark deals out are in order
    return first.repartitionByRange("doc", "h", "line").sortWithinPartitions("doc", "h", "line").withColumn("id", F.monotonically_increasing_id())


def _similar(x: str, y: str) -> Column:
    """Length, positional and sketch filters for two rows of the index.

    A token that only one of two sets has flips one bit of the sketches' difference, and
    one that both have flips none, so similar sets differ in no more bits than tokens.
    128 bits tell sets of up to about 250 tokens apart that share only a few; pairs of larger
    ones come through and are left to the comparison of their tokens.
    """
    c = lambda side, name: F.col(f"{side}_{name}")
    length = (c(x, "n") * 10 >= c(y, "n") * TENTHS) & (c(y, "n") * 10 >= c(x, "n") * TENTHS)
    # shared tokens that a similarity of 0.8 needs: t / (1 + t) of both sizes
    need = F.ceil((c(x, "n") + c(y, "n")) * TENTHS / F.lit(10 + TENTHS))
    place = F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos")) >= need
    # what the unmarked tokens flipped is what every token did without what the marked did
    marked, every = c(x, "high").bitwiseXOR(c(y, "high")), c(x, "every").bitwiseXOR(c(y, "every"))
    flipped = F.bit_count(marked) + F.bit_count(every.bitwiseXOR(marked))
    return length & place & (flipped <= c(x, "n") + c(y, "n") - 2 * need)


def candidates_with_first(classes: DataFrame) -> DataFrame:
    """Pairs (a, b): b with the first set a under a token they share among the rarest. As many as such tokens at most.

    Only the part of the prefix is looked at in which two sets of one size must
    meet: this round thins out groups of copies and needn't find all pairs.
    """
    short = (F.col("n") - F.ceil(F.col("n") * (2 * TENTHS) / F.lit(10 + TENTHS)) + 1).cast("int")
    index = classes.filter("n > 3").select("id", "n", "every", "high", F.posexplode(F.slice("prefix", F.lit(1), short)).alias("pos", "token"))
    by = Window.partitionBy("token").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ("id", "n", "pos", "every", "high")
    rows = index.withColumn("a", F.first(F.struct(*own)).over(by))
    rows = rows.select(*[F.col(c).alias(f"b_{c}") for c in own], *[F.col(f"a.{c}").alias(f"a_{c}") for c in own])
    return rows.filter((F.col("a_id") < F.col("b_id")) & _similar("a", "b")).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def candidates(classes: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs (a, b) for the sets b that have no pair in near yet, and all earlier sets a that pass the filters.

    Both sides are the same rows, shuffled once (a reused exchange). For this,
    whether a set is open stands in its id's last bit and is asked for in a
    condition on both sides, which the optimizer can't move to one of them.
    """
    done = near.select(F.col("b").alias("id")).distinct().withColumn("done", F.lit(True))
    number = (F.col("id") * 2 + F.when(F.col("done"), 0).otherwise(1)).alias("code")
    index = classes.filter("n > 3").join(done, "id", "left").select(number, "n", "every", "high", F.posexplode("prefix").alias("pos", "token"))
    a, b = (index.select([F.col(c).alias(f"{side}_{c}") for c in ("token", "code", "n", "pos", "every", "high")]) for side in "ab")
    later = F.when(F.col("a_code") < F.col("b_code"), F.col("b_code") % 2 == 1).otherwise(False)
    found = a.join(b, (F.col("a_token") == F.col("b_token")) & later & _similar("a", "b"))
    return found.select(F.shiftright("a_code", 1).alias("a"), F.shiftright("b_code", 1).alias("b")).distinct()


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of at least 0.8, by the tokens of their first lines."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    place = ["doc", "h", "line"]
    wanted = saved(classes.join(ids, "id", "left_semi").select("id", *place), "line-wanted")
    at = wanted.select("id", *[F.col(c).alias(f"at_{c}") for c in place])
    # whole documents first, so that most texts aren't cut into lines
    own = docs.select(column(key).alias("doc"), F.xxhash64(column(text)).alias("h"), column(text).alias("t"))
    own = few(own, wanted, place[:2], place[:2]).select("doc", "h", F.posexplode(F.split("t", "\n")).alias("line", "words"))
    rows = few(own, wanted, place, place)
    same = F.col("doc").eqNullSafe(F.col("at_doc")) & (F.col("h") == F.col("at_h")) & (F.col("line") == F.col("at_line"))
    # rows equal in key and text hold equal lines
    lines = saved(rows.join(at, same).select("id", "words").dropDuplicates(["id"]), "line-words")
    dropped(docs.sparkSession, wanted)
    tokens = lines.select("id", _hashes(F.col("words")).alias("t"))
    both = pairs.join(tokens.select(F.col("id").alias("a"), F.col("t").alias("x")), "a").join(tokens.select(F.col("id").alias("b"), F.col("t").alias("y")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("s"), (F.size("x") + F.size("y")).alias("n"))
    out = saved(shared.filter(F.col("s") * (10 + TENTHS) >= F.col("n") * TENTHS).select("a", "b"), "line-links")
    dropped(docs.sparkSession, lines, pairs)
    return out


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, links) of the similarity join of all lines of docs with earlier ones.

    classes: one row for each token set, see token_classes.
    links: a < b, for every set b with an earlier set of Jaccard similarity of at
    least 0.8 one or more such sets a. Sets are first held against the
    first of those that share one of their rarest tokens; only those that this
    leaves open are joined with all earlier sets, so a group of near copies isn't
    spelt out in pairs and no set with an earlier match is missed.
    """
    levels = saved(token_levels(docs, text), "line-levels")
    classes = saved(token_classes(docs, levels, key, text), "line-classes")
    dropped(docs.sparkSession, levels)
    pairs = saved(candidates_with_first(classes), "line-pairs")
    dropped(docs.sparkSession)
    near = verified(docs, classes, pairs, key, text)
    pairs = saved(candidates(classes, near), "line-pairs")
    dropped(docs.sparkSession)
    rest = verified(docs, classes, pairs, key, text)
    return classes, near.unionByName(rest)


def firsts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, h, stay, near for each document that holds the first line of a token set; a document is a key and a text (by its hash h).

    A line goes if an earlier one (by key, null first, then text's hash, then
    place) matches it: has an equal token set, or one with a Jaccard similarity of at
    least 0.8, whether that one stays or not. So of the lines with a word just
    those in stay remain: first lines of their set without an earlier similar
    set. near lists the places of first lines that go.
    """
    classes, links = matches(docs, key, text)
    near = links.select(F.col("b").alias("id")).distinct().withColumn("near", F.lit(True))
    marked = classes.select("id", "doc", "h", "line").join(near, "id", "left")
    out = saved(marked.groupBy("doc", "h").agg(F.collect_list(F.when(F.col("near").isNull(), F.col("line"))).alias("stay"), F.collect_list(F.when(F.col("near"), F.col("line"))).alias("near")), "line-firsts")
    dropped(docs.sparkSession, classes)
    return out


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text of every row without its removed lines, and n_lines, n_removed, n_near (of them without an equal earlier line).

    Null texts stay null, texts without a word stay as they are. Rows that
    repeat a key with other texts, and rows with a null key, are documents of
    their own. Rows equal in key and text are one document that is given more than
    once: all get the same result. A count whose name docs already has gets an
    underscore behind it.
    """
    mark = f"__{uuid.uuid4().hex}"
    first = firsts(docs, key, text)
    first = first.select(*[F.col(c).alias(f"{mark}{c}") for c in first.columns])
    same = column(key).eqNullSafe(F.col(f"{mark}doc")) & (F.xxhash64(column(text)) == F.col(f"{mark}h"))
    joined = docs.join(first, same, "left")
    none = F.array().cast("array<int>")
    lines = F.split(column(text), "\n")
    # stay holds lines with a word only, so a row whose count of these is that of stay needs no look at its lines' numbers
    stay, n = F.coalesce(F.col(f"{mark}stay"), none), F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(WORD_CHAR))), F.lit(0))
    joined = joined.withColumn(f"{mark}n", n).withColumn(f"{mark}gone", F.col(f"{mark}n") - F.size(stay))
    kept = F.array_join(F.filter(lines, lambda x, i: F.array_contains(stay, i) | ~x.rlike(WORD_CHAR)), "\n")
    columns = [F.when(F.col(f"{mark}gone") == 0, column(text)).otherwise(kept).alias(text) if c == text else column(c) for c in docs.columns]
    counts = {"n_lines": F.col(f"{mark}n"), "n_removed": F.col(f"{mark}gone"), "n_near": F.coalesce(F.size(f"{mark}near"), F.lit(0))}
    return joined.select(*columns, *[x.cast("long").alias(free_name(name, docs.columns)) for name, x in counts.items()])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without their removed lines and without the rows all of whose lines with a word are removed, with docs' columns."""
    out = deduplicated(docs, key, text)
    *columns, n_lines, n_removed, _ = out.columns
    return out.filter((column(n_lines) == 0) | (column(n_removed) < column(n_lines))).select(*map(column, columns))
