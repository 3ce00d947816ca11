"""Text expressions with the evidence engine's own white-space and folding rules."""

from __future__ import annotations

import functools
import operator
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as str.strip() sees it, as a regex class.
WS = "\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: The same as a string of its characters.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(c: Column) -> Column:
    """c without Unicode white space at either end."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, f"[{WS}]+", " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def alnum_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[\\p{L}\\p{N}]"))


def drop_code_fence(c: Column) -> Column:
    """The lines between a leading and a closing ``` line; other text only stripped. Lines end as str.splitlines() sees it."""
    t = strip(c)
    lines = F.split(t, "\r\n|[\n\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    fenced = t.startswith("```") & (strip(F.element_at(lines, -1)) == "```")
    return F.when(fenced, strip(inner)).otherwise(t)


@F.pandas_udf(StringType())
def normalized(s: pd.Series) -> pd.Series:
    """NFKC, white space collapsed; Spark has no NFKC of its own."""
    return s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()), na_action="ignore")


@F.pandas_udf(StringType())
def fold_key(s: pd.Series) -> pd.Series:
    """Key for equal texts: normalised and case-folded."""
    return s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()).casefold(), na_action="ignore")


#: Characters beyond ASCII whose case folding holds ASCII letters, and what they fold to: by rule, over all code points.
FOLDS = {c: c.casefold() for c in map(chr, range(128, 0x110000)) if any(x < "\x80" for x in c.casefold())}


#: What of it is left in lower-cased text.
REST = {c: f for c, f in FOLDS.items() if c.lower() == c}


def contains_any(lowered: Column, phrases: Iterable[str]) -> Column:
    """Whether any of the phrases (ASCII, lower case) stands in a case-folded text, of which lowered is F.lower; without Python.

    A phrase that holds another one isn't looked for; the rest are plain searches
    for bytes. Only texts in which nothing is found and that have a character which
    folds to something with ASCII in it, and isn't lower-cased to it, are searched once more with those
    characters written out; all other characters fold to none. Let lowered be a column
    already: it is read once a phrase.
    """
    least = [p for p in dict.fromkeys(phrases) if not any(q != p and q in p for q in phrases)]
    found = lambda c: functools.reduce(operator.or_, [F.contains(c, F.lit(p)) for p in least], F.lit(False))
    wide = lowered
    for x, f in REST.items():
        wide = F.replace(wide, F.lit(x), F.lit(f))
    odd = (F.octet_length(lowered) > F.char_length(lowered)) & lowered.rlike(f"[{''.join(REST)}]")
    # one regular expression, as what is written out is no column
    again = wide.rlike("|".join(map(re.escape, least)))
    return found(lowered) | (odd & again)
