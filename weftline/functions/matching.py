"""Users' patterns: whether they can be read, where they match within a time limit, and what every match must hold.

Patterns are checked and matched in Arrow batches, as the JVM's matcher can neither report a bad one as a value nor be
stopped. ``(?flags)`` comes first, as in the terms of routed queries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Seconds that one pattern may take on one text.
TIME_LIMIT = 1.0
#: Places that stand for no match and for one that was given up.
NOWHERE, GIVEN_UP = -1, -2
GRAM = 3
FLAGS = re.compile(r"\A\(\?[imsu]+\)")
#: What dialects read differently: special groups, sets of sets, braces that don't count, other escapes.
EXOTIC = re.compile(r"\(\?(?!:)|\[[^\]]*(?:\[|&&|--|~~|\|\|)|\[\^?\]|\{(?!\d+(?:,\d*)?\})|\\[^dwsbDWSBnrt.*+?^$|()\[\]{}/\\\-_ ]")


@lru_cache(maxsize=1024)
def compiled(term: str) -> regex.Pattern:
    """The pattern; without other letters in it, classes and cases are those of ASCII."""
    return regex.compile(term, regex.ASCII if term.isascii() else 0)


def fault_of(term: str) -> str | None:
    """Why the pattern can't be read."""
    try:
        compiled(term)
    except (regex.error, ValueError, OverflowError, RecursionError) as e:
        return f"bad regex: {e}"
    return None


def place_in(term: str, text: str, limit: float = TIME_LIMIT) -> int:
    """Where (from 0) the pattern first matches."""
    try:
        found = compiled(term).search(text, timeout=limit)
    except TimeoutError:
        return GIVEN_UP
    return found.start() if found else NOWHERE


def literals(term: str) -> list[str]:
    """Runs of characters that every match holds, in order. A pattern of another dialect than the standard library's has none that are known."""
    try:
        parsed = re._parser.parse(term)
    except (re.error, OverflowError, RecursionError, ValueError):
        return []
    runs = [""]

    def walk(nodes: object) -> None:
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(arg)
            elif name == "SUBPATTERN" and not arg[1] and not arg[2]:
                walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                runs.append("")
                walk(arg[2])
                runs.append("")
            elif name != "AT":
                runs.append("")

    walk(parsed)
    return [x for x in runs if x]


def grams(term: str) -> list[str]:
    """Lower-cased trigrams of ASCII that the lower-cased text of every match holds; none if letters of other scripts may match as well."""
    if not term.isascii() or EXOTIC.search(FLAGS.sub("", term)):
        return []
    runs = [x.lower() for x in literals(term)]
    return sorted({x[i : i + GRAM] for x in runs for i in range(len(x) - GRAM + 1)})


@F.pandas_udf(StringType())
def pattern_fault(terms: pd.Series) -> pd.Series:
    """Why a pattern can't be read; null if it can, or if there is none."""
    return terms.map(lambda t: None if t is None else fault_of(t))


@F.pandas_udf(IntegerType())
def match_place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Where a text's first match of a pattern begins, in characters: ``NOWHERE`` or ``GIVEN_UP`` if there is none."""
    for texts, terms in batches:
        yield pd.Series([NOWHERE if x is None or t is None else place_in(t, x) for x, t in zip(texts, terms, strict=True)], dtype="int32")


@F.pandas_udf(ArrayType(StringType()))
def pattern_grams(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: [] if t is None or fault_of(t) else grams(t))
