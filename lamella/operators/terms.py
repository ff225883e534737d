"""Many terms in one pass: lists of terms become one automaton, and each text is read once whatever their number.

Lists come from a JSON file, {"version": ..., "lists": {name: {"terms": [...], "match": "word" or "part"}}}, and a
digest of their content names them. Words stand between characters that aren't letters or digits, in the text as it is
or with runs of separators as blanks; parts stand anywhere in the text. Hits come in the order of their list.

The automaton is built once in each Python worker; texts come to it in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SEPARATORS = re.compile("[-_/]+")
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


class TermList(NamedTuple):
    terms: tuple[str, ...]
    word: bool = True


def words(terms: list[str]) -> TermList:
    return TermList(tuple(terms))


def parts(terms: list[str]) -> TermList:
    return TermList(tuple(terms), False)


def load_lists(spark: SparkSession, path: str) -> dict[str, TermList]:
    """The lists of a rule file, from any store that Spark reads."""
    said = json.loads(spark.read.option("wholetext", True).text(path).first()["value"])
    if not isinstance(said, dict) or not isinstance(said.get("lists"), dict):
        raise ValueError(f"{path} is not an object with lists")
    out = {}
    for name, own in said["lists"].items():
        if own.get("match", "word") not in ("word", "part"):
            raise ValueError(f"list {name} of {path}: match is {own['match']!r}")
        out[name] = TermList(tuple(own["terms"]), own.get("match", "word") == "word")
    return out


def fingerprint(lists: Mapping[str, TermList]) -> str:
    """A digest that changes with any term, order or kind of list."""
    return sha256(json.dumps({k: [v.word, list(v.terms)] for k, v in sorted(lists.items())}).encode()).hexdigest()


@lru_cache(8)
def _automaton(lists: tuple[tuple[str, TermList], ...]) -> ahocorasick.Automaton:
    """Terms with the lists and places where they stand."""
    at: dict[str, list[tuple[int, int]]] = {}
    for k, (_, own) in enumerate(lists):
        for i, term in enumerate(own.terms):
            if term:
                at.setdefault(term, []).append((k, i))
    made = ahocorasick.Automaton()
    for term, places in at.items():
        made.add_word(term, (len(term), places))
    if at:
        made.make_automaton()
    return made


def hits(text: str, lists: tuple[tuple[str, TermList], ...]) -> list[list[str]]:
    """The terms of each list that the text holds, in list order; parts without blanks at their ends."""
    made, seen = _automaton(lists), [set() for _ in lists]
    if len(made):
        other = _SEPARATORS.sub(" ", text)
        for variant in (text,) if other == text else (text, other):
            for end, (length, places) in made.iter(variant):
                start = end - length + 1
                whole = not (start and variant[start - 1] in _INSIDE) and not (end + 1 < len(variant) and variant[end + 1] in _INSIDE)
                for k, i in places:
                    if whole if lists[k][1].word else variant is text:
                        seen[k].add(i)
    return [[own.terms[i] if own.word else own.terms[i].strip() for i in sorted(found)] for (_, own), found in zip(lists, seen, strict=True)]


def found(text: Column, lists: Mapping[str, TermList]) -> Column:
    """A struct with the hits of each list; a null text holds none."""
    own = tuple(lists.items())
    shape = T.StructType([T.StructField(name, T.ArrayType(T.StringType())) for name in lists])

    @F.pandas_udf(shape)
    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([hits(x or "", own) for x in texts], columns=list(lists))

    return told(text)
