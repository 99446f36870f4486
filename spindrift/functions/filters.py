"""The line filter's grammar, compiled to one predicate column.

Terms are ANDed: words and quoted phrases (case-insensitive substrings), ``/regex/``, ``key=value`` on the top-level
keys of a JSON line, and ``!`` before a word or a pair. What cannot be read (half a pattern, empty quotes) drops out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.regex import Unsupported, translate

# Fixed value: how a query falls into tokens.
TOKEN = re.compile(r'"([^"]*)"|/((?:\\/|[^/])+)/|([^\t\n\f\r ]+)')
KEY = re.compile(r"[A-Za-z_.][A-Za-z0-9_.]*\Z")


@dataclass(frozen=True)
class Term:
    kind: str  # word, phrase, regex, pair
    value: str
    key: str = ""
    negated: bool = False


def parse(query: str) -> list[Term]:
    out = []
    for m in TOKEN.finditer(query):
        quoted, pattern, bare = m.groups()
        if quoted is not None:
            out += [Term("phrase", quoted.lower())] if quoted else []
        elif pattern is not None:
            try:
                out.append(Term("regex", translate(pattern.replace("\\/", "/"))))
            except Unsupported:
                continue
        else:
            negated, word = bare.startswith("!"), bare.removeprefix("!")
            key, eq, value = word.partition("=")
            if not word or word.startswith("/"):
                continue
            if eq and KEY.match(key):
                out.append(Term("pair", value.lower(), key, negated))
            else:
                out.append(Term("word", word.lower(), "", negated))
    return out


def literals(query: str) -> list[str]:
    """Lower-cased words and phrases that every matching line has."""
    return [t.value for t in parse(query) if t.kind in ("word", "phrase") and not t.negated]


# Values whose text in the line may differ from what a JSON reader makes of them: fractions, exponents, minus zero, objects, lists.
REWRITTEN = re.compile(r"-0|-?[0-9]+(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?|[\[{].*", re.S)
INTEGER = re.compile(r"-?[1-9][0-9]*|0")
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _pair(msg: Column, key: str, value: str) -> Column:
    """Top-level JSON value as text; the JSON null is the empty text, a missing key is no match, of equal keys the last counts.

    The line is read as the first of two members, so that bytes after its object, or a second object, spoil the other.
    """
    read = F.from_json(F.concat(F.lit('{"v":'), msg, F.lit(',"end":7}')), "v map<string,string>, end int", STRICT)
    named = F.filter(F.map_entries(read["v"]), lambda e: e["key"] == key)
    said = F.when(F.size(named) > 0, F.coalesce(F.try_element_at(named, F.lit(-1))["value"], F.lit("")))
    return F.coalesce(msg.startswith("{") & (read["end"] == 7) & (F.lower(said) == value), F.lit(False))


def _pair_exact(msg: Column, key: str, value: str) -> Column:
    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        return pd.Series([exact_pair(t, key, value) for t in texts], dtype="bool")

    return check(msg)


def exact_pair(msg: str | None, key: str, value: str) -> bool:
    """``key=value`` on the raw text of the value: numbers as written, nothing after the object."""
    raw = raw_fields(msg or "")
    return raw is not None and key in raw and raw[key].lower() == value


def raw_fields(msg: str) -> dict[str, str] | None:
    """Top-level key -> text of strings, '' for null, raw text of the rest; None if it is no JSON object."""
    import json

    if not msg.startswith("{"):
        return None
    try:
        json.loads(msg, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None
    decoder, space = json.JSONDecoder(), re.compile(r"[ \t\r\n]*")
    at, out = space.match(msg, 1).end(), {}
    while msg[at] == '"':
        key, at = json.decoder.scanstring(msg, at + 1, True)
        at = space.match(msg, space.match(msg, at).end() + 1).end()
        value, end = decoder.raw_decode(msg, at)
        out[key] = value if isinstance(value, str) else "" if value is None else msg[at:end]
        at = space.match(msg, end).end()
        if msg[at] == "}":
            break
        at = space.match(msg, at + 1).end()
    return out


def _reject(name: str):
    raise ValueError(name)


def _as_written(value: str) -> bool:
    """Must the raw text decide? Only for values that a JSON reader would write anew."""
    return bool(REWRITTEN.fullmatch(value)) and not INTEGER.fullmatch(value)


def _predicates(msg: Column, query: str, exact: bool) -> Iterator[Column]:
    text, low = F.coalesce(msg, F.lit("")), F.lower(F.coalesce(msg, F.lit("")))
    terms = parse(query)
    for t in sorted(terms, key=lambda t: ("word", "phrase", "regex", "pair").index(t.kind)):  # cheap ones first
        if t.kind == "pair":
            ok = text.startswith("{") & _pair_exact(text, t.key, t.value) if exact or _as_written(t.value) else _pair(text, t.key, t.value)
        elif t.kind == "regex":
            ok = text.rlike(t.value)
        else:
            ok = F.contains(low, F.lit(t.value))
        yield ~ok if t.negated else ok


def matches(msg: Column | str, query: str, exact: bool = False) -> Column:
    """Does the line pass the query? Pairs compare the raw text of a JSON value; a query whose value is a fraction, an exponent, an object
    or a list reads it in an Arrow-batched function, and ``exact`` does so for every pair."""
    col = F.col(msg) if isinstance(msg, str) else msg
    return reduce(lambda a, b: a & b, _predicates(col, query, exact), F.lit(True))
