"""Text: names, relations, titles, tokens and model output."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as K

SPACE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACE))


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def clean_relation(c: Column) -> Column:
    """Upper-case identifier: other characters become single underscores; RELATES_TO where nothing is left, REL_ before a non-letter."""
    x = F.upper(F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_]", "_"), "_+", "_"), F.lit("_")))
    return F.when(x == "", "RELATES_TO").when(~x.rlike("^[A-Z]"), F.concat(F.lit("REL_"), x)).otherwise(x)


def clean_entity_text(c: Column) -> Column:
    """Trimmed; a one-entry dict's repr gives its value."""
    t = strip(F.coalesce(c, F.lit("")))
    inner = F.regexp_extract(t, K.ENTITY_REPR, 1)
    return F.when(inner != "", strip(inner)).otherwise(t)


def normalize_name(c: Column) -> Column:
    """Lower-case ASCII letters and digits, others become single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def is_narrative(c: Column) -> Column:
    """False for one or two tokens of which the first is a bare hash, address or file name."""
    t = strip(F.coalesce(c, F.lit("")))
    parts = F.split(t, r"\s+")
    first = F.lower(F.get(parts, 0))
    bare = first.rlike(K.BARE_HASH) | first.rlike(K.BARE_ADDRESS) | first.rlike(K.BARE_FILE)
    return ~((F.size(parts) <= 2) & bare)


def token_count(c: Column) -> Column:
    """Whole part of 1.3 tokens a word."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t == "", 0).otherwise((F.size(F.split(t, r"\s+")) * F.lit(1.3)).cast("int"))


def strip_think(c: Column) -> Column:
    """Without thinking blocks, closed or open at the end."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), K.THINK_CLOSED, ""), K.THINK_OPEN, ""))


def mended(text: str) -> str:
    """JSON without the usual mistakes of models; a range of numbers becomes its mean of two digits."""

    def mean(m: re.Match) -> str:
        try:
            return f": {round((float(m[1]) + float(m[2])) / 2, 2)}"
        except ValueError:  # digits and points, but no number
            return m[0]

    out = re.sub(K.JSON_RANGE, mean, text)
    for pattern, by in ((K.JSON_PAIR, r'"\1": \2'), (K.JSON_LINE, r"\1,\n\2"), (K.JSON_SPARE, r"\1")):
        out = re.sub(pattern, by, out)
    return out.strip()


def find_object(answer: str | None) -> dict | None:
    """The object in a model's answer: all of it, a fenced block, or what lies between the outer braces, the last two also mended."""
    text = re.sub(K.THINK_OPEN, "", re.sub(K.THINK_CLOSED, "", answer or "")).strip()
    tries = [text]
    for pattern in (K.JSON_FENCED, K.JSON_OUTER):
        if held := re.search(pattern, text):
            tries += [held[1], mended(held[1])]
    for one in tries:
        try:
            found = json.loads(one)
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict):
            return found
    return None


@F.pandas_udf(T.StringType())
def _object_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if (found := find_object(x)) is None else json.dumps(found), na_action="ignore")


def extract_json(c: Column, schema: str) -> Column:
    """What ``find_object`` finds, or null. Python sees only answers that are no JSON as they stand."""
    plain = F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*\{")
    found = _object_text(F.when(~F.coalesce(plain, F.lit(False)), c))
    return F.from_json(F.when(plain, c).otherwise(found), schema)


def title_label(c: Column) -> Column:
    """Words of an identifier with capitals."""
    return F.initcap(F.replace(F.lower(c), F.lit("_"), F.lit(" ")))


def snippet(c: Column, n: int = 200) -> Column:
    return F.substring(c, 1, n)
