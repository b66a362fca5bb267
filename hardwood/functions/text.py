"""Text columns: names, clocks, parsers."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that are no part of a name.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


@cache
def _folds() -> tuple[str, str]:
    """Lower-case letters that compatibility decomposition turns into one ASCII letter, and that letter; then what it removes."""
    letters, plain, gone = [], [], []
    for code in range(0x80, 0x1F00):
        c = chr(code)
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if ord(x) < 128)
        if len(folded) == 1 and folded.isalnum():
            letters.append(c)
            plain.append(folded.lower())
        elif not folded:
            gone.append(c)
    return "".join(letters + gone), "".join(plain)


def normalize_name(name: Column) -> Column:
    """Lower case without accents, punctuation and suffixes, words joined by one space; letters without an ASCII form go."""
    plain = F.regexp_replace(F.translate(F.lower(name), *_folds()), r"[^\x00-\x7f]", "")
    words = F.split(F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " ")), " +")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*SUFFIXES)), " ")


def clock_minutes(text: Column) -> Column:
    """``MM:SS`` or plain minutes as minutes; null if neither."""
    return F.coalesce(F.try_divide(F.regexp_extract(text, r"^(\d+):(\d+)$", 2).try_cast("double"), F.lit(60.0)) + F.regexp_extract(text, r"^(\d+):", 1).try_cast("double"), text.try_cast("double"))


def flag(text: Column) -> Column:
    """true/1/yes and false/0/no in any case; blanks and others null."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def season_of(day: Column, first_month: int = 10) -> Column:
    """The year in which the season of a day began."""
    return F.year(day) - F.when(F.month(day) >= first_month, 0).otherwise(1)


def json_object_in(text: Column) -> Column:
    """The first JSON object in a text: the text itself, a fenced block, or from the first to the last brace."""
    ok = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(ok(text), ok(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)), ok(F.regexp_extract(text, r"(?s)(\{.*\})", 1)))
