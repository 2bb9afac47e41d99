"""Text, number and date expressions as Columns; Python only where Spark has no built-in (NFKC, casefold)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of letters and digits.
TOKEN = r"[\p{L}\p{N}]+"
SPACES = "[  -  \\s]+"
#: Scale words in order of priority, and phrases of months in order.
SCALES = (("billion", 9), ("million", 6), ("thousand", 3))
DURATIONS = (("twelve months", 12), ("year ended", 12), ("fiscal year", 12), ("nine months", 9), ("six months", 6), ("three months", 3), ("quarter", 3), ("one month", 1), ("month ended", 1))
#: Characters that count as a hyphen or an apostrophe.
DASHES = dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2212", "-") | dict.fromkeys("\u2018\u2019", "'")
#: Fixed values, the token grammar: a number grouped by commas, or letters and digits with single - / ' between them; then a fraction and a percent sign.
GROUPED = r"(?<!\w)[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?%?(?!\w)"
COMPOUND = r"[^\W_]+(?:[-/'][^\W_]+)*(?:\.[0-9]+)?%?"
LEXICAL = re.compile(f"{GROUPED}|{COMPOUND}".replace("[0-9]", r"\d"))
#: The same for texts of LIKE_LATIN alone, inside Spark.
_WORD = r"[\p{L}\p{N}]"
LATIN_LEXICAL = f"{GROUPED}|{COMPOUND}".replace(r"(?<!\w)", r"(?<![\p{L}\p{N}_])").replace(r"(?!\w)", r"(?![\p{L}\p{N}_])").replace(r"[^\W_]", _WORD)
#: Characters that NFKC leaves alone and that fold by lower-casing: ASCII, most of the Latin letters up to U+017E, and the dashes and apostrophes above.
LIKE_LATIN = "[\\x00-\\x7F\u00C0-\u00DE\u00E0-\u012F\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E" + "".join(DASHES) + "]*"
DAYS_A_MONTH = 365.2425 / 12


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space of any kind collapsed to one space and trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")).cast("long")


def lexical_tokens(text: str) -> list[str]:
    """NFKC, one kind of hyphen and apostrophe, casefold; tokens by the grammar, without the commas of grouped numbers."""
    text = unicodedata.normalize("NFKC", text or "").translate({ord(k): v for k, v in DASHES.items()}).casefold()
    return [t.replace(",", "") for t in LEXICAL.findall(text)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _lexical(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else lexical_tokens(t))


def lexical(text: Column) -> Column:
    """lexical_tokens as a Column: inside Spark where no character needs NFKC or casefold, by Python for the other texts alone. Null has no tokens."""
    text = F.coalesce(text, F.lit(""))
    plain = F.regexp_like(text, F.lit(f"^{LIKE_LATIN}$"))
    low = F.translate(F.lower(text), "".join(DASHES), "".join(DASHES.values()))
    own = F.transform(F.regexp_extract_all(low, F.lit(LATIN_LEXICAL), F.lit(0)), lambda t: F.replace(t, F.lit(","), F.lit("")))
    return F.coalesce(_lexical(F.when(~plain, text)), own)


@F.pandas_udf(T.StringType())
def folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, white space collapsed, casefold."""
    for s in texts:
        yield s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


#: A number's text once currency, per cent, grouping commas and white space are gone: digits with at most one sign, or in a cell behind a bracket, which may be closed.
DIGITS = r"[0-9]+(?:\.[0-9]+)?"
SIGNED, CELL = rf"[-+]?{DIGITS}", rf"\({DIGITS}\)?|[-+]?{DIGITS}"
#: The units of a change.
CHANGE = r"(?i)(ppt|pts?|pp|bps?)\s*$"


def parsed_number(raw: Column) -> Column:
    """struct(value double, is_percent, is_negative, has_comma, change_unit) of a numeric cell's text; value is null if it isn't a number."""
    s = F.trim(raw)
    unit, body = F.lower(F.regexp_extract(s, CHANGE, 1)), F.regexp_replace(s, CHANGE, "")
    bare = F.regexp_replace(body, r"[$,%\s]", "")
    negative = F.substring(bare, 1, 1).isin("(", "-")
    digits = F.regexp_replace(bare, "[-+()]", "").cast("double")
    value = F.when(F.regexp_like(bare, F.lit(f"^(?:{CELL})$")), F.when(negative, -digits).otherwise(digits))
    return F.struct(value.alias("value"), body.contains("%").alias("is_percent"), negative.alias("is_negative"), s.contains(",").alias("has_comma"), F.nullif(unit, F.lit("")).alias("change_unit"))


def unit_scale(text: Column) -> Column:
    """Power of ten of the first scale word by priority."""
    low, out = F.lower(text), F.lit(None).cast("int")
    for word, power in reversed(SCALES):
        out = F.when(low.contains(word), F.lit(power)).otherwise(out)
    return out


def phrase_months(text: Column) -> Column:
    low, out = F.lower(text), F.lit(None).cast("int")
    for phrase, months in reversed(DURATIONS):
        out = F.when(low.contains(phrase), F.lit(months)).otherwise(out)
    return out


def duration_months(start: Column, end: Column) -> Column:
    """Whole months of an inclusive range, at least one, half to even; null if it ends before it starts."""
    days = F.datediff(end, start)
    return F.when(days >= 0, F.greatest(F.lit(1), F.bround((days + 1) / F.lit(DAYS_A_MONTH)).cast("int")))


def local_name(concept: Column) -> Column:
    return F.element_at(F.split(concept, ":"), -1)


def compact(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def name_tokens(name: Column) -> Column:
    """Camel-case words of a name, lower-cased."""
    spaced = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.array_distinct(F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]+"), F.lit(0)))
