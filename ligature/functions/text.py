"""Text normalisation as column expressions.

Steps on lower-cased raw text come first, then symbols give way to blanks, then steps on whole words; the
order is fixed whatever order a caller names them in. All steps but two stay in the JVM; accents and Indic
scripts need Unicode tables that Spark lacks and go through Arrow.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from ligature.functions.indic import transliterate as _transliterate

INDIC = "[\\u0900-\\u0d7f]"
# Trade-name markers, legal forms, abbreviations and placeholders that results depend on.
TRADE_NAME = r"^.+?\s(?:d\.?b\.?a\.?|a\.?k\.?a\.?|née|formerly known as|formerly|t/a|trading as):?\s+"
LEGAL_CANONICAL = {"pvt": "private", "ltd": "limited", "inc": "incorporated", "corp": "corporation", "co": "company"}
LEGAL_PHRASES = {"l l c": "llc", "l l p": "llp", "p c": "pc"}
LEGAL_WORDS = (
    "private", "pvt", "limited", "ltd", "public", "llc", "llp", "pllc", "inc", "incorporated", "corp", "corporation",
    "co", "company", "pc", "lp", "sarl", "sas", "sasu", "eurl", "sa", "sci", "snc", "ei",
)
ADDRESS_WORDS = {
    "st": "street", "rd": "road", "dr": "drive", "ave": "avenue", "av": "avenue", "ln": "lane", "blvd": "boulevard", "bd": "boulevard",
    "ct": "court", "cir": "circle", "pl": "place", "pkwy": "parkway", "hwy": "highway", "apt": "apartment", "r": "rue",
}
PLACEHOLDERS = {"null": ""}
NOT_TEXT = r"[^\p{L}\p{N}\p{M}\s]"


def clean(text: Column) -> Column:
    """Symbols to blanks, white space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, NOT_TEXT, " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Words between blanks; empty text has none."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def replace_words(text: Column, words: dict[str, str]) -> Column:
    """Whole words by their replacement, "" deletes. Runs of equal words are replaced whatever their length."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.array_join(F.filter(F.transform(tokens(text), lambda w: F.coalesce(table[w], w)), lambda w: w != ""), " ")


def replace_phrases(text: Column, phrases: dict[str, str]) -> Column:
    """Sequences of words by one word."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    for old, new in phrases.items():
        for _ in range(2):  # neighbours share a blank
            padded = F.replace(padded, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(padded)


@F.pandas_udf(StringType())
def _accents(texts: pd.Series) -> pd.Series:
    def strip(t: str) -> str:
        return t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ")

    return texts.map(strip, na_action="ignore")


@F.pandas_udf(StringType())
def _romanised(texts: pd.Series) -> pd.Series:
    return texts.map(_transliterate, na_action="ignore")


def strip_accents(text: Column) -> Column:
    """Decomposed text without the marks U+0300 to U+036F; signs of other scripts stay."""
    plain = text.rlike(r"^\p{ASCII}*$")
    return F.when(plain, text).otherwise(_accents(F.when(~plain, text)))


def transliterate(text: Column) -> Column:
    """Text with an Indic letter in Latin letters, other text as it is."""
    indic = text.rlike(INDIC)
    return F.when(indic, _romanised(F.when(indic, text))).otherwise(text)


def keep_real_name(text: Column) -> Column:
    """The name behind "formerly", "dba" and the like, if something stands before the marker."""
    return F.regexp_replace(text, TRADE_NAME, "")


def remove_invisible(text: Column) -> Column:
    return F.regexp_replace(text, "[\\u200b-\\u200d\\ufeff\\u00ad]", "")


def ampersand_to_and(text: Column) -> Column:
    return F.replace(text, F.lit("&"), F.lit(" and "))


def drop_web(text: Column) -> Column:
    """Without "www." and top-level domains; word edges are ASCII ones."""
    text = F.regexp_replace(text, r"(?<![0-9A-Za-z_])www\.", "")
    return F.regexp_replace(text, r"\.(?:com|net|org|co\.in|in|co|fr)(?![0-9A-Za-z_])", " ")


def join_dotted(text: Column) -> Column:
    return F.replace(text, F.lit("."), F.lit(""))


def canonical_legal(text: Column) -> Column:
    return replace_phrases(replace_words(text, LEGAL_CANONICAL), LEGAL_PHRASES)


def remove_legal(text: Column) -> Column:
    return replace_words(text, dict.fromkeys(LEGAL_WORDS, ""))


def expand_address(text: Column) -> Column:
    return replace_words(text, ADDRESS_WORDS)


def drop_placeholders(text: Column) -> Column:
    return replace_words(text, PLACEHOLDERS)


def strip_leading_zeros(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![0-9A-Za-z_])0+([0-9])", "$1")


RAW: dict[str, Callable[[Column], Column]] = {
    "translit": transliterate, "trade_name": keep_real_name, "invisible": remove_invisible, "accents": strip_accents,
    "ampersand": ampersand_to_and, "web": drop_web, "dots": join_dotted,
}
WORD: dict[str, Callable[[Column], Column]] = {
    "legal_canonical": canonical_legal, "legal_remove": remove_legal, "address_abbrev": expand_address,
    "null": drop_placeholders, "zeros": strip_leading_zeros,
}
NAME_STEPS = ("trade_name", "invisible", "accents", "web")
ADDRESS_STEPS = ("invisible", "accents", "address_abbrev", "null", "zeros")


def normalize(text: Column, steps: Sequence[str] = ()) -> Column:
    """Normalised text; null stays null."""
    unknown = set(steps) - set(RAW) - set(WORD)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    out = F.lower(text)
    for name, step in RAW.items():
        if name in steps:
            out = step(out)
    out = clean(out)
    for name, step in WORD.items():
        if name in steps:
            out = step(out)
    return out


def normalization_tag(name_steps: Sequence[str], address_steps: Sequence[str]) -> str:
    """Short name of a set of steps, for tables that are kept."""
    return hashlib.md5(f"{'+'.join(name_steps)}|{'+'.join(address_steps)}".encode()).hexdigest()[:8]
