"""Normalization of texts as Catalyst expressions; only compatibility forms need Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions import tables as T
from quillmesh.functions.lazy import arrow


def leet(c: Column) -> Column:
    return F.translate(c, T.LEET_FROM, T.LEET_TO)


def has_leet(c: Column) -> Column:
    """A digit beside a letter."""
    return c.rlike(r"\p{IsAlphabetic}[0-9]|[0-9]\p{IsAlphabetic}")


def collapse(c: Column, keep: int = 1) -> Column:
    """Runs of three or more equal letters, digits or ``!?.`` cut to ``keep``."""
    return F.regexp_replace(c, r"([\p{IsAlphabetic}\p{N}!?.])\1{2,}", "$1" * keep)


def repetition_ratio(c: Column) -> Column:
    n = F.length(c)
    return F.when(n == 0, 0.0).when(n > 0, F.least(F.lit(1.0), (n - F.length(collapse(c))) / n))


def blanks(c: Column) -> Column:
    """Every run of blanks as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, f"[\\s{T.EXTRA_BLANKS}]+", " "), "^ | $", "")


def compact(c: Column) -> Column:
    return F.regexp_replace(c, f"[\\s{T.EXTRA_BLANKS}]+", "")


def confusable(c: Column) -> Column:
    return F.translate(c, T.CONFUSABLE_FROM, T.CONFUSABLE_TO)


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}]", "")


def fold_text(text: str | None) -> str | None:
    """Case-folding: compatibility form, lower case, and the few letters with a fold of their own."""
    if text is None:
        return None
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).lower().replace("ß", "ss").replace("ς", "σ").replace("ſ", "s")


_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")


def strip_marks_text(text: str | None) -> str | None:
    """Decomposed, without generic combining marks."""
    if text is None or text.isascii():
        return text
    return _MARKS.sub("", unicodedata.normalize("NFD", text))


@arrow("string")
def fold(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


@arrow("string")
def strip_marks(s: pd.Series) -> pd.Series:
    return s.map(strip_marks_text, na_action="ignore")


@arrow("string")
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@arrow("string")
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def skeleton(c: Column) -> Column:
    """What a text looks like: folded first, then look-alikes mapped."""
    return confusable(fold(c))


def normalized(c: Column) -> Column:
    """The matching view: compatibility form, folded, leet read as letters, repetition cut, blanks evened."""
    return blanks(collapse(leet(fold(c))))


def views(c: Column) -> Column:
    """All views by name."""
    folded = fold(c)
    return F.create_map(
        F.lit("casefold"), folded, F.lit("leet"), leet(folded), F.lit("nfc"), nfc(c), F.lit("nfkc"), nfkc(c), F.lit("normalized"), normalized(c), F.lit("repetition_collapsed"), collapse(leet(folded))
    )


def transformations(c: Column) -> Column:
    """The views that differ from the text, but the last, as (transformation_type, source, replacement)."""
    changed = F.filter(F.map_entries(views(c)), lambda e: (e["value"] != c) & (e["key"] != "normalized"))
    return F.transform(changed, lambda e: F.struct(e["key"].alias("transformation_type"), c.alias("source"), e["value"].alias("replacement")))


def truncate(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def key(c: Column) -> Column:
    """Look-up key: trimmed and folded."""
    return fold(F.trim(c))


def natural_key(text: str | None) -> str | None:
    """A string that sorts numbers by value before letters before all else."""
    if text is None:
        return None
    out = []
    for part in re.findall(r"\d+|[^\W\d_]+|.", fold_text(text), re.DOTALL):
        if part.isdigit():
            digits = part.lstrip("0") or "0"
            out.append(f"0{len(digits):06d}{digits}")
        else:
            out.append(("1" if part[0].isalpha() else "2") + part)
    return "\x00".join(out)


@arrow("string")
def natural(s: pd.Series) -> pd.Series:
    return s.map(natural_key, na_action="ignore")
