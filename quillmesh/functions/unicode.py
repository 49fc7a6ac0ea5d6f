"""Features of characters and scripts as Catalyst expressions; what needs many of them at once is in :mod:`points`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions import points
from quillmesh.functions import tables as T


def count_of(c: Column, body: str) -> Column:
    """How many characters of a class a text holds."""
    return F.regexp_count(c, F.lit(f"[{body}]"))


def letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{IsAlphabetic}"))


def digits(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{N}"))


def uppercase(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{Lu}"))


def scripts(c: Column) -> Column:
    """Names of the scripts of a text in order."""
    return F.array_compact(F.array(*(F.when(c.rlike(rf"\p{{Is{s}}}"), F.lit(s)) for s in T.SCRIPTS)))


def mixed_scripts(c: Column) -> Column:
    return F.size(scripts(c)) > 1


def confusables(c: Column) -> Column:
    """Characters outside Latin that look like a Latin letter or digit."""
    body = "".join(ch for ch in T.CONFUSABLE_FROM if not ("０" <= ch <= "ｚ") and ch != "Ⅰ")
    return count_of(c, body)


def emoji(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"))


def malformed(c: Column) -> Column:
    """User-seen characters that begin with a combining mark, end in a joiner, or hold two selectors."""
    shown = F.regexp_extract_all(c, F.lit(r"(?s)(\X)"), 1)
    found = F.size(F.filter(shown, lambda g: g.rlike(f"^[{T.COMBINING}]|‍$|[{T.SELECTORS}].*[{T.SELECTORS}]")))
    return F.when(c.rlike(f"[{T.COMBINING}{T.SELECTORS}{T.JOINERS}]"), found).when(c.isNotNull(), 0)


def suspicious_score(c: Column) -> Column:
    """How much a text's characters look like a disguise, from 0 to about 2."""
    capped = lambda n, each, most: F.least(n * F.lit(each), F.lit(most))
    return (
        F.when(mixed_scripts(c), 0.4).otherwise(0.0)
        + capped(confusables(c), 0.15, 0.5)
        + capped(count_of(c, T.INVISIBLE), 0.1, 0.3)
        + capped(count_of(c, T.EXTRA_BLANKS), 0.05, 0.2)
        + capped(count_of(c, T.BIDI), 0.25, 0.5)
        + F.when(c.rlike(f"[{T.COMBINING}]"), 0.05).otherwise(0.0)
        + capped(count_of(c, T.SELECTORS), 0.02, 0.1)
        + capped(count_of(c, T.JOINERS), 0.02, 0.1)
        + capped(count_of(c, T.FULL_WIDTH), 0.10, 0.3)
        + capped(malformed(c), 0.20, 0.5)
    )


def flooded(c: Column) -> Column:
    return c.rlike("[!?.]{3,}")


def uppercase_ratio(c: Column) -> Column:
    n = letters(c)
    return F.when(n == 0, 0.0).when(n > 0, uppercase(c) / n)


def obfuscation(c: Column) -> Column:
    """The scores and flags of disguise as one struct."""
    return points.obfuscation(c)


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text."""
    return points.entropy(c)


def char_features(c: Column) -> Column:
    """Counts of character classes."""
    n, a, d = F.length(c), letters(c), digits(c)
    w = F.regexp_count(c, F.lit(r"\s"))
    p = F.regexp_count(c, F.lit(r"[!-/:-@\[-`{-~]"))
    return F.struct(n.alias("length"), a.alias("letters"), d.alias("digits"), w.alias("whitespace"), p.alias("punctuation"), (n - a - d - w - p).alias("other"))
