"""Entities in texts: network names, amounts, dates, times, numbers and capitalised names.

Kinds claim their places in order, so an address inside a link is no second finding. Patterns do the scanning; a column
form for each single kind stays in the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions import tables as T
from quillmesh.functions.lazy import arrow

# Signs and codes of currencies.
CURRENCY_SIGNS = dict(zip("$€£₹₽₩¥¢₴₺₪₫₱฿", "USD EUR GBP INR RUB KRW JPY CENT UAH TRY ILS VND PHP THB".split(), strict=True))
CURRENCY_CODES = "USD EUR GBP JPY CNY INR RUB KRW CHF CAD AUD BRL MXN ARS CLP COP PEN SEK NOK DKK PLN CZK HUF RON TRY ZAR NGN KES GHS PHP IDR MYR THB VND TWD HKD SGD NZD ILS AED SAR QAR".split()
# Patterns and confidence of each kind, in the order in which they claim.
URL = r"(?i)(?:https?://|www\.)[^\s<>\"'`«»]*[^\s<>\"'`«».,;:!?)\]}]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9._%+-]*[A-Za-z0-9]\.[A-Za-z]{2,}"
MENTION = r"(?<![\w@.])@\w{1,30}"
DATE_ISO = r"[12][0-9]{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
DATE_SLASH = r"(?<![0-9/])(?:0?[1-9]|[12][0-9]|3[01])/(?:0?[1-9]|[12][0-9]|3[01])/[0-9]{2,4}"
TIME = r"(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?"
NUMBER = r"(?<![\w])[0-9]+(?:[.,][0-9]+)*(?![\w])"
AMOUNT = rf"[{''.join(CURRENCY_SIGNS)}] *[0-9]+(?:[.,][0-9]+)*"
AMOUNT_CODE = rf"(?<![A-Za-z0-9])[0-9]+ (?:{'|'.join(CURRENCY_CODES)})(?![A-Za-z0-9])"
_ORDER = [("url", URL, 0.95), ("email", EMAIL, 0.95), ("mention", MENTION, 0.7), ("currency", AMOUNT, 0.85), ("currency", AMOUNT_CODE, 0.8), ("date", DATE_ISO, 0.8), ("time", TIME, 0.7), ("date", DATE_SLASH, 0.6), ("number", NUMBER, 0.75)]
_NAME = re.compile(r"(?<![\w@#])[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?: [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+){1,2}(?!\w)")
_ACRONYM = re.compile(r"(?<!\w)[A-Z]{2,6}(?!\w)")
_FIRM = re.compile(r" (?:Inc|Ltd|LLC|GmbH|AG|SA|SL|BV|SARL|Corp|Co)\b")
_compiled = [(kind, re.compile(p), conf) for kind, p, conf in _ORDER]


def entities_text(text: str | None, most: int = T.ENTITIES, longest: int = T.ENTITY_CHARS) -> list[dict]:
    """At most ``most`` entities by place; start and end in UTF-8 bytes."""
    if not text:
        return []
    taken: list[tuple[int, int]] = []
    out = []

    def claim(kind: str, a: int, b: int, conf: float, value: str) -> None:
        if b - a <= longest and all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((a, b, kind, value, conf))

    for kind, pattern, conf in _compiled:
        for m in pattern.finditer(text):
            value = m.group()
            if kind == "currency":
                code = CURRENCY_SIGNS.get(value[0]) or value[-3:]
                value = f"{code} {re.sub(r'[^0-9.,]', '', value)}"
            claim(kind, m.start(), m.end(), conf, value.lower() if kind in ("url", "email", "mention") else value)
    for m in _NAME.finditer(text):
        firm = _FIRM.match(text, m.end())
        claim("organization" if firm else "person", m.start(), firm.end() if firm else m.end(), 0.7 if firm else 0.45, m.group())
    for m in _ACRONYM.finditer(text):
        claim("organization", m.start(), m.end(), 0.5, m.group())
    out.sort()
    offset = (lambda i: i) if text.isascii() else (lambda i: len(text[:i].encode()))
    return [{"entity_type": k, "value": v, "start": offset(a), "end": offset(b), "confidence": c} for a, b, k, v, c in out[:most]]


@arrow("array<struct<entity_type:string,value:string,start:int,end:int,confidence:double>>")
def entities(s: pd.Series) -> pd.Series:
    return s.map(entities_text)


def entities_within(c: Column, most: int, longest: int) -> Column:
    """:func:`entities` under other limits."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: entities_text(t, most, longest))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return arrow("array<struct<entity_type:string,value:string,start:int,end:int,confidence:double>>")(run)(c)


def found(c: Column, pattern: str) -> Column:
    """All findings of one kind in the JVM."""
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)


def agreement(a: Column, b: Column) -> Column:
    """Of two arrays of entities, the share that both hold, by kind and value."""
    ka, kb = (F.array_distinct(F.transform(x, lambda e: F.concat_ws(":", e["entity_type"], e["value"]))) for x in (a, b))
    most = F.greatest(F.size(ka), F.size(kb))
    return F.when(most == 0, 0.0).otherwise(F.size(F.array_intersect(ka, kb)) / most)


def conflict(a: Column, b: Column) -> Column:
    """Of the kinds that both hold, the share without a common value."""
    kinds = lambda x: F.array_distinct(F.transform(x, lambda e: e["entity_type"]))
    shared = F.array_intersect(kinds(a), kinds(b))
    values = lambda x, k: F.transform(F.filter(x, lambda e: e["entity_type"] == k), lambda e: e["value"])
    apart = F.filter(shared, lambda k: ~F.arrays_overlap(values(a, k), values(b, k)))
    return F.when(F.size(shared) == 0, 0.0).otherwise(F.size(apart) / F.size(shared))
