"""Problem 3: personal data in free text, found behind its disguises and replaced by typed placeholders.

A text is first rewritten by transducers that keep, for each character they give, where its source begins and ends:
look-alikes and compatibility forms become plain letters, invisible characters go, runs of spelled digits become digits,
and, for email addresses alone, words and brackets that stand for their signs become these. Detectors then work on the
rewritten text: grammars for email addresses, phone numbers and street addresses in eight languages, numbers that are
introduced as those of an identity paper, runs of digits that were spelled out, and names. Spans found are mapped back to
the source, so everything else in it stays as it is, character by character.

Names are words of the lexicon, or words that a character model of it finds more like its names than like the other words
of the corpus, in a place where names stand: before or after another name, in a greeting or signature, after a phrase
that introduces one. The whole lexicon is looked up in, as sorted hashes whose size is checked. The model is fitted on all of
it and on the words of all texts: the cluster counts words where no name stands, twice, as names that the first model finds
are no other words for the second. What reaches the driver are sums for trigrams of characters, whose number is that of the
alphabets in use and is checked, and the common words, of which a text holds at least one in ``COMMON_TEXTS``.

Defined results: null and empty texts hold nothing; overlapping findings are resolved for the earlier, then the longer,
then in the order of the kinds below; titles before names and signs around an item are left out; texts are read whole.
Repeated deliveries count once in :func:`p3_found`.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import fields
from quillmesh.llm.plain import _as_ranges, _letters_elsewhere, _mixed, _segment, _segments, _unmix, hash_words, kept_of, unstable_points
from quillmesh.runtime import cut, map_batches, table

#: Names of a lexicon that are sent as they are; of a larger one hashes are.
LEXICON_ROWS = 100_000
#: The largest lexicon, in rows: 8 bytes each are broadcast. A larger one is refused, not cut.
LARGEST_LEXICON = 20_000_000
#: Different trigrams of characters that a model may have. More are refused, not cut.
MOST_GRAMS = 4_000_000
#: A word is common that stands at least so often, and once in so many texts.
COMMON_TIMES, COMMON_TEXTS = 40, 150
#: Parts of one that the weight of a word is counted in, so that sums do not depend on their order.
PARTS = 4096
#: Words whose scores a worker keeps.
KNOWN_WORDS = 300_000
#: Words that a worker keeps what it found of, and the characters of the longest that is kept.
KNOWN, LONGEST_KNOWN = 100_000, 64
_DIGIT = re.compile(r"\d")
KINDS = ("email", "id_number", "phone", "address", "name")

# ---------------------------------------------------------------------------------------------- offsets


Places = tuple[list[int], list[int]] | None


class Known(dict):
    """What a function gives for a word, kept for those met before; all is forgotten once there are too many."""

    def __init__(self, fn: Callable):
        super().__init__()
        self.fn = fn

    def __missing__(self, word: str):
        found = self.fn(word)
        if len(word) <= LONGEST_KNOWN:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = found
        return found


_PIECE_MIXED = Known(lambda piece: _mixed.search(piece) is not None)


def _mixes_scripts(text: str, chars: set[str]) -> bool:
    """Whether a word of a text of these characters mixes scripts; no word goes over a blank."""
    return not chars.isdisjoint(_letters_elsewhere()) and any(map(_PIECE_MIXED.__getitem__, text.split(" ")))


@functools.cache
def _basic_segments() -> re.Pattern[str]:
    """The segments of texts whose unstable characters are all of the basic plane: a class that is looked up at once."""
    c = _as_ranges(sorted(p for p in map(ord, unstable_points()) if p < 0x10000))
    return re.compile(f"([^{c}]?)([{c}]+)(?=(.?))", re.DOTALL)


def _straight(a: int, b: int) -> tuple[range, range]:
    return range(a, b), range(a + 1, b + 1)


def rewritten(text: str) -> tuple[str, Places]:
    """The text in plain form, and where the source of each of its characters begins and ends; None where nothing moved."""
    if text.isascii():
        return text, None
    chars = set(text)
    unstable = chars & unstable_points()
    if not unstable:
        return _unmix(text) if _mixes_scripts(text, chars) else text, None  # one letter for one letter
    out: list[str] = []
    starts: list[int] = []
    stops: list[int] = []
    at = 0
    for m in (_segments() if max(unstable) > "\uffff" else _basic_segments()).finditer(text):
        if m.start() > at:
            out.append(text[at : m.start()])
            a, b = _straight(at, m.start())
            starts.extend(a)
            stops.extend(b)
        whole, source = _segment(m), m.start()
        pieces = [(source + i, ch) for i, ch in ((0, m.group(1)), *((i + len(m.group(1)), ch) for i, ch in kept_of(m))) if ch]
        for text_, a, b in _clusters(pieces, whole):
            out.append(text_)
            starts.extend([a] * len(text_))
            stops.extend([b] * len(text_))
        at = m.end()
    out.append(text[at:])
    a, b = _straight(at, len(text))
    starts.extend(a)
    stops.extend(b)
    new = "".join(out)
    if _mixes_scripts(new, set(new)):
        new = _unmix(new)
    return new, (starts, stops)


def _clusters(pieces: list[tuple[int, str]], whole: str) -> list[tuple[str, int, int]]:
    """The plain form of characters with their places, in the smallest pieces whose forms are those of the whole."""
    out: list[tuple[str, int, int]] = []
    held, start, stop = "", 0, 0
    for place, ch in pieces:
        form = lambda x: unicodedata.normalize("NFKC", x)
        if held and form(held) + form(ch) == form(held + ch) and not unicodedata.combining(ch):
            out.append((form(held), start, stop))
            held = ""
        if not held:
            start = place
        held, stop = held + ch, place + 1
    if held:
        out.append((unicodedata.normalize("NFKC", held), start, stop))
    if "".join(x for x, _, _ in out) == whole:
        return out
    return [(whole, pieces[0][0], pieces[-1][0] + 1)] if whole and pieces else []


# Spelled digits in the eight languages.
_SPELLED = {
    w: str(d)
    for d, ws in enumerate(
        (
            "zero oh cero zéro null nul ноль",
            "one uno un une ein eins um een één один",
            "two dos deux zwei due dois twee два",
            "three tres trois drei tre três drie три",
            "four cuatro quatre vier quattro quatro четыре",
            "five cinco cinq fünf cinque vijf пять",
            "six seis sechs sei zes шесть",
            "seven siete sept sieben sette sete zeven семь",
            "eight ocho huit acht otto oito восемь",
            "nine nueve neuf neun nove negen девять",
        )
    )
    for w in ws.split()
}
_ONE = rf"(?:{'|'.join(sorted(_SPELLED, key=len, reverse=True))})(?![^\W_])"
_SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:(?:{_ONE}|\d(?!\w))(?:[\s,.-]+|$|(?=[^\w\s]))){{6,}}", re.IGNORECASE)
#: Digits of a phone number that was spelled out.
SPELLED_DIGITS = range(7, 16)


def undigit(text: str, places: Places) -> tuple[str, Places, list[tuple[int, int]]]:
    """Runs of at least six digits of which three or more are spelled, as digits, and where these runs are."""
    if sum(map(_SPELLED.__contains__, text.lower().replace("-", " ").replace(",", " ").split())) < 3:
        return text, places, []
    starts, stops = map(list, _straight(0, len(text))) if places is None else places
    out, a_all, b_all, at, size, runs = [], [], [], 0, 0, []
    for m in _SPELLED_RUN.finditer(text):
        found = list(re.finditer(r"[^\W\d_]+|\d", m.group()))
        if sum(not x.group().isdigit() for x in found) < 3:
            continue
        out.append(text[at : m.start()])
        a_all += starts[at : m.start()]
        b_all += stops[at : m.start()]
        size += m.start() - at
        runs.append((size, size + len(found)))
        for w in found:
            out.append(_SPELLED.get(w.group().lower(), w.group()))
            a_all.append(starts[m.start() + w.start()])
            b_all.append(stops[m.start() + w.end() - 1])
        size += len(found)
        at = m.start() + found[-1].end()  # what follows the last digit stays as it is
    if not runs:
        return text, places, []
    return "".join([*out, text[at:]]), (a_all + starts[at:], b_all + stops[at:]), runs


# What stands for the signs of an email address, in the eight languages.
_AT_WORDS, _DOT_WORDS = r"at|arroba|chiocciola|arobase|собака", r"dot|punto|punkt|point|ponto|punt|точка"
_BRACKETED_AT = rf"[(\[{{<]\s?(?:{_AT_WORDS}|@)\s?[)\]}}>]"
#: A word is no sign where an address with a sign of its own follows ("write to me at ...").
_NO_SIGN_NEAR = rf"(?!\S{{1,64}}?(?:\s(?:{_DOT_WORDS})\s\S{{1,64}}?)?(?:\s?@|\s?{_BRACKETED_AT}|\s(?:{_AT_WORDS})\s))"
_SIGN = re.compile(rf"(?=[\s(\[{{<@])(?:\s?[(\[{{<]\s?(?P<at>{_AT_WORDS}|@)\s?[)\]}}>]\s?|\s?[(\[{{<]\s?(?P<dot>{_DOT_WORDS}|\.)\s?[)\]}}>]\s?|\s(?P<at_>{_AT_WORDS})\s{_NO_SIGN_NEAR}|\s(?P<dot_>{_DOT_WORDS})\s|\s@\s?(?=[^\W_][\w-]*(?:\.|\s?[(\[{{<]\s?(?:{_DOT_WORDS}|\.)|\s(?:{_DOT_WORDS})\s))|(?<=\S)@\s)", re.IGNORECASE)


def unsigned(text: str) -> tuple[str, list[int], list[int]]:
    """The text with what stands for an at sign or a dot as that sign, and where each character begins and ends in it."""
    out, starts, stops, at = [], [], [], 0
    for m in _SIGN.finditer(text):
        out += [text[at : m.start()], "." if m.lastgroup in ("dot", "dot_") else "@"]
        a, b = _straight(at, m.start())
        starts += [*a, m.start()]
        stops += [*b, m.end()]
        at = m.end()
    a, b = _straight(at, len(text))
    return "".join([*out, text[at:]]), [*starts, *a], [*stops, *b]


# ---------------------------------------------------------------------------------------------- grammars

EMAIL = re.compile(r"(?<![\w.+@-])\w(?:[\w+.%-]*[\w+])?@[^\W_][\w-]*(?:\.[^\W_][\w-]*)*\.[^\W\d_]{2,}(?![\w@])", re.IGNORECASE)
EMAIL_HINT = re.compile(r"@|[(\[{<]\s?at\s?[)\]}>]|\barroba\b|\bchiocciola\b|\barobase\b|\bсобака\b|\sat\s.{1,60}\sdot\s", re.IGNORECASE)

_OUT = r"(?<![\w@#$€£+/.:-])(?<![#@v]\s)"
PHONE = re.compile(
    r"(?=[+(\d])"  # how all of them begin
    + _OUT
    + r"(?:"
    + r"\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}"  # with country
    + r"|00\d{2,3}(?:[ -]\d{2,4}){2,4}"
    + r"|\(\d{3}\) ?\d{3}[ .-]\d{4}"
    + r"|\d{3}-\d{3}-\d{4}"
    + r"|\d{3}-\d{4}"  # local
    + r"|0\d(?:[ .]\d\d){4}"  # pairs
    + r"|0\d{2,4}[ /]\d{3,8}(?:[ -]\d{2,4})?"
    + r"|0\d{3,4} \d{3} \d{3,4}"
    + r"|0\d{9,10}"
    + r"|8[ -]?\(?\d{3}\)?[ -]?\d{3}(?:[ -]\d\d){2}"
    + r")(?![\w@])(?![-/.:]\d)(?!(?: \d+)* ?(?:px|pts|EUR|USD|kg)\b)"
)

# Words that introduce the number of an identity paper.
_PAPERS = (
    r"national id|identity (?:card|number|no)|id (?:card|number|no)|passport|social (?:security|insurance)|national insurance|ssn|nino|tax id|"
    r"documento (?:nacional )?de identi\w+|pasaporte|seguridad social|número de identi\w+|cédula|dni|nif|"
    r"num[ée]ro d['’]identité|carte d['’]identité|passeport|sécurité sociale|"
    r"ausweis\w*|reisepass\w*|sozialversicherung\w*|personalausweis\w*|steuer-?id\w*|"
    r"(?:il mio )?documento|carta d['’]identità|passaporto|codice fiscale|previdenzial\w+|numero previdenziale|"
    r"passaporte|previdência|identidade|cpf|segurança social|"
    r"identiteits\w+|paspoort\w*|burger(?:service)?nummer|bsn|"
    r"удостоверени\w+|паспорт\w*|страхов\w+|снилс|инн"
)
IDENTITY = re.compile(rf"(?<![\w])(?:{_PAPERS})(?:[\s,:]+(?!\w*\d)[^\W\d]+\.?|[\s]*[:#№=-]|\s+(?:n|no|nr|núm|num|nº|n°|№)\s?[.:º°]?){{0,5}}\s*[:#№]?\s*(?P<id>(?:[A-ZА-Я]{{1,3}}-?)?\d+(?:[ .\-/]?\d+){{0,9}}(?:[ -]?[A-ZА-Я])?)(?![\w])", re.IGNORECASE)
_PAPER_STEMS = ("national i", "ident", "id card", "id number", "id no", "passport", "social ", "ssn", "nino", "tax id", "documento", "pasaporte", "seguridad social", "cédula", "dni", "nif", "passeport", "sécurité", "ausweis", "reisepass", "sozialv", "steuer", "passaporto", "codice f", "previd", "passaporte", "cpf", "segurança", "paspoort", "burger", "bsn", "удостов", "паспорт", "страхов", "снилс", "инн")
#: Letters that may stand before such a number, apart by a blank.
_SERIES = re.compile(r"(?<!\w)(?!NO|NR|N |IS|EST|WAS|DE)[A-ZА-Я]{1,3} $")

_CAP = r"[^\W\d_][\w'’-]*"
_NUM = r"\d{1,5}(?:\s?/?\s?[A-Za-z](?![\w]))?"
ADDRESS = [
    # English: flat, number, street word, flat, town
    re.compile(rf"(?<![\w#-])(?:(?:flat|apt|apartment|suite|unit)\.?\s\d+\w?,\s)?\d{{1,5}}[A-Za-z]?\s(?:{_CAP}\s){{1,3}}?(?:(?:st|rd|ln|blvd|ave|dr|ct|sq)\b\.?|(?:street|road|lane|row|boulevard|avenue|drive|way|close|court|place|square|terrace|crescent|gardens|hill)\b)(?:,?\s(?:apt|flat|apartment|suite|unit)\.?\s\d+\w?)?(?:,\s(?-i:[A-Z])[\w'-]+)?", re.IGNORECASE),
    # French: number, kind, name
    re.compile(rf"(?<![\w#-])\d{{1,5}}(?:\s(?:bis|ter|quater))?,?\s(?:rue|avenue|av\.|boulevard|bd|allée|impasse|place|quai|chemin|cours|route|square|passage|sentier)(?:\s(?:de\sla|de\sl['’]|du|des|de|d['’]|l['’]))?\s?{_CAP}(?:\s(?!Le\b|La\b|Un\b)[A-ZÀ-Ý][\w'’-]*){{0,2}}", re.IGNORECASE),
    # Spanish, Portuguese, Italian: kind, name, number, flat
    re.compile(
        rf"(?<![\w#-])(?:calle|c/|c\.|avenida|avda?\.?|av\.|paseo|p\.º|plaza|pl(?:za)?\.|camino|ronda|travesía|glorieta|rua|r\.|travessa|tv\.|alameda|largo|praça|estrada|rodovia|via|viale|v\.le|vicolo|piazza|p\.zza|piazzale|corso|largo|lungomare|strada)\s?(?:{_CAP}\s?(?:\.\s)?){{1,5}}?(?<=[\w\s.]),?\s?(?:n\.?\s?[º°]?\.?\s?|núm\.?\s?|nº\s?|número\s)?{_NUM}(?![\d.]*\d)(?:[-/]\w\b)?(?:,?\s(?:ap(?:to|t)?\.?|apartamento|piso|int(?:erno)?\.?|scala|sc\.|bloco|andar|casa)\s?\d+\w?|,\s\d{{1,3}}\s?[º°.]?\s?[A-Za-z]\b)?",
        re.IGNORECASE,
    ),
    # German, Dutch: street in one word or two, number
    re.compile(rf"(?<![\w#-])(?:(?-i:[A-ZÄÖÜ])[\w'-]+er\s|(?-i:Am|An der|Im|Alte|Neue|Oude|Lange|Korte)\s)?{_CAP}(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|straat|laan|plein|gracht|kade|dijk|singel|dreef|hof|steeg|pad)\s\d{{1,4}}(?:-\d{{1,3}}(?![\w])|\s?[a-zA-Z](?![\w]))?(?:\s(?:hs|bis|[IVX]{{1,3}})(?![\w]))?(?:,\s\d{{4,5}}(?:\s[A-Z]{{2}})?\s(?-i:[A-Z])[\w-]+)?", re.IGNORECASE),
    re.compile(rf"(?<![\w#-])(?:(?-i:[A-ZÄÖÜ])[\w'-]+\s)(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring|Ufer|Damm)\s\d{{1,4}}(?:\s?[a-zA-Z](?![\w]))?", re.IGNORECASE),
    # Russian: kind and name either way round, house, flat
    re.compile(r"(?<![\w#-])(?:(?:ул|пр|пер|наб|пл|бул|б-р|пр-т|ш)\.|улица|проспект|переулок|набережная|площадь|бульвар|проезд|шоссе)\s?[А-ЯЁа-яё][\w-]*(?:\s[А-ЯЁ][\w-]*){0,2},?\s(?:д\.|дом)?\s?\d{1,4}[а-яА-Я]?(?![\d.]*\d)(?:,?\s(?:к\.|корп\.|корпус|стр\.)\s?\d+)?(?:,?\s(?:кв\.|квартира|оф\.)\s?\d+)?", re.IGNORECASE),
    re.compile(r"(?<![\w#-])[А-ЯЁа-яё][\w-]*(?:ая|ий|ый|ой|ое|ский)\s(?:(?:ул|пр|пер|наб|пл|бул|б-р|пр-т|ш)\.|улица|проспект|переулок|набережная|площадь|бульвар|проезд|шоссе),?\s(?:д\.|дом)?\s?\d{1,4}[а-яА-Я]?(?:,?\s(?:к\.|корп\.|корпус|стр\.)\s?\d+)?(?:,?\s(?:кв\.|квартира|оф\.)\s?\d+)?", re.IGNORECASE),
]
#: For each pattern, pieces of lower-case text one of which it can't do without.
ADDRESS_HINT = [
    tuple(" " + w for w in "street st road rd lane ln row blvd boulevard avenue ave drive dr way close court ct place square sq terrace crescent gardens hill".split()),
    tuple(w + e for w in "rue avenue av. boulevard bd allée impasse place quai chemin cours route square passage sentier".split() for e in (" ", "")[: 1 + w.endswith(".")]),
    tuple(w for w in "calle|c/|c. |avenida|avd|av.|paseo|p.º|plaza|pl.|plza|camino|ronda|travesía|glorieta|rua |r. |travessa|tv.|alameda|largo|praça|estrada|rodovia|via |viale|v.le|vicolo|piazza|p.zza|corso|lungomare|strada".split("|")),
    tuple(w + " " for w in "straße strasse str. weg gasse platz allee ring ufer damm straat laan plein gracht kade dijk singel dreef hof steeg pad".split()),
    tuple(" " + w + " " for w in "straße strasse str. weg gasse platz allee ring ufer damm".split()),
    tuple(w for w in "ул.|пр.|пер.|наб.|пл.|бул.|б-р|пр-т|ш.|улица|проспект|переулок|набережная|площадь|бульвар|проезд|шоссе".split("|")),
]
ADDRESS_HINT.append(ADDRESS_HINT[5])


def _starts(pieces: list[str]) -> re.Pattern[str]:
    """Pieces that begin with a blank, which is what is looked for first."""
    return re.compile(f" (?:{'|'.join(re.escape(x[1:]) for x in pieces)})")


_ALL_HINTS = list(dict.fromkeys(x for hint in ADDRESS_HINT for x in hint))
_AFTER_BLANK = _starts([x for x in _ALL_HINTS if x[0] == " "])
_BEFORE_BLANK_REVERSED = _starts([x[::-1] for x in _ALL_HINTS if x[0] != " " and x[-1] == " "])
_ANYWHERE = tuple(x for x in _ALL_HINTS if " " not in (x[0], x[-1]))
_ANYWHERE_LATIN, _RUSSIAN = tuple(x for x in _ANYWHERE if not re.match("[а-яё]", x)), re.compile("[а-яё]")
_ANYWHERE_ASCII, _PAPERS_ASCII = (tuple(x for x in hints if x.isascii()) for hints in (_ANYWHERE, _PAPER_STEMS))


def _holds_any(low: str, pieces: tuple[str, ...]) -> bool:
    for piece in pieces:
        if piece in low:
            return True
    return False


def address_patterns(low: str) -> list[re.Pattern[str]]:
    """The patterns for which a lower-case text holds a hint. Most hold none of any, which is seen at once."""
    anywhere = _ANYWHERE_ASCII if low.isascii() else _ANYWHERE if _RUSSIAN.search(low) else _ANYWHERE_LATIN
    if not (_AFTER_BLANK.search(low) or _BEFORE_BLANK_REVERSED.search(low[::-1]) or _holds_any(low, anywhere)):
        return []
    return [pattern for hint, pattern in zip(ADDRESS_HINT, ADDRESS, strict=True) if _holds_any(low, hint)]


# ---------------------------------------------------------------------------------------------- names

_WORD = re.compile(r"(?<![\w@#])[^\W\d_]+(?:[-'’][^\W\d_]+)*(?![\w@])")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def _splitter(last: int) -> re.Pattern[str]:
    """Splits texts without characters after ``last`` into what ``_WORD`` finds and what is between, by classes that are looked up at once."""
    letter, inside = (_as_ranges([p for p in range(last + 1) if re.match(c, chr(p))]) for c in (r"[^\W\d_]", r"\w"))
    return re.compile(f"(?<![{inside}@#])([{letter}]++(?:[-'’][{letter}]++)*)(?![{inside}@])")


_ANY_SPLITTER = re.compile(r"(?<![\w@#])([^\W\d_]++(?:[-'’][^\W\d_]++)*)(?![\w@])")


def split_words(text: str) -> list[str]:
    """What is before the first word, this word, what is before the next, and so on to what is after the last."""
    return (_splitter(0x7F) if text.isascii() else _ANY_SPLITTER if _ASTRAL.search(text) else _splitter(0xFFFF)).split(text)


_TITLE = r"(?:ms|mr|mrs|miss|dr|prof|frau|herr|hr|fr|mme|mlle|m|monsieur|madame|señora?|sra?|srta|don|doña|signora?|sig|sig\.ra|dott|senhora?|dhr|mevr|mevrouw|meneer|г-жа|г-н|госпожа|господин)"
# Phrases after which a name stands, in the eight languages.
_BEFORE = re.compile(
    rf"(?:\b(?:my name is|i am called|regards|best regards|kind regards|sincerely|cheers|yours|yours truly|best wishes|many thanks|attn|signed|ask for|signed by|hi|hello|dear|"
    rf"me llamo|mi nombre es|saludos|un saludo|un abrazo|atentamente|cordialmente|pregunta por|pregunte por|lo firmó|firmado por|hola|querid[oa]|"
    rf"je m['’]appelle|mon nom est|cordialement|amicalement|bien à vous|demandez|signé par|salut|bonjour|cher|chère|"
    rf"ich heiße|mein name ist|viele grüße|mit freundlichen grüßen|liebe grüße|beste grüße|herzliche grüße|gezeichnet|am schalter nach|fragen sie nach|frag nach|unterschrieben hat|unterschrieben von|hallo|liebe[r]?|"
    rf"mi chiamo|il mio nome è|saluti|cordiali saluti|distinti saluti|chiedi di|chieda di|lo ha firmato|firmato da|ciao|car[oa]|"
    rf"(?:eu )?me chamo|o meu nome é|meu nome é|abraços|cumprimentos|atenciosamente|procure por|assinado por|oi|olá|car[oa]|"
    rf"ik heet|mijn naam is|groetjes|groeten|met vriendelijke groet|hartelijke groet|hoogachtend|aan de balie naar|vraag naar|vraag om|getekend door|ondertekend door|hoi|beste|"
    rf"меня зовут|моё имя|с уважением|всего доброго|искренне ваш|искренне ваша|спросите|спроси|лично расписался|лично расписалась|подписано|привет|здравствуйте|дорогой|дорогая)\b|(?:^|[\s])(?:--|>|=>)|[\"“«(])[\s,:]*(?:{_TITLE}\.?\s+)?$",
    re.IGNORECASE,
)
#: The same without signs of a signature or a quotation.
_PHRASE_BEFORE = re.compile(_BEFORE.pattern.replace(r'|(?:^|[\s])(?:--|>|=>)|["“«(])', ")").replace(r"|(?:^|[\s])(?:--|>|=>)|[\"“«(])", ")"), re.IGNORECASE)
_TITLE_BEFORE = re.compile(rf"(?<!\w){_TITLE}\.?\s$", re.IGNORECASE)
_INITIAL_BEFORE = re.compile(r"(?<![\w.])[^\W\d_]\.\s?$")
_INITIAL_AFTER = re.compile(r"\s[^\W\d_]\.(?!\w)")
# Forms of firms, whose names are not those of persons.
_FIRM = re.compile(r"\s(?:GmbH|AG|Ltd|LLC|Inc|BV|NV|SARL|SA|SL|SpA|S\.?r\.?l|Lda|Ltda|KG|OOO|ООО|ЗАО|ОАО)\b\.?", re.IGNORECASE)


def _ends(phrase: str) -> set[str]:
    """The last words of the forms of a phrase."""
    forms = [phrase[:-4] + "o", phrase[:-4] + "a"] if phrase.endswith("[oa]") else [phrase[:-4], phrase[:-4] + "r"] if phrase.endswith("[r]?") else [phrase[:-2], phrase[:-1]] if phrase.endswith("?") else [phrase]
    return {re.search(r"[^\W\d_]+$", form).group() for form in forms}


_PHRASES = _BEFORE.pattern.split(r")\b|(?:^")[0].removeprefix(r"(?:\b(?:").split("|")
_TITLE_ENDS = {word for title in _TITLE[3:-1].split("|") for word in _ends(title)}
# The last words of these phrases and titles: no name stands after a phrase where none of them is before it.
_LAST_WORDS = _TITLE_ENDS | {word for phrase in _PHRASES for word in _ends(phrase)}
#: For each of them the search that is left: one for the phrases that end in it, or after a title the whole.
_ENDING = {word: _BEFORE if word in _TITLE_ENDS else re.compile(rf"\b(?:{'|'.join(p for p in _PHRASES if word in _ends(p))})\b[\s,:]*$", re.IGNORECASE) for word in _LAST_WORDS}


def introduced(text: str, start: int) -> bool:
    """Whether a phrase before ``start``, or a sign of a signature or a quotation, introduces a name; the same as a search."""
    end = start
    while end and (text[end - 1] in " ,:." or text[end - 1].isspace()):
        end -= 1
    if not end:
        return False
    search = _BEFORE
    if text[end - 1] not in "->\"“«(":
        at = end
        while at and text[at - 1].isalpha():
            at -= 1
        search = _ENDING.get(text[at:end].lower())
        if search is None:
            return False
    return search.search(text, max(0, start - 60), start) is not None


def _pieces(word: str) -> list[str]:
    return [word] if word.isalpha() else re.split(r"[-'’]", word)


def is_plain_word(word: str) -> bool:
    """Whether a word is letters alone and not the last of a phrase or title."""
    return word.isalpha() and (low := word.lower()).isalpha() and low not in _LAST_WORDS


#: What leaves it to the word before whether a phrase ends there, and holds no end of a line.
_PLAIN_GAPS = frozenset((" ", ", ", ". ", ": "))


def trigrams(word: str) -> list[str]:
    s = "^^" + word + "$"
    return [s[i : i + 3] for i in range(len(s) - 2)]


class CharModel:
    """Trigrams of characters within words, each backed off to shorter ones."""

    def __init__(self, counts: Counter, sums: dict[str, float] | None = None):
        """From words, or from the ``sums`` of their trigrams."""
        if sums is None:
            sums = Counter()
            for w, n in counts.items():
                for gram in trigrams(w):
                    sums[gram] += n
        self.grams: list[Counter] = [Counter(), Counter(), Counter()]
        self.heads: list[Counter] = [Counter(), Counter(), Counter()]
        for gram, n in sums.items():
            for o in range(3):
                self.grams[o][gram[2 - o :]] += n
                self.heads[o][gram[2 - o : 2]] += n

    def log(self, gram: str) -> float:
        """Log probability of the last of three characters after the two before it."""
        p = 1 / 80
        for o in range(3):
            head = gram[2 - o : 2]
            p = (self.grams[o].get(head + gram[2], 0) + 3 * p) / (self.heads[o].get(head, 0) + 3)
        return math.log(p)


def common_from(texts: int) -> float:
    """How often a word of so many texts has to stand in them to be common."""
    return max(COMMON_TIMES, texts / COMMON_TEXTS)


class Names:
    """What is known of given and family names, and how much a word is like one."""

    def __init__(self, lexicon: list[tuple[str, str]], others: Counter, listed: dict[str, np.ndarray] | None = None, texts: int = 0, sums: dict[str, dict[str, float]] | None = None):
        """From names and the counts of other words in ``texts`` texts; with ``sums``, of the trigrams of each, ``others`` needs
        only hold the common words."""
        self.given = {n.lower() for n, kind in lexicon if kind == "given"}
        self.family = {n.lower() for n, kind in lexicon if kind == "family"}
        self.listed = listed or {}  # sorted hashes of names beyond those of the model
        self.common = {w for w, n in others.items() if n >= common_from(texts)}
        if sums is None:
            rest = Counter({w: 1 + math.log(n) for w, n in others.items() if w not in self.given and w not in self.family})
            self.models = CharModel(Counter(self.given)), CharModel(Counter(self.family)), CharModel(rest)
        else:
            self.models = tuple(CharModel(Counter(), sums.get(kind, {})) for kind in ("given", "family", "other"))
        self.known: dict[str, tuple[float, float]] = {}
        self.odds: dict[str, tuple[float, float]] = {}
        self.seen = Known(self._seen)

    def _seen(self, word: str) -> tuple[bool, float, float, bool, bool]:
        """Whether a word is capitalised, its log odds as a given and as a family name, whether a name can begin with it, and
        whether it is plain."""
        (g, f), upper = self.like(word.lower()), word[0].isupper()
        return upper, g, f, max(g, f) >= LIKELY or upper and g >= AFTER_PHRASE, is_plain_word(word)

    def _odds(self, word: str) -> tuple[float, float]:
        """Log odds of a word as a given and as a family name against any other word."""
        s, g, f = "^^" + word + "$", 0.0, 0.0
        for i in range(2, len(s)):
            gram = s[i - 2 : i + 1]
            pair = self.odds.get(gram)
            if pair is None:
                rest = self.models[2].log(gram)
                pair = self.odds[gram] = (self.models[0].log(gram) - rest, self.models[1].log(gram) - rest)
            g += pair[0]
            f += pair[1]
        return g, f

    def holds(self, word: str, kind: str) -> bool:
        """Whether the lexicon, all of it, has a name."""
        if word in (self.given if kind == "given" else self.family):
            return True
        hashes = self.listed.get(kind)
        if hashes is None or not len(hashes):
            return False
        h = hash_words([word])[0]
        at = int(np.searchsorted(hashes, h))
        return at < len(hashes) and bool(hashes[at] == h)

    def like(self, word: str) -> tuple[float, float]:
        """Log odds that a lower-case word is a given and a family name; 99 for one of the lexicon."""
        found = self.known.get(word)
        if found is None:
            first = _pieces(word)[0]
            given, family = self.holds(first, "given"), self.holds(first, "family")
            if len(first) < 3 or (first in self.common or first in _LAST_WORDS) and not given and not family:
                found = (-99.0, -99.0)
            else:
                g, f = self._odds(first)
                found = (99.0 if given else g, 99.0 if family else f)
            if len(self.known) > KNOWN_WORDS:
                self.known = {}
            self.known[word] = found
        return found


#: Log odds from which a word counts as a name: beside a sure name or a phrase, and on its own among others.
LIKELY, SURE = 1.0, 6.0
#: Log odds that are enough for a capitalised word between a phrase and a sure family name, or alone after a phrase.
AFTER_PHRASE = -5.0


_LINE_BEFORE, _SIGN_AFTER = re.compile(r"(?:^|\n)\s*$"), re.compile(r"\s*[|/;,\n]")


def _cued(text: str, start: int, end: int) -> bool:
    """Whether a phrase or sign introduces the word, or it stands first in a line that has a sign after it."""
    return introduced(text, start) or _SIGN_AFTER.match(text[end : end + 3]) is not None and _LINE_BEFORE.search(text[max(0, start - 60) : start]) is not None


def names_in(text: str, names: Names, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of person names; none in those ``taken``, which are in order and apart."""
    parts, seen = split_words(text), names.seen
    tokens = [seen[word] for word in parts[1::2]]
    if not any([token[3] for token in tokens]):
        return []
    ends = list(accumulate(map(len, parts)))
    starts, stops = ends[:-1:2], ends[1::2]
    for a, b in reversed(taken):
        gone = slice(bisect_right(stops, a), bisect_left(starts, b))
        del tokens[gone], starts[gone], stops[gone]
    out: list[tuple[int, int]] = []
    free = 0
    for i, (upper, g, f, may, _) in enumerate(tokens):
        if not may or i < free:
            continue
        start, end = starts[i], stops[i]
        after_plain = i > 0 and tokens[i - 1][4] and text[stops[i - 1] : start] in _PLAIN_GAPS
        cue = False if after_plain else None  # looked for only where it can matter
        if i + 1 < len(tokens) and text[end : starts[i + 1]] in (" ", "  "):
            upper2, g2, f2, _, _ = tokens[i + 1]
            pair = max(min(g, 40.0) + min(f2, 40.0), min(f, 40.0) + min(g2, 40.0))
            both = min(g, f2) >= LIKELY or min(f, g2) >= LIKELY
            cased = upper and upper2
            sure = pair >= 40 or cased and pair >= 2 * SURE
            found = both and sure and (cased or pair >= 80)
            if not found and cue is None and (both or upper and g >= AFTER_PHRASE and f2 >= SURE) and (sure or f2 >= SURE or pair >= SURE):
                found = cue = _cued(text, start, end)
            if found and not _FIRM.match(text, stops[i + 1]):
                out.append((start, stops[i + 1]))
                free = i + 2
                continue
        before = text[max(0, start - 60) : start]
        if upper and f >= SURE and "." in before[-3:] and (initial := _INITIAL_BEFORE.search(before)):
            out.append((start - len(initial.group()), end))
            continue
        if (upper or g == 99) and g >= AFTER_PHRASE and cue is None and not (upper and g == 99):
            cue = _cued(text, start, end)
        if upper and g >= SURE and (cue or g == 99) and _INITIAL_AFTER.match(text, end):
            end += 3
            if i + 1 < len(tokens) and starts[i + 1] == end + 1 and tokens[i + 1][2] >= LIKELY:
                end = stops[i + 1]
                free = i + 2
            out.append((start, end))
        elif upper and g == 99 or cue and (upper or g == 99) and (g >= SURE or upper and g >= AFTER_PHRASE and _PHRASE_BEFORE.search(before)) or f >= SURE and upper and not after_plain and _TITLE_BEFORE.search(before):
            if not _FIRM.match(text, end):
                out.append((start, end))
    return out


# ---------------------------------------------------------------------------------------------- all together


_AT_IN_BRACKETS = re.compile(r"[(\[{<]\s?at\s?[)\]}>]")


def _email_hinted(shown: str, low: str) -> bool:
    if "@" in shown:
        return True
    if "at" in low and ("dot" in low or _AT_IN_BRACKETS.search(low)) or "arroba" in low or "chiocciola" in low or "arobase" in low or "собака" in low:
        return EMAIL_HINT.search(shown) is not None
    return False


def emails(shown: str) -> list[tuple[int, int, str]]:
    """The email addresses of a text in plain form, also with words or brackets for their signs."""
    clear, starts, stops = unsigned(shown)
    return [(starts[m.start()], stops[m.end() - 1], "email") for m in EMAIL.finditer(clear)]


def items(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """Start, end and kind of each item in the source text, in order."""
    if not text:
        return []
    shown, places, spelled = undigit(*rewritten(text))
    found: list[tuple[int, int, str]] = []
    low = shown.lower()
    if _email_hinted(shown, low):
        found += emails(shown)
    if _DIGIT.search(shown):
        for m in IDENTITY.finditer(shown) if _holds_any(low, _PAPERS_ASCII if low.isascii() else _PAPER_STEMS) else ():
            if sum(map(str.isdigit, m.group("id"))) >= 5:
                series = _SERIES.search(shown, max(0, m.start("id") - 5), m.start("id"))
                found.append((series.start() if series and series.start() > m.start() else m.start("id"), m.end("id"), "id_number"))
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(shown)]
        found += [(a, b, "phone") for a, b in spelled if b - a in SPELLED_DIGITS]
        for pattern in address_patterns(low):
            found += [(m.start(), m.end(), "address") for m in pattern.finditer(shown)]
    found = _apart(found)
    found += [(a, b, "name") for a, b in names_in(shown, names, [(a, b) for a, b, _ in found])]
    found = _apart(found)
    if places is None:
        return found
    return [(places[0][a], places[1][b - 1], kind) for a, b, kind in found]


def _apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


def redacted(text: str | None, names: Names) -> str | None:
    """The text with each item replaced by its kind in square brackets."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in items(text, names):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def fitted(spark: SparkSession, sf_dir: str) -> Names:
    """The names of a data folder: its whole lexicon, and the words of all its texts."""
    names = table(spark, sf_dir, "name_lexicon").where("name IS NOT NULL").select("name", "kind").distinct()
    return fit_tables(names, fields(spark, sf_dir, _FIELDS).select("text"))


def gram_sums(words_: DataFrame, weigh: Callable[[str, str, int], int]) -> dict[str, dict[str, float]]:
    """For each kind the sums over its trigrams of what words weigh; ``words_`` holds kind, word and n."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[tuple[str, str], int] = {}
        for kind, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            weight = weigh(kind, word, n)
            for gram in trigrams(word) if weight else ():
                sums[kind, gram] = sums.get((kind, gram), 0) + weight
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.string()), pa.array([g for _, g in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["kind", "gram", "n"])

    rows = map_batches(words_.select("kind", "word", "n"), run, "kind string, gram string, n bigint").groupBy("kind", "gram").agg(F.sum("n").alias("n")).limit(MOST_GRAMS + 1).toPandas()
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"the words have more than {MOST_GRAMS:,} trigrams")
    return {str(kind): dict(zip(own.gram, own.n / PARTS, strict=True)) for kind, own in rows.groupby("kind")}


@functools.lru_cache(maxsize=2)
def loaded(sent: bytes) -> tuple[Names, Known]:
    """Names that were sent to a worker, with what it has found of words since, and the facts of words by their lexicon."""
    names = pickle.loads(sent)
    listed = names.given | names.family
    return names, word_facts((lambda w: names.holds(w, "given") or names.holds(w, "family")) if names.listed else listed.__contains__)


def fit_tables(names: DataFrame, texts: DataFrame) -> Names:
    """As :func:`fit`, from a table of distinct (name, kind) and one of texts, both of any size; every delivery counts."""
    spark, listed = names.sparkSession, listed_names(names)
    lexicon = [] if listed else [(r.name, r.kind) for r in names.collect()]

    def lower(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([n.lower() for n in batch.column(0).to_pylist()], pa.string())], names=["kind", "word"])

    sums = gram_sums(map_batches(names.where("kind IS NOT NULL"), lower, "kind string, word string").distinct().withColumn("n", F.lit(1)), lambda kind, word, n: PARTS)
    looked_up = Names(lexicon, Counter(), listed, sums=sums)
    sent = spark.sparkContext.broadcast(pickle.dumps(looked_up))

    def prepare(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The texts in plain form with the places of words that are left out, and after them the counts of the others."""
        shown, gone, facts = [], [], loaded(sent.value)[1]

        def rows() -> Iterator[tuple[str, list[str], set[int]]]:
            for text in batch.column(0).to_pylist():
                row = parted(text, facts)
                shown.append(row[0])
                gone.append(np.array(sorted(row[2]), np.int32).tobytes())
                yield row

        found = count_shown(rows())
        columns = (shown, pa.string()), (gone, pa.binary()), (list(found), pa.string()), (list(found.values()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([None] * (k > 1) * len(shown) + x + [None] * (k < 2) * len(found), kind) for k, (x, kind) in enumerate(columns)], names=["shown", "hidden", "word", "n"])

    both = cut(map_batches(texts.where(F.length("text") > 0).select("text"), prepare, "shown string, hidden binary, word string, n bigint"))
    prepared = both.where("shown IS NOT NULL").select("shown", "hidden")
    size = prepared.count()
    counts = cut(both.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))

    def weigh(kind: str, word: str, n: int) -> int:
        names = loaded(sent.value)[0]
        return 0 if names.holds(word, "given") or names.holds(word, "family") else round(PARTS * (1 + math.log(n)))

    def fitted_to(counts: DataFrame) -> Names:
        common = {r.word: r.n for r in counts.where(F.col("n") >= common_from(size)).collect()}
        return Names(lexicon, Counter(common), listed, size, sums | gram_sums(counts.withColumn("kind", F.lit("other")), weigh))

    first = spark.sparkContext.broadcast(pickle.dumps(fitted_to(counts)))

    def name_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The words that were counted and stand in names that the first fit finds."""
        names, found = loaded(first.value)[0], Counter()
        for shown, hidden in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = names_in(shown, names, [])
            if spans:
                gone, parts = set(np.frombuffer(hidden, np.int32).tolist()), split_words(shown)
                found.update(w for i in in_names(parts, spans) if i not in gone for w in _pieces(parts[2 * i + 1].lower()))
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "gone"])

    gone = map_batches(prepared, name_words, "word string, gone bigint").groupBy("word").agg(F.sum("gone").alias("gone"))
    left = counts.join(gone, "word", "left").select("word", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")).where("n > 0")
    return fitted_to(cut(left))


def listed_names(names: DataFrame) -> dict[str, np.ndarray]:
    """The sorted hashes of all names of each kind, where the lexicon is larger than the model needs; its size is checked."""
    size = names.count()
    if size <= LEXICON_ROWS:
        return {}
    if size > LARGEST_LEXICON:
        raise ValueError(f"the lexicon has {size:,} rows; at most {LARGEST_LEXICON:,} can be looked up in")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = hash_words([n.lower() for n in batch.column(0).to_pylist()]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(hashes), batch.column(1)], names=["hash", "kind"])

    rows = map_batches(names, run, "hash bigint, kind string").toPandas()
    return {str(kind): np.sort(own.hash.to_numpy(np.int64).view(np.uint64)) for kind, own in rows.groupby("kind")}


def word_facts(holds: Callable[[str], bool]) -> Known:
    """Of a word: 1 if it is not plain, and 2 more if the lexicon ``holds`` its first piece."""
    return Known(lambda word: (not is_plain_word(word)) + 2 * bool(holds(_pieces(word.lower())[0])))


def parted(text: str, facts: Known) -> tuple[str, list[str], set[int]]:
    """A text in plain form without email addresses, its words, and which of them stand where names do: after a phrase that
    introduces one, or beside a word of the lexicon."""
    shown = rewritten(text)[0]
    for a, b, _ in reversed(emails(shown) if _email_hinted(shown, shown.lower()) else []):
        shown = shown[:a] + " " + shown[b:]
    parts = split_words(shown)
    words = parts[1::2]
    hidden: set[int] = set()
    if not words:
        return shown, words, hidden
    starts = list(accumulate(map(len, parts)))[:-1:2]
    if introduced(shown, starts[0]):
        hidden |= {0, 1}
    for i, gap, fact in [x for x in zip(range(len(words)), parts[2::2], map(facts.__getitem__, words), strict=True) if x[2] or x[1] not in _PLAIN_GAPS]:
        if fact & 2:
            hidden |= {i - 1, i + 1}
        # after a plain word and a plain gap no phrase ends
        if (fact & 1 or gap not in _PLAIN_GAPS) and i + 1 < len(words) and introduced(shown, starts[i + 1]):
            hidden |= {i + 1, i + 2}
    return shown, words, hidden


def count_shown(rows: Iterable[tuple[str, list[str], set[int]]]) -> Counter:
    """How often the pieces of the words stand in parted texts, in lower case and where no name does."""
    whole: Counter = Counter()
    for _, words, hidden in rows:
        whole.update(words)
        whole.subtract([words[i] for i in hidden if 0 <= i < len(words)])
    found: Counter = Counter()
    for word, n in whole.items():
        for piece in _pieces(word.lower()) if n else ():
            found[piece] += n
    return found


def in_names(parts: list[str], names: list[tuple[int, int]]) -> set[int]:
    """Which words of a split text begin in spans, which may share some."""
    starts = list(accumulate(map(len, parts)))[:-1:2]
    return {i for a, b in names for i in range(bisect_left(starts, a), bisect_left(starts, b))}


def fit(lexicon: list[tuple[str, str]], texts: list[str], more: dict[str, np.ndarray] | None = None) -> Names:
    """Names from (name, kind) and texts. Words that stand where names do are left out of the other words."""
    facts = word_facts({n.lower() for n, _ in lexicon}.__contains__)
    rows = [parted(text, facts) for text in texts]
    names = Names(lexicon, count_shown(rows), more, len(texts))
    for shown, _, hidden in rows:  # names that the first fit finds are no other words in the second
        if spans := names_in(shown, names, []):
            hidden.update(in_names(split_words(shown), spans))
    return Names(lexicon, count_shown(rows), more, len(texts))


def find_items(df: DataFrame, keep: list[str], text: str, names: Names) -> DataFrame:
    """Columns ``keep`` with kind, start_pos and end_pos, one row for each item in column ``text``."""
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(names))  # its size follows from the lexicon and the alphabets

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = loaded(sent.value)[0]
        take, rows = [], []
        for i, t in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()):
            for item in items(t, names):
                take.append(i)
                rows.append(item)
        kept = batch.select(keep).take(pa.array(take, pa.int64()))
        new = [pa.array([r[2] for r in rows], pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
        return pa.RecordBatch.from_arrays([*kept.columns, *new], names=[*keep, "kind", "start_pos", "end_pos"])

    kinds = dict(df.dtypes)
    return map_batches(df.select(*dict.fromkeys([*keep, text])).where(F.length(text) > 0), run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "kind string, start_pos bigint, end_pos bigint"]))


_FIELDS = [("spam_item", "text"), ("evaluation_case", "a")]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of personal data with its kind and place."""
    return find_items(fields(spark, sf_dir, _FIELDS), ["src", "id", "field"], "text", fitted(spark, sf_dir)).drop("end_pos").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its items replaced."""
    df, names = fields(spark, sf_dir, _FIELDS), fitted(spark, sf_dir)
    sent = spark.sparkContext.broadcast(pickle.dumps(names))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = loaded(sent.value)[0]
        new = pa.array([redacted(t, names) for t in batch.column(3).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], new], names=["src", "id", "field", "redacted"])

    return map_batches(df, run, "src string, id string, field string, redacted string").distinct()
