"""Transcription between Latin letters and the scripts that go by syllables: kana, Devanagari, Han.

Kana and Devanagari follow from rules over the order of their code points; Han is a short table of common characters.
Characters that no rule knows stay as they are.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.lazy import arrow

# The syllables of kana, in the order of the code points from the small a on; small forms and voiced ones
# follow their plain one.
_KANA = (
    "a a i i u u e e o o ka ga ki gi ku gu ke ge ko go sa za shi ji su zu se ze so zo ta da chi ji tsu tsu zu te de to do na ni nu ne no "
    "ha ba pa hi bi pi fu bu pu he be pe ho bo po ma mi mu me mo ya ya yu yu yo yo ra ri ru re ro wa wa wi we wo n vu ka ke"
).split(" ")
KANA = {chr(base + i): s for base in (0x3041, 0x30A1) for i, s in enumerate(_KANA)}
_DOUBLING, _LENGTHENING, _NASAL, _SMALL_Y = "っッ", "ー", "んン", {"ゃ": "a", "ュ": "u", "ゅ": "u", "ャ": "a", "ょ": "o", "ョ": "o"}

# The consonants of Devanagari with their own vowel, in the order of the code points; independent vowels; signs of
# vowels; what a dot below makes of a consonant.
_CONSONANTS = "ka kha ga gha nga cha chha ja jha nya ta tha da dha na ta tha da dha na na pa pha ba bha ma ya ra ra la la la va sha sha sa ha".split(" ")
CONSONANT = {chr(0x915 + i): s for i, s in enumerate(_CONSONANTS)} | {chr(0x958 + i): s for i, s in enumerate("qa kha gha za ra rha fa ya".split(" "))}
VOWEL = dict(zip("अआइईउऊऋऌऍऎएऐऑऒओऔ", "a a i i u u ri lri e e e ai o o o au".split(" "), strict=True)) | {"ॠ": "ri"}
SIGN = dict(zip("ािीुूृॄॅॆेैॉॊोौ", "a i i u u ri ri e e e ai o o o au".split(" "), strict=True))
DOTTED = {"ka": "qa", "ga": "gha", "ja": "za", "pha": "fa", "da": "ra", "dha": "rha"}

# Common Han characters and their syllables.
HAN = dict(
    x.split(" ")
    for x in (
        "你 ni|好 hao|我 wo|是 shi|不 bu|的 de|一 yi|了 le|在 zai|有 you|人 ren|中 zhong|国 guo|大 da|学 xue|爱 ai|他 ta|她 ta|们 men|和 he|这 zhe|那 na|个 ge|上 shang|下 xia|来 lai|去 qu|看 kan|很 hen|也 ye|都 dou|就 jiu|"
        "还 hai|要 yao|会 hui|能 neng|可 ke|到 dao|家 jia|年 nian|天 tian|小 xiao|多 duo|少 shao|朋 peng|友 you|语 yu|文 wen|字 zi|汉 han|吗 ma|呢 ne|吧 ba|啊 a|哦 o|说 shuo|听 ting|谢 xie|见 jian|再 zai|吃 chi|喝 he|老 lao|师 shi|"
        "生 sheng|现 xian|时 shi|分 fen|钟 zhong|月 yue|日 ri|星 xing|期 qi|号 hao|钱 qian|买 mai|卖 mai|店 dian|车 che|站 zhan|饭 fan|菜 cai|茶 cha|水 shui|火 huo|木 mu|金 jin|行 xing|走 zou|跑 pao|笑 xiao|高 gao|短 duan|新 xin|旧 jiu|"
        "热 re|冷 leng|快 kuai|慢 man|对 dui|错 cuo|开 kai|关 guan|东 dong|南 nan|西 xi|北 bei|每 mei|些 xie"
    ).split("|")
)
_FIRST_HAN = {s: ch for ch, s in reversed(HAN.items())}


def kana_to_latin(text: str) -> str:
    """Syllable by syllable: a small tsu doubles the consonant after it, a long mark the vowel before it, a small y joins the
    syllable before it, and the nasal is m before lips."""
    out: list[str] = []
    double = False
    for i, ch in enumerate(text):
        if ch in _DOUBLING:
            double = True
            continue
        if ch == _LENGTHENING:
            if out and out[-1][-1:] in "aiueo":
                out.append(out[-1][-1])
            continue
        syllable = KANA.get(ch)
        if ch in _NASAL:
            syllable = "m" if KANA.get(text[i + 1 : i + 2], " ")[0] in "bpm" else "n"
        elif ch in _SMALL_Y and out and len(out[-1]) > 1 and out[-1].endswith("i"):
            stem = out[-1][:-1]
            out[-1] = stem + ("" if stem.endswith(("sh", "ch", "j")) else "y") + _SMALL_Y[ch]
            continue
        if syllable is None:
            out.append(ch)
        else:
            out.append(syllable[0] + syllable if double and syllable[0] not in "aiueo" else syllable)
        double = False
    return "".join(out)


def devanagari_to_latin(text: str) -> str:
    """A consonant has its own vowel until a sign gives it another or takes it away; at the end of a word of more than one
    letter it is silent."""
    out: list[str] = []
    held, begun = "", 0  # a consonant that waits for its vowel, and where the word began

    def close(vowel: bool) -> None:
        nonlocal held
        if held:
            out.append(held if vowel else held.removesuffix("a"))
        held = ""

    for ch in [*text, ""]:
        if ch in SIGN:
            close(False)
            out.append(SIGN[ch])
        elif ch == "्":
            close(False)
        elif ch == "़":
            held = DOTTED.get(held, held)
        elif ch in ("ं", "ँ", "ः"):
            close(True)
            out.append("h" if ch == "ः" else "n")
        elif ch == "ऽ":
            close(True)
        elif ch in VOWEL:
            close(True)
            out.append(VOWEL[ch])
        elif ch in CONSONANT:
            close(True)
            held = CONSONANT[ch]
        else:
            close(len(out) == begun)
            out.append(ch)
            begun = len(out)
    return "".join(out)


def han_to_latin(text: str) -> str:
    """Syllables with a blank between them; what is no Han character of the table stays."""
    out: list[str] = []
    for ch in text:
        syllable = HAN.get(ch)
        if syllable and out and out[-1][-1:].strip():
            out.append(" ")
        out.append(syllable or ch)
    return "".join(out)


def latin_to_han(text: str) -> str | None:
    """The first character of each syllable, where every word is one; else None."""
    found = [_FIRST_HAN.get(w) for w in text.lower().split()]
    return "".join(found) if found and all(found) else None


def other_views(text: str | None) -> dict[str, str]:
    """The transcriptions that only these rules give."""
    if not text:
        return {}
    out = {}
    if re.search("[ぁ-ヿ]", text):
        out["Latn"] = kana_to_latin(han_to_latin(text))
    elif re.search("[ऀ-ॿ]", text):
        out["Latn"] = devanagari_to_latin(text)
    elif re.search("[一-鿿]", text):
        out["Latn"] = han_to_latin(text)
    elif text.isascii() and (han := latin_to_han(text)):
        out["Hans"] = han
    return {k: v for k, v in out.items() if v != text}


@arrow("map<string,string>")
def syllabic_views(s: pd.Series) -> pd.Series:
    return s.map(other_views)


#: A character of a script that goes by syllables.
SYLLABIC = r"[\x{900}-\x{97f}\x{3041}-\x{30ff}\x{4e00}-\x{9fff}]"


def needed(c: Column) -> Column:
    """Whether a text may have such a view."""
    return c.rlike(SYLLABIC) | c.rlike(r"^\s*[a-zA-Z]{1,6}(\s+[a-zA-Z]{1,6})*\s*$")
