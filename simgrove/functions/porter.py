"""The Porter stemmer (1980), with the two usual departures bli -> ble and logi -> log."""

from __future__ import annotations

import re

_SHAPES: dict = {}


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


#: Suffixes and what replaces them.
STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split())
STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")


def _longest(word: str, table: dict[str, str], least: int) -> str:
    """The longest suffix in the table is replaced if the stem before it measures more than least."""
    for n in range(min(len(word) - 1, 7), 0, -1):
        if (end := word[-n:]) in table:
            stem = word[:-n]
            ok = _measure(stem) > least and (end != "ion" or stem[-1:] in ("s", "t"))
            return stem + table[end] if ok else word
    return word


def stem(w: str) -> str:
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (cut := next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x)), None)) is not None and _vowel(cut):
        w = cut
        if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _cvc(w)):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(_longest(_longest(w, STEP2, 0), STEP3, 0), STEP4, 1)
    if w.endswith("e") and ((m := _measure(w[:-1])) > 1 or (m == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w
