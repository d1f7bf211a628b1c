"""Romanisation of the nine Indic scripts, by rule.

The blocks from Devanagari (U+0900) to Malayalam (U+0D00) have one layout: a character's offset in its block
of 128 tells the letter. One table of offsets therefore serves all nine.
"""

from __future__ import annotations

# Letters by their offset in a block.
VOWELS = {0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "r", 0x0D: "e", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au"}
CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n", 0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh",
    0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r",
    0x32: "l", 0x33: "l", 0x34: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x58: "k", 0x59: "kh", 0x5A: "g", 0x5B: "z", 0x5C: "r", 0x5D: "rh", 0x5E: "f", 0x5F: "y",
}
SIGNS = {0x3E: "aa", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "r", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
NASALS = {0x01: "n", 0x02: "n", 0x03: "h"}
VIRAMA = 0x4D
FIRST, LAST = 0x0900, 0x0D7F


def _offset(ch: str) -> int:
    o = ord(ch)
    return o & 0x7F if FIRST <= o <= LAST else -1


def has_indic(text: str) -> bool:
    return not text.isascii() and any(FIRST <= ord(c) <= LAST for c in text)


def romanise(text: str) -> str:
    """Latin letters with the inherent vowel spoken: "वयखेभि" gives "vayakhebhi". Other characters stay."""
    out: list[str] = []
    pending = False  # a consonant whose vowel is still open
    for ch in text:
        at = _offset(ch)
        if at in CONSONANTS:
            if pending:
                out.append("a")
            out.append(CONSONANTS[at])
            pending = True
            continue
        if pending and at == 0x3C:
            continue
        if pending and at in SIGNS:
            out.append(SIGNS[at])
        elif pending and at != VIRAMA and ch not in "‌‍":
            out.append("a")
        if at in VOWELS:
            out.append(VOWELS[at])
        elif at in NASALS:
            out.append(NASALS[at])
        elif 0x66 <= at <= 0x6F:
            out.append(str(at - 0x66))
        elif at < 0 and not (pending and ch in "‌‍"):
            out.append(ch)
        elif at >= 0 and at in SIGNS and not pending:
            out.append(SIGNS[at])
        pending = pending and ch in "‌‍"
    if pending:
        out.append("a")
    return "".join(out)


def transliterate(text: str) -> str:
    """Short romanisation without inherent vowels, lower-cased: "सिल्वर डेवलपर्स" gives "silvr devlprs".

    Texts without an Indic letter come back unchanged.
    """
    if not has_indic(text):
        return text
    short = {"aa": "a", "chh": "ch"}
    out = []
    for ch in text:
        at = _offset(ch)
        letter = CONSONANTS.get(at) or VOWELS.get(at) or SIGNS.get(at) or NASALS.get(at)
        if letter is not None and at >= 0:
            out.append(short.get(letter, letter))
        elif 0x66 <= at <= 0x6F:
            out.append(str(at - 0x66))
        elif at < 0:
            out.append(ch)
    return "".join(out).lower()
