"""Names in Latin letters: a transliteration by small tables and by the Unicode names of letters."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# Greek and Cyrillic letters in Latin letters.
GREEK = "α:a β:v γ:g δ:d ε:e ζ:z η:i θ:th ι:i κ:k λ:l μ:m ν:n ξ:x ο:o π:p ρ:r σ:s ς:s τ:t υ:y φ:f χ:ch ψ:ps ω:o"
CYRILLIC = "а:a б:b в:v г:g ґ:g д:d е:e ё:e є:ye ж:zh з:z и:i і:i ї:i й:y к:k л:l м:m н:n о:o п:p р:r с:s т:t у:u ў:u ф:f х:kh ц:ts ч:ch ш:sh щ:shch ъ: ы:y ь: э:e ю:yu я:ya ђ:dj ј:j љ:lj њ:nj ћ:c џ:dz"
# Letters of Arabic and Hebrew by their Unicode names.
ARABIC = "alef:a beh:b teh:t theh:th jeem:j hah:h khah:kh dal:d thal:dh reh:r zain:z seen:s sheen:sh sad:s dad:d tah:t zah:z ain:a ghain:gh feh:f qaf:q kaf:k lam:l meem:m noon:n heh:h waw:w yeh:y hamza: peh:p tcheh:ch jeh:zh gaf:g marbuta:h maksura:a keheh:k"
HEBREW = "alef:a bet:b gimel:g dalet:d he:h vav:v zayin:z het:h tet:t yod:y kaf:k lamed:l mem:m nun:n samekh:s ayin:a pe:p tsadi:ts qof:q resh:r shin:sh tav:t"
_LETTERS = dict(x.split(":") for x in f"{GREEK} {CYRILLIC}".split())
# Latin letters that have no accent to drop.
LATIN = "ß:ss ø:o æ:ae œ:oe ł:l đ:d þ:th ð:d ı:i"
_LETTERS |= dict(x.split(":") for x in LATIN.split())
_BY_NAME = {"ARABIC": dict(x.split(":") for x in ARABIC.split()), "HEBREW": dict(x.split(":") for x in HEBREW.split())}
_CLUSTER = re.compile(r"(?:shch|sh|ch|zh|kh|gh|ts|dz|ph|th|[a-z])")


def letter(c: str) -> str:
    """One character in Latin letters, '' for marks; an ideograph, whose reading no rule gives, becomes its code."""
    if c.isascii():
        return c
    low = c.lower()
    if low in _LETTERS:
        out = _LETTERS[low]
        return out.capitalize() if c != low else out
    name = unicodedata.name(c, "")
    script, _, rest = name.partition(" ")
    if script == "LATIN" or " WITH " in name:  # taken apart by the caller
        return ""
    last = rest.rsplit(" ", 1)[-1].lower()
    if script in ("HIRAGANA", "KATAKANA", "HANGUL") or (script.isalpha() and " LETTER " in name and script in ("DEVANAGARI", "BENGALI", "TAMIL", "TELUGU", "GUJARATI", "KANNADA", "MALAYALAM", "THAI")):
        return last if last.isalpha() else ""
    if script in _BY_NAME:
        return next((_BY_NAME[script][w] for w in rest.lower().split() if w in _BY_NAME[script]), "")
    if name.startswith("CJK "):
        return f"u{ord(c):x}"
    if " LETTER " in name and last.isalpha():  # Georgian, Armenian and others: how the letter's name begins
        out = _CLUSTER.match(last)[0]
        return out.capitalize() if " CAPITAL " in name else out
    return ""


def transliterate(s: str | None) -> str | None:
    """s in Latin letters: accents dropped, letters of other scripts one by one."""
    if s is None or s.isascii():
        return s
    out = []
    for c in unicodedata.normalize("NFC", s):
        out.append(letter(c) or "".join(letter(x) for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)))
    return "".join(out)


def transliterated(c: Column) -> Column:
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = {x: transliterate(x) for x in s.dropna().unique()}
        return s.map(known).astype(object).where(s.notna(), None)

    return run(c)
