"""Scalar text functions as column expressions; what Spark cannot express runs as Arrow-batched pandas functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_SPACE = r"(?U)\s+"
_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
_CJK_SIGNS = re.compile("[\u3005\u3007\u3021-\u3029\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f\u1100-\u11ff\u3131-\u318e\uac00-\ud7a3\uff66-\uff9f]")
# Signs that clean_up drops; scripts that count as non-Latin.
DROPPED = "$€£¥¢%&*+=<>^|~@#\\_[]{}"
_NON_LATIN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsCyrillic}\p{IsGreek}\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}\p{IsThai}\p{IsBengali}]"


def words(c: Column) -> Column:
    """Words between Unicode white space; null stays null."""
    return F.filter(F.split(c, _SPACE), lambda x: x != "")


def count_words(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit(""))))


def estimate_tokens_from_words(n: Column) -> Column:
    return F.round(n * F.lit(1.3)).cast("int")


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded up; where more than a tenth are CJK these count 1.5."""
    n = F.length(c)
    cjk = F.regexp_count(c, F.lit(_CJK))
    dense = F.ceil(cjk * F.lit(1.5) + (n - cjk) / F.lit(4.0))
    return F.when(n == 0, 0).when(cjk > n * F.lit(0.1), dense).otherwise(F.ceil(n / F.lit(4.0))).cast("int")


def estimate_tokens_of(s: str) -> int:
    """`estimate_tokens` of one string."""
    n, cjk = len(s), len(_CJK_SIGNS.findall(s))
    return -int(-(cjk * 1.5 + (n - cjk) / 4) // 1) if cjk > n * 0.1 else -(-n // 4)


def clean_up(c: Column) -> Column:
    return F.translate(c, DROPPED, "")


def truncate(c: Column, n: int) -> Column:
    """At most n characters, the cut end without white space; blank becomes Unknown."""
    cut = F.regexp_replace(F.substring(c, 1, n), r"[ \t\n\r]+$", "")
    return F.when(F.trim(c) == "", "Unknown").when(F.length(c) <= n, c).otherwise(cut)


def clean_code_block(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s*```(?:json)?", ""), r"```\s*$", ""), r"^\s+|\s+$", "")


def contains_non_latin(c: Column) -> Column:
    return c.rlike(_NON_LATIN)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def sanitize_snippet(c: Column) -> Column:
    """Escape all HTML except <b> and </b>."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("&lt;b&gt;", "<b>"), ("&lt;/b&gt;", "</b>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def head_tail_words(c: Column, head: int, tail: int) -> Column:
    """The first words and, of what is left, the last ones."""
    ws = words(F.coalesce(c, F.lit("")))
    n = F.size(ws)
    h = F.least(F.lit(max(head, 0)), n)
    t = F.least(F.lit(max(tail, 0)), n - h)
    first = F.array_join(F.slice(ws, F.lit(1), h), " ")
    last = F.array_join(F.slice(ws, n - t + 1, t), " ")
    return F.when(t > 0, F.concat(first, F.lit("\n\n[...]\n\n"), last)).otherwise(first)


def split_sentences(c: Column) -> Column:
    """Sentences keep their mark; an empty line divides too."""
    return F.split(c, r"(?<=[.!?])\s+|\n\n")


def tokens(c: Column) -> Column:
    """Letters and digits in runs, case kept."""
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def lexemes(c: Column) -> Column:
    """Tokens of the full-text index: in lower case, position = index."""
    return tokens(F.lower(c))


def normalize_for_embedding(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[-_]", " "), r"\s+", " "))


def sanitize_filename(c: Column) -> Column:
    return F.translate(F.translate(c, "/\\", "__"), "\r\n\"'\0", "")


def _tenths(x: Column) -> Column:
    """One decimal, ties to even as the number is held."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def format_bytes(n: Column) -> Column:
    """Bytes in binary units, up to GiB."""
    out = F.format_string("%d B", n)
    for power, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = F.when(n >= 1024**power, F.concat(_tenths(n / F.lit(float(1024**power))), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_size(n: Column) -> Column:
    """Bytes as listings show them: one letter for the unit, up to EB."""
    out = F.format_string("%d B", n)
    for power, unit in enumerate("KMGTPE", 1):
        out = F.when(n >= 1024**power, F.concat(_tenths(n / F.lit(float(1024**power))), F.lit(f" {unit}B"))).otherwise(out)
    return out


def human_duration(ms: Column) -> Column:
    """Milliseconds: tenths of seconds under a minute, whole seconds (rounded) from there on."""
    s = F.round(ms / F.lit(1000.0)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    short = F.concat(_tenths(ms / F.lit(1000.0)), F.lit("s"))
    return F.when(ms < 60_000, short).when(ms < 3_600_000, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm %ds", h, m, s % 60))


def quote_identifier(name: str) -> str:
    """A name between double quotes, for SQL."""
    return '"' + name.replace('"', '""') + '"'


def quote_literal(value: str | None) -> str:
    """A string between single quotes, for SQL; a backslash makes it an escape string."""
    if value is None:
        return "NULL"
    s = value.replace("'", "''")
    return f" E'{s.replace(chr(92), chr(92) * 2)}'" if "\\" in s else f"'{s}'"


def highlight(c: Column, on: str = "\x1b[1;33m", off: str = "\x1b[0m") -> Column:
    """A snippet for a terminal: what stands between <b> and </b> in colour."""
    return F.replace(F.replace(c, F.lit("<b>"), F.lit(on)), F.lit("</b>"), F.lit(off))


def max_match_body_bytes(n: Column) -> Column:
    least, most = 256 << 10, 4 << 20
    return F.when(n <= 0, most).otherwise(F.least(F.greatest(n * 24, F.lit(least)), F.lit(most)))


def escape_like(prefix: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", prefix)


def like_prefix(c: Column, prefix: str, escape: bool = False) -> Column:
    """Prefix match; % and _ of the prefix are wildcards unless escaped."""
    return c.like((escape_like(prefix) if escape else prefix) + "%")


_DASHES = dict.fromkeys(map(ord, "-_‐‑‒–—"), " ")


def fold(s: str, dashes: dict[int, str]) -> str:
    """Compatibility form, lower case, dashes to spaces, without accents; only a to z and single spaces remain."""
    s = unicodedata.normalize("NFKC", s).strip().lower().translate(dashes)
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return " ".join(re.sub("[^a-z ]", "", s).split())


def normalize_name(s: str) -> str:
    return fold(s, _DASHES)


def normalize_tag(s: str) -> str:
    return fold(s, {ord("-"): " ", ord("_"): " "})


def normalize_for_db(c: Column | str) -> Column:
    """The matching form of a person's name."""

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(normalize_name, na_action="ignore")

    return run(c)


def normalize_tags(c: Column | str) -> Column:
    """The matching forms of an array of tags, in order, without empty and repeated ones."""

    @pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda ts: [t for t in dict.fromkeys(normalize_tag(t) for t in ts if t is not None) if t], na_action="ignore")

    return run(c)


def truncate_bytes(limit: int):
    """A function that cuts text to so many bytes of UTF-8, not inside a character."""

    @pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if len(t) * 4 <= limit else t.encode()[:limit].decode("utf-8", "ignore"), na_action="ignore")

    return cut
