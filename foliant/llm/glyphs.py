"""Characters that scanning takes for one another, and the keys under which words that differ by them meet."""

from __future__ import annotations

import random
import re

# Characters that scanning takes for one another; the first of a class stands for it. Pairs of letters stand for one letter.
PAIRS = [("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("nn", "m")]
CLASSES = ["hbn", "ec", "tf", "o0", "il1!|", "a@", "s5$", "g9q", "z2"]
#: Each character as the strokes it is read from: what looks alike, one by one or in pairs, has the same strokes.
_STROKES = str.maketrans({c: k[0] for k in CLASSES for c in k} | dict.fromkeys("hbnu", "ii") | {"r": "i", "m": "iii", "d": "ei", "w": "vv"})
#: All of ASCII but line ends, letters and members of a class.
_NONE = bytes(c for c in range(128) if c != 10 and not chr(c).isalpha() and chr(c) not in "".join(CLASSES))
_ASCII = bytes(range(128))
_ONE = bytes.maketrans("".join(CLASSES).encode(), "".join(k[0] * len(k) for k in CLASSES).encode())
_NUMBERS = re.compile(r"\d(?<![^\W_]\d)\d*(?![^\W_])")
#: A digit as 0, a letter as a, and a number of its own in these.
_KINDS = bytes(48 if 48 <= c < 58 else 97 if c >= 128 or chr(c).isalpha() else 10 for c in range(256))
_ALONE = re.compile(rb"0(?<![a0]0)0*+(?!a)")


def skeleton(w: str) -> str:
    """The strokes of a word: equal for words that differ by look-alikes only."""
    return w.translate(_STROKES)


def line_key(line: str) -> str:
    """The letters of a line, each as the first of its class; numbers of their own do not count."""
    return line_keys([line])[0]


def line_keys(lines: list[str]) -> list[str]:
    """The keys of lines (without line ends in them), found at once: only characters of ASCII are replaced, so UTF-8 bytes can be."""
    s = "\n".join(lines).lower()
    b, beyond = s.encode("utf-8", "surrogatepass"), set()
    if not b.isascii():
        beyond = set(b.translate(None, _ASCII).decode("utf-8", "surrogatepass"))
        if digits := set(filter(str.isdecimal, beyond)):
            s = _NUMBERS.sub("", s)
        for c in beyond:
            if not c.isalnum():
                s = s.replace(c, " ")
        for c in digits:
            s = s.replace(c, "")
        b = s.encode("utf-8", "surrogatepass")
    if not any(map(str.isdecimal, beyond)) and b"0" in (kinds := b.translate(_KINDS)):
        parts, at = [], 0
        for m in _ALONE.finditer(kinds):
            parts.append(b[at : m.start()])
            at = m.end()
        b = b"".join([*parts, b[at:]])
    return b.translate(_ONE, _NONE).decode("utf-8", "surrogatepass").split("\n")


def apart(a: str, b: str) -> tuple[str, str]:
    """Both without what they begin and end with in common, which is neither in their distance nor out of their common sequence."""
    k, n = 0, min(len(a), len(b))
    while k < n and a[k] == b[k]:
        k += 1
    m = 0
    while m < n - k and a[-1 - m] == b[-1 - m]:
        m += 1
    return a[k : len(a) - m], b[k : len(b) - m]


def distance(a: str, b: str, most: int = 4) -> int:
    """Levenshtein distance, at most `most`."""
    if abs(len(a) - len(b)) >= most:
        return most
    a, b = apart(a, b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return min(row[-1], most)


def misread(w: str, rnd: random.Random) -> str | None:
    """w as a scan may misread it; None if no character of it lends itself."""
    ways = [(i, len(x), y) for a, b in PAIRS for x, y in ((a, b), (b, a)) if x in w for i in range(len(w)) if w.startswith(x, i)]
    for k in CLASSES:
        ways += [(i, 1, x) for i, c in enumerate(w) if c in k for x in k if x != c]
    if not ways:
        return None
    i, n, y = rnd.choice(ways)
    return w[:i] + y + w[i + n :]


#: Words of so many letters (of the skeleton) and more are looked up by three letters in a row, shorter ones by two.
LONG = 8


def gram_keys(s: str, order: dict[str, int], shifts: tuple[int, ...]) -> list[str]:
    """Keys of the inverted join for the skeleton s: of its q-grams the q + 1 that come first in the order, and those equal to the last of them, with their places.

    One slip spoils at most q of the q-grams and moves the others by at most one place, so two skeletons one slip apart share one of
    these keys, if one side has them at the places -1, 0 and 1: the join by them is exact."""
    out = []
    for q in (2, 3):
        # Both lengths of a pair that is one slip apart must be asked for with the same q by the side without shifts.
        if (q == 2 and len(s) >= LONG + (len(shifts) > 1)) or (q == 3 and len(s) < LONG - (len(shifts) > 1)):
            continue
        padded = f"^{s}$"
        grams = sorted((order.get(padded[i : i + q], 0), padded[i : i + q], i) for i in range(len(padded) - q + 1))
        last = grams[min(q, len(grams) - 1)][:2]
        out += [f"{g}{i + d}" for n, g, i in grams if (n, g) <= last for d in shifts]
    return list(dict.fromkeys(out))
