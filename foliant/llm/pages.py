"""The lines of scanned pages: furniture (running headers, page numbers) and words broken across lines.

Three classifiers, each of boosted trees over features of a line and the lines it is paired with, are fitted on pages that are made up from clean texts:
a running header is paired with the lines it repeats, a page number with the number before and after it, a broken word with the line that goes on
(its features, from corpus counts, are in ocr.py)."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from foliant.llm.boost import Boosted
from foliant.llm.glyphs import apart, line_key, line_keys, misread
from foliant.llm.names import lcs_ratio

HYPHENS = "-­‐¬"
# Words for "page" before a page number.
PAGE_WORDS = r"(?:page|seite|p[áa]gina|p[áa]g\.?|p\.|s\.|blz\.?|bladzijde|blatt|folio)"
_NUMBER = rf"(?:{PAGE_WORDS}\s*(?P<a>\d{{1,5}})(?:\s*(?:/|of|von|de|di|sur|van)\s*\d{{1,5}})?|[-–—]\s*(?P<b>\d{{1,5}})\s*[-–—]|\[\s*(?P<c>\d{{1,5}})\s*\]|(?P<d>\d{{1,5}})\s*/\s*\d{{1,5}}|(?P<e>\d{{1,5}})|(?P<f>(?=[ivxlc])(?:xc|xl|l?x{{0,3}})(?:ix|iv|v?i{{0,3}})))"
_ALONE = re.compile(rf"^\s*{_NUMBER}\s*$", re.I)
_HEAD_THEN = re.compile(rf"^\s*(?P<text>\S.*?\S)\s{{3,}}{_NUMBER}\s*$", re.I)
_THEN_HEAD = re.compile(rf"^\s*{_NUMBER}\s{{3,}}(?P<text>\S.*\S)\s*$", re.I)
_NUMERIC = re.compile(r"\d|^\s*[ivxlc]{1,6}(?:\s|$)|\s[ivxlc]{1,6}\s*$", re.I)
#: What a roman number may begin and end with, in any case.
_ROMAN = frozenset("ivxlcIVXLC\u0130\u0131")
_FIGURE = re.compile(r"\d+")
_INTEGER = re.compile(r"(?<![^\W_])\d{1,5}(?![^\W_])")
_BULLET = re.compile(r"^\s*(?:[-*•–]\s|\d{1,3}[.)]\s)")
_STOPS, _CLOSERS = tuple(".!?:;…"), ")]\"”»’'"
FORMS = "abcdef"
_USUAL, _UNARY = "ehtioasgzdkmpruvwy", [((1 << n) - 1).to_bytes(4) for n in range(33)]
_NO_LETTER, _NO_CAPITAL = (bytes(c for c in range(128) if not own(chr(c))) for own in (str.isalpha, str.isupper))
PAIRS_AT_ONCE = 100_000
#: Texts with long lines, of which only these serve for made-up pages if there are so many.
PLAIN = 50


@dataclass
class Page:
    """What one text's lines are: kind is text, blank, header, pagenum or both."""

    lines: list[str] = field(default_factory=list)
    breaks: list[bool] = field(default_factory=list)  # a form feed stands before the line
    kinds: list[str] = field(default_factory=list)
    strips: list[str] = field(default_factory=list)  # the lines without blanks around them

    def places(self) -> list[tuple[int, int, bool, bool]]:
        """For each line: how many lines that are not blank stand before and after it on its page (between form feeds), and whether a form feed bounds the page there."""
        n = len(self.lines)
        out = [(0, 0, False, False)] * n
        starts = [i for i in range(n) if i == 0 or self.breaks[i]]
        for a, b in zip(starts, [*starts[1:], n]):
            own = [i for i in range(a, b) if self.kinds[i] != "blank"]
            for k, i in enumerate(own):
                out[i] = (k, len(own) - 1 - k, a > 0, b < n)
        return out


def split_lines(text: str) -> Page:
    """The lines of a text, all taken for text or blank."""
    page = Page()
    for n, part in enumerate(text.replace("\r\n", "\n").split("\f")):
        lines = part.split("\n")
        strips = [line.strip() for line in lines]
        page.lines += lines
        page.strips += strips
        page.breaks += [n > 0] + [False] * (len(lines) - 1)
        page.kinds += ["text" if s else "blank" for s in strips]
    return page


def _number(m: re.Match) -> tuple[int, str]:
    g = next(g for g in FORMS if m[g] is not None)
    return (_roman(m[g].lower()) if g == "f" else int(m[g])), g


def _roman(s: str) -> int:
    v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def _head(line: str) -> str | None:
    """The text beside a number on one line, some blanks apart."""
    s = line.strip()
    m = "   " in s and (_HEAD_THEN.match(s) or _THEN_HEAD.match(s))
    return m["text"] if m else None


class Lines:
    """The line classifiers. Without enough made-up pages to learn from, the plain rule holds: a header repeats and interrupts a sentence or stands at
    the edge of a page, page numbers grow by one from page to page."""

    def __init__(self, texts: list[str], seed: int = 7):
        rnd = random.Random(seed)
        heads: tuple[list, list] = ([], [])
        numbers: tuple[list, list] = ([], [])
        whole = [t for t in texts if "\f" not in t and len(t) > 400]
        plain = [t for t in whole if max(map(len, t.split("\n"))) > 110]  # not wrapped: no scans among them, with furniture of their own
        for t in plain if len(plain) >= PLAIN else whole:
            for _ in range(3):
                examples(t, rnd, heads, numbers)
        self.heads, self.numbers = (Boosted(trees=90, depth=4).fit(np.array(x), np.array(y)) if sum(y) > 20 and len(y) - sum(y) > 20 else None for x, y in (heads, numbers))

    @classmethod
    def of(cls, heads: Boosted | None, numbers: Boosted | None) -> Lines:
        """With models that are fitted elsewhere, on `examples` of all texts."""
        out = cls([])
        out.heads, out.numbers = heads, numbers
        return out

    def read(self, text: str) -> Page:
        return self.read_all([text])[0]

    def read_all(self, texts: list[str]) -> list[Page]:
        """The pages of many texts; all of their lines are scored at once."""
        pages = [split_lines(t) for t in texts]
        long = [p for p in pages if len(p.lines) >= 3]
        for page, found in self._scored(long, lambda own: map(number_pairs, own), lambda x: self.numbers.score(x) if self.numbers else x[:, 15]):
            for i in found:
                page.kinds[i] = "pagenum"
        for page, found in self._scored(long, repeats_all, lambda x: self.heads.score(x) if self.heads else (x[:, 22] + x[:, 23] > 0.5).astype(float)):
            for i in found if len(found) > 1 else ():  # a running header stands twice at least
                page.kinds[i] = "both" if page.kinds[i] == "pagenum" else "header"
            mark_counting(page)
        return pages

    @staticmethod
    def _scored(pages: list[Page], candidates: Callable, score: Callable) -> Iterator[tuple[Page, list[int]]]:
        found = [(p, f) for p, f in zip(pages, candidates(pages)) if f]
        if not found:
            return
        p = score(np.array([x for _, f in found for _, x, _ in f]))
        at = 0
        for page, f in found:
            yield page, _by_group(f, p[at : at + len(f)])
            at += len(f)


def _by_group(found: list[tuple[int, list[float], str]], p: np.ndarray) -> list[int]:
    """The lines of groups (of copies of one header, of one run of numbers) that are furniture on the whole, without members that are no such line beyond doubt."""
    groups: dict[str, list[float]] = {}
    for (_, _, g), q in zip(found, p):
        groups.setdefault(g, []).append(float(q))
    return [i for (i, _, g), q in zip(found, p) if q >= 0.1 and sum(groups[g]) >= 0.4 * len(groups[g])]


def number_pairs(page: Page) -> list[tuple[int, list[float], str]]:
    """(line, features, form) of each line that may bear a page number: of it and the number before and after it that grow by one."""
    n = len(page.lines)
    found: dict[str, list[tuple[int, int, bool]]] = {}
    # A number alone has at most 21 characters that are not blank, in five groups: a longer line has three blanks in a row or other ones.
    for i in [i for i, s in enumerate(page.strips) if s and (len(s) <= 40 or "   " in s or not s.isprintable())]:
        line, s = page.lines[i], page.strips[i]
        if page.kinds[i] != "text" or not (s[0] in _ROMAN or s[-1] in _ROMAN or _FIGURE.search(s)) or not _NUMERIC.search(line):
            continue
        if m := _ALONE.match(line):
            v, form = _number(m)
            found.setdefault(form, []).append((i, v, False))
        elif "   " in s and (m := _HEAD_THEN.match(line) or _THEN_HEAD.match(line)) and any(c.isalpha() for c in m["text"]):
            v, form = _number(m)
            found.setdefault(form, []).append((i, v, True))
    if not found:
        return []
    place = page.places()
    numeric = {x[0] for at in found.values() for x in at}
    out = []
    for form, at in found.items():
        run = _longest_run(at, page)
        where = {x[0]: k for k, x in enumerate(run)}
        gaps = [b[0] - a[0] for a, b in zip(run, run[1:])]
        mean = sum(gaps) / len(gaps) if gaps else 0.0
        spread = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean if len(gaps) > 1 else -1.0
        edges = sum(_edge(place[x[0]]) < 2 for x in run) / len(run)
        far = len(run) > 1 and all(b[0] - a[0] >= 4 or any(page.breaks[a[0] + 1 : b[0] + 1]) for a, b in zip(run, run[1:]))
        for i, v, head in at:
            inside = i in where
            p, q, before, after = place[i]
            rule = inside and len(run) >= 2 and (far or form not in "ef") or len(run) < 2 and _edge(place[i]) < 2 and form in "abcd"
            x = [
                float(inside), float(min(len(run), 8)), len(run) / len(at), float(min(gaps, default=0)), spread, float(_edge(place[i])), edges,
                float(min(i, n - 1 - i, 9)), float((i - 1 in numeric) + (i + 1 in numeric)), float(FORMS.index(form)), float(head), float(_interrupts(*_around(page, i))),
                float(min(p, 5)), float(min(q, 5)), float(before + after), float(rule), float(v < 3), float(v > 1500),
            ]
            out.append((i, x, form if inside else f"{form}{i}"))
    return out


def _edge(place: tuple[int, int, bool, bool]) -> int:
    """Lines between a line and the nearest edge of its page that a form feed marks; 9 if none is near."""
    p, q, before, after = place
    return min(p if before else 9, q if after else 9, 9)


def _longest_run(at: list[tuple[int, int, bool]], page: Page) -> list[tuple[int, int, bool]]:
    """The longest run of numbers that grow by one."""
    runs: dict[int, tuple[int, tuple | None]] = {}  # by value: length and last element, linked to the one before
    best: tuple[int, tuple | None] = (0, None)
    for x in at:
        length, before = runs.get(x[1] - 1, (0, None))
        if before and x[0] - before[0][0] < 2 and not page.breaks[x[0]]:
            length, before = 0, None
        if length + 1 > runs.get(x[1], (0, None))[0]:
            runs[x[1]] = (length + 1, (x, before))
        if runs[x[1]][0] > best[0]:
            best = runs[x[1]]
    out, node = [], best[1]
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def mark_counting(page: Page) -> None:
    """Headers with a number, the first, second or so of the line, that grows by one from page to page bear the page number too."""
    heads = [i for i, k in enumerate(page.kinds) if k in ("header", "both")]
    if any(page.kinds[i] == "both" for i in heads):
        return
    values = [[int(x) for x in _INTEGER.findall(page.lines[i])] for i in heads]
    for k in range(max(map(len, values), default=0)):
        own = [(i, v[k]) for i, v in zip(heads, values) if k < len(v)]
        if len(own) >= 2 and sum(0 < b[1] - a[1] <= 2 for a, b in zip(own, own[1:])) >= max(1, (len(own) - 1) * 0.6):
            for i, _ in own:
                page.kinds[i] = "both"
            return


def pairs(page: Page) -> list[tuple[int, list[float]]]:
    """(line, features) of each line that repeats another one."""
    return [(i, x) for i, x, _ in repeats(page)]


def repeats(page: Page) -> list[tuple[int, list[float], str]]:
    """(line, features of it and the lines that it repeats, group) for each line that repeats another one."""
    return repeats_all([page])[0]


def repeats_all(pages: list[Page]) -> list[list[tuple[int, list[float], str]]]:
    """`repeats` of many pages; all of their lines that look alike at an end are compared by their letters at once."""
    groups = [_groups(p) for p in pages]
    alike: list[dict[str, list[tuple[str, float]]]] = [{} for _ in pages]
    waiting: list[tuple[int, str, str]] = []
    for n, own in enumerate(groups):
        for k, x in _ends_alike(own):
            waiting.append((n, k, x))
            if len(waiting) >= PAIRS_AT_ONCE:
                _compare(waiting, alike)
                waiting = []
    _compare(waiting, alike)
    return [_repeats(*x) for x in zip(pages, groups, alike)]


def _groups(page: Page) -> dict[str, list[int]]:
    """The lines that may be headers, by their keys."""
    groups: dict[str, list[int]] = {}
    for i, (s, k, key) in enumerate(zip(page.strips, page.kinds, line_keys(page.strips))):
        if k == "pagenum":
            s = _head(s)
            if s is None:
                continue
            key = line_key(s)
        elif k != "text" or not s[0].isalpha() and _BULLET.match(s):
            continue
        if len(key) >= 2:
            if key in groups:
                groups[key].append(i)
            else:
                groups[key] = [i]
    return groups


def _most(n: int) -> int:
    """How many letters more or less a key may have than one of n letters that it is compared with."""
    return max(2, n // 8)


def _ends_alike(keys: dict[str, list[int]]) -> Iterator[tuple[str, str]]:
    """The pairs of keys that look alike at either end and are of like length, each once."""
    heads, tails = _shared(keys, slice(4)), _shared(keys, slice(-4, None))
    for k in dict.fromkeys(x for ends in (heads, tails) for by in ends.values() for xs in by.values() for x in xs):
        n = len(k)
        most = _most(n)
        near = {x for by in (heads.get(k[:4]), tails.get(k[-4:])) if by for m, xs in by.items() if abs(m - n) <= most for x in xs}
        for x in near:
            if k < x or k != x and abs(len(x) - n) > _most(len(x)):  # else x meets k
                yield k, x


def _compare(pairs: list[tuple[int, str, str]], alike: list[dict[str, list[tuple[str, float]]]]) -> None:
    """Adds the keys, of the pages by their numbers, that are the same but for a few letters."""
    grams: dict[str, set[str]] = {}
    for (n, k, x), enough in zip(pairs, _in_common(pairs)):
        if not enough:
            continue
        both, r = 2 * len(_trigrams(k, grams) & _trigrams(x, grams)) + 4, None
        for a, b in ((k, x), (x, k)):
            if abs(len(a) - len(b)) <= _most(len(a)) and both >= len(grams[a]):
                r = _ratio(k, x) if r is None else r
                if r >= 0.85:
                    alike[n].setdefault(a, []).append((b, r))


def _ratio(a: str, b: str) -> float:
    """`lcs_ratio` of keys that may be long and differ in little."""
    c, d = apart(a, b)
    return 2 * (len(a) - len(c) + round(lcs_ratio(c, d) * (len(c) + len(d)) / 2)) / (len(a) + len(b))


def _in_common(pairs: list[tuple[int, str, str]]) -> list[bool]:
    """May the keys of each pair have a common sequence of 0.85 of their letters? Not if they don't have so many letters in common."""
    if len(pairs) < 50:
        seen: dict[str, tuple[int, int]] = {}
        letters = [(_letters(k, seen), _letters(x, seen), len(k) + len(x)) for _, k, x in pairs]
        return [2 * ((a & b).bit_count() + min(m, n)) / both >= 0.85 for (a, m), (b, n), both in letters]
    at: dict[str, int] = {}
    one = np.array([at.setdefault(k, len(at)) for _, k, _ in pairs])
    two = np.array([at.setdefault(x, len(at)) for _, _, x in pairs])
    size = np.array(list(map(len, at)))
    codes = np.frombuffer("".join(at).encode("utf-32-le", "surrogatepass"), np.uint32) & 31  # letters that share a code only add to what is in common
    counts = np.bincount(np.repeat(np.arange(len(size)) * 32, size) + codes, minlength=32 * len(size)).reshape(-1, 32).astype(np.int32)
    return (2 * np.minimum(counts[one], counts[two]).sum(1) / (size[one] + size[two]) >= 0.85).tolist()


def _repeats(page: Page, groups: dict[str, list[int]], alike: dict[str, list[tuple[str, float]]]) -> list[tuple[int, list[float], str]]:
    """alike: the keys that are like a key, with the ratios."""
    n, out, of_line = len(page.lines), [], {}
    found = [(k, own) for k, own in groups.items() if len(own) > 1 or k in alike]
    if not found:
        return []
    lens = sorted([len(line.rstrip()) for line, k in zip(page.lines, page.kinds) if k != "blank"])
    if len(lens) < 3:
        return []
    width = max(lens[int(0.9 * (len(lens) - 1))], 20)
    place, feeds, numbers = page.places(), sum(page.breaks), {i for i, k in enumerate(page.kinds) if k == "pagenum"}
    for k, own in found:
        like = [k, *(x for x, _ in alike.get(k, ()))]
        ratio = 1.0 if len(own) > 1 else max(r for _, r in alike[k])
        copies = sorted(i for x in like for i in groups[x])
        for i in copies:
            if i not in of_line:
                before, after = _around(page, i)
                of_line[i] = before, after, _interrupts(before, after), _FIGURE.findall(page.lines[i]), not numbers.isdisjoint(range(i - 2, i + 3)), _edge(place[i]) < 2
        gaps = [b - a for a, b in zip(copies, copies[1:])]
        mean = sum(gaps) / len(gaps)
        spread = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean if len(gaps) > 1 else -1.0
        _, _, splits, figures, numbered, edge = zip(*[of_line[i] for i in copies])
        same, counts = 1.0, 0.0
        if any(figures):
            same = sum(a == b for a, b in zip(figures, figures[1:])) / len(gaps)  # tables repeat words with other figures
            counts = sum(len(a) == len(b) > 0 and sum(x != y for x, y in zip(a, b)) == 1 and any(int(y) - int(x) in (1, 2) for x, y in zip(a, b) if x.isdecimal() and y.isdecimal()) for a, b in zip(figures, figures[1:])) / len(gaps)
        of_group = [same, counts, float(min(len(copies) - 1, 8)), float(min(gaps)), mean / n, spread, sum(edge) / len(copies), sum(splits) / len(copies), sum(numbered) / len(copies), len(copies) / (feeds + 1) if feeds else -1.0]
        for i in own:
            out.append((i, _features(page, i, width, ratio, place[i], *of_line[i][:2]) + of_group, min(like)))
    return out


def _shared(keys: dict[str, list[int]], end: slice) -> dict[str, dict[int, list[str]]]:
    """The keys with one end in common, by their lengths; ends of a single key are left out."""
    ends = [k[end] for k in keys]
    if len(last := dict(zip(ends, keys))) == len(ends):
        return {}
    out: dict[str, dict[int, list[str]]] = {e: {} for e, k in zip(ends, keys) if last[e] is not k}
    for k, e in zip(keys, ends):
        if e in out:
            out[e].setdefault(len(k), []).append(k)
    return out


def _letters(k: str, known: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """How often each of the usual letters stands in the key, as so many bits of a number, and how many other characters (or letters beyond 32) it has."""
    if k not in known:
        n = [k.count(c) for c in _USUAL]
        bits = int.from_bytes(b"".join([_UNARY[min(x, 32)] for x in n]))
        known[k] = bits, len(k) - bits.bit_count()
    return known[k]


def _trigrams(k: str, known: dict[str, set[str]]) -> set[str]:
    if k not in known:
        known[k] = {k[i : i + 3] for i in range(max(1, len(k) - 2))}
    return known[k]


def _around(page: Page, i: int) -> tuple[str, str]:
    """The lines of text before and after a line, on whichever page."""
    kinds, n, a, b = page.kinds, len(page.kinds), i - 1, i + 1
    while a >= 0 and kinds[a] != "text":
        a -= 1
    while b < n and kinds[b] != "text":
        b += 1
    return page.strips[a] if a >= 0 else "", page.strips[b] if b < n else ""


def _ends(s: str) -> bool:
    """Does a line without blanks around it end a sentence?"""
    return s.rstrip(_CLOSERS)[-1:] in _STOPS


def _interrupts(before: str, after: str) -> bool:
    """Does a line between these two stand in the middle of a sentence?"""
    return bool(before) and bool(after) and (after[0].islower() or before[-1] in HYPHENS) and not _ends(before)


def _features(page: Page, i: int, width: int, ratio: float, place: tuple[int, int, bool, bool], before: str, after: str) -> list[float]:
    n = len(page.lines)
    s = page.strips[i]
    broken = bool(before) and not _ends(before)
    letters, capitals = _cases(s)
    edge = _edge(place)
    return [
        ratio, min(len(s) / width, 1.2), float(page.kinds[i] == "pagenum"), float(_interrupts(before, after)), float(broken), float(edge < 2), float(edge),
        capitals / max(1, letters), float(_ends(s)), float(s[-1:] in ".,;!?"), float((i == 0 or not page.strips[i - 1]) + (i + 1 == n or not page.strips[i + 1])),
        float(min(place[0], 4)), float(min(place[1], 4)), float(s[:1].islower()), float(min(len(s.split()), 15)), float(any(map(str.isdigit, s))),
    ]


def _cases(s: str) -> tuple[int, int]:
    """How many letters and how many capitals a line has."""
    if s.isascii():
        b = s.encode()
        return len(b.translate(None, _NO_LETTER)), len(b.translate(None, _NO_CAPITAL))
    letters = list(filter(str.isalpha, s))
    return len(letters), sum(map(str.isupper, letters))


# ---- made-up pages ----


def examples(text: str, rnd: random.Random, heads: tuple[list, list], numbers: tuple[list, list]) -> None:
    """Adds the features and the classes of the lines of a page made up from the text that may be headers and page numbers."""
    examples_all([(text, rnd)], heads, numbers)


def examples_all(texts: Iterable[tuple[str, random.Random]], heads: tuple[list, list], numbers: tuple[list, list]) -> list[tuple[int, int]]:
    """`examples` of many texts; how many rows of headers and of page numbers each one adds."""
    made = [_made_up(text, rnd) for text, rnd in texts]
    pages, own = [split_lines(m[0]) for m in made if m], [m[1] for m in made if m]
    found = []
    for page, kinds in zip(pages, own):
        found.append(number_pairs(page))
        for i, k in enumerate(kinds):
            if k in ("pagenum", "both"):
                page.kinds[i] = "pagenum"
    ready, added = iter(zip(own, repeats_all(pages), found)), []
    for m in made:
        kinds, repeated, counted = next(ready) if m else ((), (), ())
        for rows, got, names in ((heads, repeated, ("header", "both")), (numbers, counted, ("pagenum", "both"))):
            rows[0].extend([x for _, x, _ in got])
            rows[1].extend([kinds[i] in names for i, _, _ in got])
        added.append((len(repeated), len(counted)))
    return added


def _wrapped(text: str, width: int, hyphens: str, rnd: random.Random) -> list[str]:
    """The lines of a text that is wrapped at a width; with a mark, words are broken."""
    lines: list[str] = []
    for paragraph in text.split("\n"):
        s = paragraph.strip(" ") if "  " not in paragraph and paragraph.isprintable() else " ".join(paragraph.split())
        if s.find(" ", 0, width) < 0 and len(s) >= width:  # a first word without room leaves an empty line before it
            s = f" {s}"
        at = 0
        while len(s) - at > width or s[at : at + 1] == " ":
            end = at if s[at] == " " else s.rfind(" ", at, at + width + 1)
            if end < 0 and (end := s.find(" ", at)) < 0:
                break
            w, room = "", width - (end - at) - 2
            if hyphens and room >= 2:
                w = s[end + 1 : (s.find(" ", end + 1) + 1 or len(s) + 1) - 1]
            if len(w) > 5 and room <= len(w) - 2 and w.isalpha() and rnd.random() < 0.5:
                lines.append(s[at : end + 1 + room] + hyphens)
                at = end + 1 + room
            else:
                lines.append(s[at:end])
                at = end + 1
        lines.append(s[at:])
    return lines


def _heads(words: list[str], rnd: random.Random) -> list[str]:
    """One or two running headers from the words of a text."""

    def phrase(least: int, most: int) -> str:
        k = rnd.randrange(max(1, len(words) - most))
        return " ".join(words[k : k + rnd.randint(least, most)]).strip(".,;:!?")

    def name() -> str:
        return rnd.choice(words).strip(".,;:!?()").title()

    one = rnd.choice([lambda: phrase(1, 3), lambda: phrase(2, 6), lambda: phrase(4, 9), lambda: phrase(9, 25), lambda: f"{name()} & {name()} - {phrase(2, 7)}", lambda: f"{name()} {rnd.randint(1900, 2030)}", lambda: f"{phrase(1, 4)} ({rnd.randint(1900, 2030)})", lambda: f"{name()}: {phrase(2, 5)}", lambda: f"{name()} {rnd.choice(['& Co.', '& Sons', 'Archive', 'Ltd.'])}", lambda: f"{phrase(1, 4)} no. {rnd.randint(1, 999)}"])
    out = [one() for _ in range(rnd.choice([1, 1, 1, 2]))]
    style = rnd.random()
    out = [h.upper() if style < 0.2 else h.title() if style < 0.4 else h[:1].upper() + h[1:] for h in out if h]
    return out


def _made_up(text: str, rnd: random.Random) -> tuple[str, list[str]] | None:
    """A scanned text made up from a clean one (wrapped, cut into pages, with headers and page numbers or none, and with lines that only look like
    them), and the kinds of its lines."""
    words = text.split()
    if len(words) < 60 or "\f" in text:
        return None
    width = rnd.randint(46, 100)
    parts = text.split("\n")
    if rnd.random() < 0.3:  # a heading, a closing or a paragraph may stand again and again, between paragraphs
        again = rnd.choice([" ".join(words[:k]) + rnd.choice(["", "", ":", "."]) for k in (1, 2, 4)] + [x for x in parts if x.strip()][:3])
        for _ in range(rnd.randint(2, 5)):
            k = rnd.randrange(len(parts) + 1)
            parts[k:k] = ["", again, ""] if rnd.random() < 0.7 else [again]
    if rnd.random() < 0.2:  # rows with a word in common
        row = rnd.choice(["Total  {}", "Sum {}", f"{rnd.choice(words)}    {{}}", "{} EUR", f"No. {{}} {rnd.choice(words)}"])
        k = rnd.randrange(len(parts) + 1)
        parts[k:k] = [row.format(f"{rnd.randint(1, 900)}{rnd.choice(['', ',50', '.25'])}") for _ in range(rnd.randint(2, 7))]
    lines = [(l, "text") for l in _wrapped("\n".join(parts), width, rnd.choice(["", "", "-", *HYPHENS]), rnd)]
    looks = rnd.random()
    if looks < 0.12:  # a table of figures, perhaps counting
        first, step = rnd.randint(1, 2020), rnd.choice([1, 1, 0, 7])
        k = rnd.randrange(len(lines))
        lines[k:k] = [(str(first + j * step if step else rnd.randint(1, 999)), "text") for j in range(rnd.randint(3, 9))]
    elif looks < 0.24:  # numbered parts, a year, a reference
        form = rnd.choice(["{}", "{}.", "({})", "{}", "[{}]"])
        first = rnd.choice([1, 1, rnd.randint(2, 2020)])
        for j in range(rnd.randint(1, 4)):
            k = rnd.randrange(len(lines))
            lines.insert(k, (form.format(first + j if rnd.random() < 0.4 else rnd.randint(1, 2020)), "text"))
    per = rnd.randint(8, 45)
    body = [lines[p : p + per] for p in range(0, len(lines), per)]
    heads = _heads(words, rnd) if rnd.random() < 0.7 and len(body) > 1 else []
    numbers = rnd.random() < 0.6 and len(body) > 1
    first = rnd.choice([1, rnd.randint(1, 40), rnd.randint(1, 400)])
    form = rnd.choice(["{}", "{}", "- {} -", "[{}]", "Page {}", "page {}", "{} / 99", "p. {}"])
    feed = rnd.choice(["", "", "\f", "\f", "\n\f", "\f\n", "\n\f\n"])
    foot_head, foot_num, one_line, blank = (rnd.random() < x for x in (0.4, 0.5, 0.3, 0.3))
    late, noisy = rnd.random() < 0.25, rnd.random() < 0.4
    parts: list[list[tuple[str, str]]] = []
    for p, b in enumerate(body):
        head = heads[p % len(heads)] if heads and not (late and p == 0) else ""
        if head and noisy and rnd.random() < 0.4:
            head = misread(head, rnd) or head
        num = form.format(first + p) if numbers else ""
        above, below = [], []
        if head and num and one_line:
            (below if foot_head else above).append((f"{head}{' ' * rnd.randint(4, 20)}{num}" if p % 2 or rnd.random() < 0.7 else f"{num}{' ' * rnd.randint(4, 20)}{head}", "both"))
        else:
            if head:
                (below if foot_head else above).append((head, "header"))
            if num:
                (below if foot_num else above).append((" " * rnd.choice([0, 0, 20]) + num, "pagenum"))
        if blank:
            above, below = above + [("", "blank")] * bool(above), [("", "blank")] * bool(below) + below
        parts.append([*above, *b, *below])
    out, kinds = "", []
    for p, part in enumerate(parts):
        kinds += [k if l.strip() else "blank" for l, k in part]
        out += "\n".join(l for l, _ in part)
        if p + 1 < len(parts):
            if feed:
                kinds += ["blank"] * feed.count("\n")
                out += feed
            else:
                out += "\n"
    return out, kinds


def body(page: Page) -> list[str]:
    """The lines of running text."""
    return [l for l, k in zip(page.lines, page.kinds) if k == "text"]


_MARKS = tuple(HYPHENS)
_LEFT = re.compile(r"([^\W\d_]+)([-­‐¬])[ \t]*$")
_RIGHT = re.compile(r"[ \t]*([^\W\d_]+)")


def breaks(lines: list[str]) -> list[tuple[int, str, str, str]]:
    """(line, left part, mark, right part) of the words broken at the ends of lines of running text."""
    out = []
    for i, (a, b) in enumerate(zip(lines, lines[1:])):
        if (s := a.rstrip(" \t"))[-1:] in _MARKS and (r := _RIGHT.match(b)):
            k = len(s) - 1
            while k and s[k - 1].isalpha():
                k -= 1
            if k < len(s) - 1:
                out.append((i, s[k:-1], s[-1], r[1]))
    return out
