"""Passes over all texts: as few calls a word or line as their CPU budget needs, with the results of the plain definitions."""

import random
import re
import sys

import numpy as np
import pandas as pd

from foliant.llm import boost, common, glyphs, langid, ocr, pages
from foliant.llm.names import lcs_ratio

ODD = [
    "", " ", "a_b A B Zürich ² ½ Ⅷ İstanbul ΟΔΟΣ x1 2019/7 Az. 2019/77 end", "Nr. 12.50\nSum 3,5\r\nTotal\n12\nBest. 1234/5 und mehr\nA. 7", "“quoted”—dash…\x1c\x1f\u2028tail\x85end no\u00a0break",
    "Привет мир ґ 日本語 のテスト 中文", "e\u0301te\u0301 cafe\u0301 ﬁne ſs K", "1 2 3\n\n4 5", "_ __ _a_ 9_9", "Table 1   20\n 3.4 -\t5\r\n\f\n next", "\x00\x7f\x80 nul", "𝟙 𝐀 🙂 ok", "١٢ عدد 12",
]


def calls(f) -> int:
    """How many functions f calls, of Python and of C."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def prose(words: int, seed: int = 3) -> str:
    rnd = random.Random(seed)
    made = ["".join(rnd.choice("aeioubdlmnrstäé") for _ in range(rnd.randint(2, 11))) for _ in range(400)]
    return " ".join(rnd.choice(made) + rnd.choice(["", "", "", ",", "."]) + rnd.choice([" the", " and", ""]) for _ in range(words))


def test_words_as_the_pattern_finds_them():
    rnd = random.Random(5)
    for s in ODD + ["".join(rnd.choice("ab1_ -.\n\t“é中²İ") for _ in range(40)) for _ in range(500)] + [chr(c) + "a" for c in range(0x3000) if not 0xD800 <= c < 0xE000]:
        assert common.words(s) == re.findall(r"[^\W_]+", s)


def test_spoken_words():
    rows = re.compile(r"(?m)^[^\S\n]*\S{0,12}\.?(?:[^\S\n]+|$\n)?[\d.,/ \t-]*\d[\d.,/ \t-]*\r?$|\b\w{2,8}\.? \d{4}/\d+")
    word = re.compile(r"[^\W_]+")

    def plain(paragraph):
        if not re.search(r"\d", paragraph):
            return [w.lower() if len(w) > 1 or not w.isupper() else "" for w in word.findall(paragraph)]
        text = rows.sub(lambda m: " 0 " * len(word.findall(m[0])), paragraph)
        return ["" if len(w) == 1 and w.isupper() or not w.isalpha() else w.lower() for w in word.findall(text)]

    rnd = random.Random(6)
    for s in ODD + ["".join(rnd.choice(["No. ", "12", "3", "/", "2019/4", " ", "\n", "A", "für", ".", ",", "Ⅷ", "\r\n", "ab "]) for _ in range(14)) for _ in range(3000)]:
        ws, figures = langid.spelt(s)
        assert [langid.said(w, figures) for w in ws] == plain(s)


def test_verdicts_of_stretches():
    rnd = np.random.default_rng(2)
    sizes = [0, 5, 1, 0, 40, 3, 0]
    n = sum(sizes)
    path, known = rnd.integers(0, 3, n).astype(np.int8), rnd.random(n) < 0.6
    good = known & (rnd.random(n) < 0.7)
    got, a = langid._verdicts(path, known, good, sizes), 0
    for (lang, words, confidence, k), size in zip(got, sizes, strict=True):
        p, kn, g = path[a : a + size], known[a : a + size], good[a : a + size]
        a += size
        assert (words, k) == (size, kn.sum())
        assert lang == (np.bincount(p, minlength=3).argmax() if k else -1)
        assert confidence == (round(float((g & (p == lang)).sum()) / k, 4) if k else 0.0)


def test_calls_a_word_of_languages():
    text = prose(4000)
    n = len(text.split())
    model = langid.Model.fit([text])
    words, score = langid.prior()
    rows = {w: i for i, w in enumerate(words)}
    paragraphs = re.sub(r"((?:\S+ ){40})", "\\1\n\n", text)
    assert calls(lambda: langid.counted([paragraphs], rows, score)) < 2 * n  # 5 a word when each was lowered and looked up by itself
    assert calls(lambda: model.ids(text, model.rows())) < n


def test_tokens_and_compounds():
    rnd = random.Random(8)
    for s in ODD + ["".join(rnd.choice(["a", "é", "1", "@", "|", "!", "$", "-", " ", "_", "\n", "--", "ab", "“"]) for _ in range(30)) for _ in range(3000)]:
        assert ocr.tokens(s) == ocr._TOKEN.findall(s)
        assert ocr.compounds_of(s) == ocr._COMPOUND.findall(s)


def test_line_keys():
    one = str.maketrans({c: None for c in " \t\"'(),-./:;<>[]_&*#%+=?"} | {c: k[0] for k in glyphs.CLASSES for c in k})

    def plain(line):
        s = re.sub(r"(?<![^\W_])\d+(?![^\W_])", "", line.lower()).translate(one)
        return s if s.isalpha() else re.sub(r"[\W\d_]+", "", s)

    rnd = random.Random(9)
    lines = [l.replace("\n", " ") for l in ODD] + ["".join(rnd.choice(["1", "22", "x", "é", "S$", " ", "_", "Ⅷ", "²", "-", "“", "Σ", "."]) for _ in range(12)) for _ in range(3000)]
    assert glyphs.line_keys(lines) == [plain(l) for l in lines] == [glyphs.line_key(l) for l in lines]


def test_wrapped_as_word_by_word():
    def plain(text, width, hyphens, rnd):
        lines = []
        for paragraph in text.split("\n"):
            now, size = [], 0
            for w in paragraph.split():
                room = width - size - 2
                if size + len(w) + 1 <= width:
                    size += len(w) + bool(now)
                    now.append(w)
                elif hyphens and len(w) > 5 and 2 <= room <= len(w) - 2 and w.isalpha() and rnd.random() < 0.5:
                    lines.append(f"{' '.join(now)} {w[:room]}{hyphens}")
                    now, size = [w[room:]], len(w) - room
                else:
                    lines.append(" ".join(now))
                    now, size = [w], len(w)
            lines.append(" ".join(now))
        return lines

    rnd = random.Random(10)
    for k in range(3000):
        text = "".join(rnd.choice(["a", "be", "straße", "x" * rnd.randint(1, 30), "1.2"]) + rnd.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(rnd.randint(0, 40)))
        width, hyphens = rnd.randint(4, 30), rnd.choice(["", "-"])
        assert pages._wrapped(text, width, hyphens, random.Random(k)) == plain(text, width, hyphens, random.Random(k))


def test_letters_bound_common_sequences():
    rnd = random.Random(12)
    for _ in range(3000):
        a = "".join(rnd.choice("eehtiéxq漢") for _ in range(rnd.randint(2, 90)))
        b = "".join(c for c in a if rnd.random() < 0.9) + rnd.choice(["", "e" * 40])
        (x, m), (y, n) = pages._letters(a, {}), pages._letters(b, {})
        assert 2 * ((x & y).bit_count() + min(m, n)) / (len(a) + len(b)) >= lcs_ratio(a, b)


def test_furniture_is_taken_off_the_counts():
    body = ["the well-known garden was\nseen by", "another place (of which\nwe heard", "no more than twenty\nhouses stood", "nobody came late to\nthat market"]
    text = "".join(f"Annual Report\n{b}\n\f" for b in body)
    held = type("Held", (), {"value": ocr.Fitted(pages.Lines([]), set(), None, None)})
    out = pd.concat(ocr._scan(held)(iter([pd.DataFrame({"id": [1], "text": [text]})])))
    counts = ocr._counts([text.lower()])
    counts.update(dict(zip(out.a[out.kind == 2], out.n[out.kind == 2])))
    assert "header" in set(out.a[out.kind == 0])
    assert +counts == ocr._counts(body)


def test_calls_a_line_of_pages():
    text = prose(6000)
    n, page = len(text.split()), pages.split_lines("\n".join(pages._wrapped(text, 70, "-", random.Random(1))))
    assert calls(lambda: pages._wrapped(text, 70, "-", random.Random(1))) < n  # 3 when each word was measured by itself
    assert calls(lambda: pages.number_pairs(page)) < 4 * len(page.lines)


def noisy_page(rnd: random.Random) -> pages.Page:
    """A page of lines of which some repeat others, misread, with numbers or in capitals."""
    base = ["".join(rnd.choice("abcdefgh   ") for _ in range(rnd.randint(3, 60))) for _ in range(6)]

    def like(line):
        return "".join(rnd.choice("aeio12é") if rnd.random() < 0.06 else c for c in line)

    page = pages.split_lines("\n".join(rnd.choice(["", like(rnd.choice(base)), rnd.choice(base).title(), f"{rnd.choice(base)}    {rnd.randint(1, 9)}", f"- {rnd.randint(1, 5)} -"]) for _ in range(rnd.randint(1, 60))))
    for i, _, _ in pages.number_pairs(page)[::2]:
        page.kinds[i] = "pagenum"
    return page


def test_repeats_as_pair_by_pair(monkeypatch):
    """What lines repeat is the same whether pairs are compared by their letters at once, a few of them, or one by one without that bound."""
    rnd = random.Random(14)
    many = [noisy_page(rnd) for _ in range(200)]

    def plain(page):
        groups = pages._groups(page)
        like = {}
        for k in groups:
            for x in groups:
                if k != x and (k[:4] == x[:4] or k[-4:] == x[-4:]) and abs(len(k) - len(x)) <= max(2, len(k) // 8) and 2 * len(pages._trigrams(k, {}) & pages._trigrams(x, {})) + 4 >= len(pages._trigrams(k, {})) and lcs_ratio(k, x) >= 0.85:
                    like.setdefault(k, []).append((x, lcs_ratio(k, x)))
        return pages._repeats(page, groups, like)

    want = [plain(p) for p in many]
    assert sum(map(len, want)) > 500
    assert pages.repeats_all(many) == want
    assert [pages.repeats(p) for p in many] == want
    monkeypatch.setattr(pages, "PAIRS_AT_ONCE", 70)
    assert pages.repeats_all(many) == want


def test_calls_a_made_up_page():
    rnd, texts = random.Random(15), [prose(700, k) for k in range(20)]
    texts = [t + "".join(f"\nAnnual rep{rnd.choice('oc0')}rt of the house" for _ in range(6)) for t in texts]
    table = pd.DataFrame({"text": texts, "pick": range(20), "fit": 1})
    run = {}
    held = type("Texts", (), {"select": lambda self, *c: self, "mapInPandas": lambda self, f, schema: run.setdefault("f", f)})()
    ocr._learn(held, 1, 1)
    made = [pages._made_up(t, random.Random(k)) for k, t in enumerate(texts)]
    lines = sum(len(m[1]) for m in made)
    n = calls(lambda: list(run["f"](iter([table])))) - calls(lambda: [pages._made_up(t, random.Random(k)) for k, t in enumerate(texts)])
    assert n < 50 * lines, n / lines  # 97 when pairs of lines were compared one by one


def test_trees_grow_by_columns():
    """The sums over bins are those of each node, row by row."""
    rnd = np.random.default_rng(2)
    codes, y, f = rnd.integers(0, 5, (300, 3)).astype(np.uint8), rnd.integers(0, 2, 300).astype(float), rnd.normal(size=300)
    tree = [(1, 2, 1, 2, 0.0), (-1, 0, 0, 0, 0.5), (0, 1, 3, 4, 0.0), (-1, 0, 0, 0, 0.1), (-1, 0, 0, 0, 0.2)]
    at = np.array([1 if r[1] <= 2 else 3 if r[0] <= 1 else 4 for r in codes])
    assert (boost._route(tree, np.ascontiguousarray(codes.T)) == at).all() and (boost._route([tree[1]], codes.T) == 0).all()
    n, g, h = boost._sums(codes.T, y, f, tree, [1, 4], 6)
    p = 1 / (1 + np.exp(-f))
    for k, node in enumerate((1, 4)):
        for j in range(3):
            for b in range(6):
                own = (at == node) & (codes[:, j] == b)
                assert n[k, j, b] == own.sum() and np.isclose(g[k, j, b], (y - p)[own].sum()) and np.isclose(h[k, j, b], (p * (1 - p))[own].sum())
