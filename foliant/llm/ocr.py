"""Noise in text from scanned pages: words hyphenated across lines, misrecognised characters, running headers, page numbers.

A first pass over all texts counts words and makes up pages to learn from. A second one splits each text into lines, marks furniture (pages.py: line-pair
classifiers find headers and page numbers) and puts out, beside the document's kinds, its broken words, the counts of the words of its furniture, which are taken off the first ones, and those of its words that the first counts do not vouch for. From there on everything
is a join of shuffled tables:

- a correction differs from the doubtful word by look-alikes and at most one more slip, and is several times as frequent in the corpus; candidates come from
  an inverted join of doubtful words and the vocabulary by q-grams of what is left if look-alikes are one character (glyphs.py: the rarest q-grams
  suffice, exactly); gradient-boosted trees rank them, and the best one is taken if it is likely enough;
- broken words are asked for as a whole, too, so that a misread one is still joined;
- a line-pair classifier joins a broken word, or keeps the mark of a compound broken at its own hyphen, by how often the corpus has the word joined, as a compound and in parts.

The trees and the classifiers are fitted on all texts and all words, in which errors and furniture are planted: every clean text is cut into pages, all words that are
frequent enough to correct others are misread by the usual confusions, all words are broken. The rows to learn from are tables; `fit_rows` (boost.py) uses every one of them.

Defined results: null and empty texts and texts without letters have no noise and stay as they are; rows of one id count once (noise of any of them; the first text is repaired); ties between corrections go to the more frequent, then to the first in
order.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.boost import PACKED, Boosted, fit_rows, packed
from foliant.llm.common import in_batches, words
from foliant.llm.glyphs import distance, gram_keys, misread, skeleton
from foliant.llm.names import lcs_ratio
from foliant.llm.pages import HYPHENS, PLAIN, Lines, Page, body, breaks, examples_all, split_lines
from foliant.session import stored

#: Made-up pages: one of every text, up to three while there are fewer than so many.
PAGES = 4500
#: A correction is this many times as frequent as the word it replaces, seen so often at least, and this likely.
TIMES, LEAST_SEEN, LIKELY = 5, 8, 0.5
#: The same for a word that is seen more than FEW times.
TIMES_MORE, FEW = 25, 3
#: A word seen LEAST_SEEN times, and so often a text, without a look-alike more frequent than RIVAL times, is not doubted.
VOUCHED, RIVAL = LEAST_SEEN / 1500, 3
#: The order of the inverted join knows so many q-grams, the most frequent ones; others come first in it. Its result does not depend on the order.
GRAMS = 100_000

_TOKEN = re.compile(r"(?:[@|!](?=[^\W\d_]))?[^\W_]++(?:[@|!$][^\W_]++)*+")
_JOINED = re.compile(r"[@|!$][^\W_]")
_COMPOUND = re.compile(r"\b[^\W\d_]++-[^\W\d_]+")
_HYPHENED = re.compile(r"-[^\W\d_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Made-up pages of so many characters are compared at once.
AT_ONCE = 1_000_000
_ODD = re.compile(r"[\d@|!$]")


def features(w: str, c: str, times: float) -> list[float]:
    """Of a doubtful word and a candidate that is `times` as frequent."""
    sw, sc = skeleton(w), skeleton(c)
    return [
        float(sw == sc), lcs_ratio(w, c), lcs_ratio(sw, sc), float(bool(_ODD.search(w))), float(np.log(times)), float(len(c)), float(len(w) - len(c)),
        float(w[0] == c[0]), float(w[-1] == c[-1]), float(distance(w, c)), float(distance(sw, sc)),
    ]


def tokens(low: str) -> list[str]:
    """What `_TOKEN` finds in a text; where no mark stands before a letter or digit, these are its words."""
    return _TOKEN.findall(low) if any(c in low for c in "!|@$") and _JOINED.search(low) else words(low)


def compounds_of(low: str) -> list[str]:
    """What `_COMPOUND` finds in a text, looked for where hyphens are."""
    out, end = [], 0
    for m in _HYPHENED.finditer(low) if "-" in low else ():
        at = i = m.start()
        while i > end and (c := low[i - 1]).isalnum() and not c.isdecimal():
            i -= 1
        if i < at and not (i and ((c := low[i - 1]).isalnum() or c == "_")):
            end = m.end()
            out.append(low[i:end])
    return out


def doubtful(w: str) -> bool:
    """Is the token a word that may be misread: letters, perhaps with odd characters between, and no code?"""
    return len(w) >= 3 and (w.isalpha() or any(map(str.isalpha, w)) and sum(map(str.isdigit, w)) <= max(1, len(w) // 4))


class Fitted:
    """The models of the passes: the line classifiers, the ranking, the joining, and the words that all texts vouch for."""

    def __init__(self, lines: Lines, vouched: set[str], rank: Boosted | None, joins: Boosted | None):
        self.lines, self.vouched, self.rank, self.joins = lines, vouched, rank, joins


def join_features(left: str, right: str, mark: str, n: tuple[float, float, float, float]) -> list[float]:
    """Of a broken word, from the counts of the joined word, of the compound, of the left and the right part."""
    joined, compound, a, b = (float(np.log1p(max(0.0, x))) for x in n)
    return [joined, compound, joined - compound, min(a, b), max(a, b), min(a, b) - joined, float(mark in "\u00ad¬"), float(min(len(left), 12)), float(min(len(right), 12)), float(n[0] <= 0), float(n[1] <= 0)]


def _broken(word: str) -> tuple[str, str]:
    """The word in two, at a place that depends on nothing else."""
    k = random.Random(word).randint(2, len(word) - 2)
    return word[:k], word[k:]


def _join_rows(left: str, right: str, own: tuple[int, ...], y: int, rnd: random.Random, xs: list, ys: list) -> None:
    """Rows to learn joining from. All counts are thinned at random, so that words and compounds stand for rarer ones, too."""
    for share in (1.0, rnd.random(), rnd.random() ** 3):
        n = tuple(float(np.floor(x * share + rnd.random())) - (i == 1 - y) for i, x in enumerate(own))  # the occurrence itself does not count
        xs.append(join_features(left, right, rnd.choice(HYPHENS) if y else rnd.choice("-‐"), n))
        ys.append(y)


def _join_model(texts: list[str], counts: Counter, rnd: random.Random) -> Boosted | None:
    """Learned from words that are broken anywhere and compounds that are broken at their hyphen, of texts that are at hand; `_joining` is the same for tables."""
    compounds = Counter(c for t in texts for c in _COMPOUND.findall(t.lower()))
    words = sorted(w for w, n in counts.items() if w.isalpha() and len(w) > 4)
    broken = [(*_broken(w), 1) for w in words]
    broken += [(*c.split("-", 1), 0) for c in sorted(compounds) for _ in range(min(compounds[c], _times(len(words), len(compounds))))]
    xs, ys = [], []
    for left, right, y in broken:
        _join_rows(left, right, (counts[left + right], compounds[f"{left}-{right}"], counts[left], counts[right]), y, rnd, xs, ys)
    return Boosted(trees=60, depth=4).fit(np.array(xs), np.array(ys)) if min(sum(ys), len(ys) - sum(ys)) > 20 else None


def _times(words: int, compounds: int) -> int:
    """How often a compound is taken at most, so that compounds, which are few, weigh up to two fifths of the words, or 600."""
    return max(2, max(600, 2 * words // 5) // max(1, compounds))


def _joining(counts: DataFrame) -> Boosted | None:
    words = counts.filter(F.col("word").rlike(r"^[\p{L}]{5,}$"))
    compounds = counts.filter(F.col("word").contains("-"))
    most = _times(words.count(), compounds.count())

    def halves(b: pd.DataFrame) -> pd.DataFrame:
        out = [(*w.split("-", 1), 0, min(int(n), most)) if "-" in w else (*_broken(w), 1, 1) for w, n in zip(b.word, b.n)]
        return pd.DataFrame(out, columns=["left", "right", "y", "times"])

    forms = in_batches(words.unionByName(compounds), halves, "left string, right string, y int, times long")
    known = _known(forms, counts, ["left", "right", "y", "times"])

    def run(b: pd.DataFrame) -> pd.DataFrame:
        parts, xs, ys = [], [], []
        for left, right, y, times, *own in zip(b.left, b.right, b.y, b.times, b.n0, b.n1, b.n2, b.n3):
            rnd = random.Random(f"{left} {right} {y}")
            for _ in range(times):
                _join_rows(left, right, tuple(own), y, rnd, xs, ys)
            parts += [rnd.randrange(1 << 20) for _ in range(len(ys) - len(parts))]
        return pd.DataFrame([packed(parts, ys, xs)], columns=["part", "y", "x"])

    return fit_rows(stored(in_batches(known, run, PACKED), "joins"), 60, 4)


def _ranking(counts: DataFrame, order) -> Boosted | None:
    """Learned from all words that may correct others, misread, against the candidates that the inverted join finds beside them, and from words of their own, rarer than a neighbour."""
    vocab = _vocabulary(counts)

    def plant(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for w, n in zip(b.word, b.n):
            rnd = random.Random(w)
            times = _more(rnd, n)
            out.append((w, None, times))
            out += [(m, w, times) for m in sorted({misread(w, rnd) for _ in range(4)} - {None})]
        return pd.DataFrame(out, columns=["w", "target", "times"])

    planted = in_batches(vocab, plant, "w string, target string, times double")
    planted = stored(planted.join(vocab.select(F.col("word").alias("w"), F.lit(True).alias("own")).hint("merge"), "w", "left").filter("own is null or target is null").drop("own"), "planted")
    mine = _keyed(planted.select(F.col("w").alias("word"), F.lit(0).cast("long").alias("n")).distinct(), order, (0,)).select(F.col("word").alias("w"), F.col("form").alias("fw"), "g")
    lists = _keyed(vocab, order, (-1, 0, 1)).withColumnsRenamed({"n": "nc", "form": "fc"})
    met = mine.join(lists.hint("merge"), "g").filter((F.col("w") != F.col("word")) & _one_slip("fw", "fc")).select("w", "word", "nc").dropDuplicates()

    def alike(b: pd.DataFrame) -> pd.DataFrame:
        return b.assign(p=[lcs_ratio(w, c) for w, c in zip(b.w, b.word)])

    near = in_batches(met, alike, "w string, word string, nc long, p double")
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("p"), "word"))).filter("k <= 3")
    wrong = planted.join(near.hint("merge"), "w").filter("target is null or word != target").select("w", "target", F.col("word").alias("c"), "times", "nc", F.lit(0).alias("y"))
    right = planted.filter("target is not null").select("w", "target", F.col("target").alias("c"), "times", F.lit(None).cast("long").alias("nc"), F.lit(1).alias("y"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        parts, xs, ys = [], [], []
        for w, target, c, times, nc, y in zip(b.w, b.target, b.c, b.times, b.nc, b.y):
            rnd = random.Random(f"{w} {c} {target}")
            xs.append(features(w, c, times if isinstance(target, str) else _more(rnd, nc)))
            ys.append(y)
            parts.append(rnd.randrange(1 << 20))
        return pd.DataFrame([packed(parts, ys, xs)], columns=["part", "y", "x"])

    return fit_rows(stored(in_batches(right.unionByName(wrong), run, PACKED), "ranks"), 80, 4, (0, 21))


def _more(rnd: random.Random, n: float) -> float:
    """How many times as frequent as the word that it replaces a word is that is seen n times: at random between TIMES and n."""
    return float(np.exp(rnd.uniform(np.log(TIMES), np.log(max(TIMES + 1, n)))))


_SCHEMA = "kind int, id long, a string, b string, n long"


#: A letter for each kind of line.
_CODES = {"text": "t", "blank": "b", "header": "h", "pagenum": "n", "both": "2"}
_KINDS = {c: k for k, c in _CODES.items()}


def _counts(lows: list[str]) -> Counter:
    """How often words and compounds stand in texts in lower case. None goes beyond a line, so those of a text are those of its lines."""
    out = Counter()
    for low in lows:
        out.update(tokens(low))
        out.update(compounds_of(low))
    return out


def _scan(fitted, kept: bool = False) -> callable:
    """kept: put out the kinds of each text's lines, too."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = fitted.value
        vouched = m.vouched
        for b in batches:
            rows, gone = [], []
            own = [(i, t) for i, t in zip(b.id, b.text) if isinstance(t, str) and any(c.isalpha() for c in t)]
            for (i, t), page in zip(own, m.lines.read_all([t for _, t in own])):
                kinds = set(page.kinds)
                if kept:
                    rows.append((5, i, "".join(map(_CODES.get, page.kinds)), None, 0))
                if kinds & {"header", "both"}:
                    rows.append((0, i, "header", None, 0))
                if kinds & {"pagenum", "both"}:
                    rows.append((0, i, "pagenum", None, 0))
                lines = [l for l in body(page) if l.strip()]
                cut = breaks(lines)
                for at, left, mark, right in cut:
                    rows.append((1, i, left.lower() + "\n" + right.lower(), mark, at))
                    if doubtful(whole := (left + right).lower()) and whole not in vouched:
                        rows.append((4, i, whole, None, 0))
                gone += [l for l, k in zip(page.lines, page.kinds) if k not in ("text", "blank")]
                ws = tokens("\n".join(lines).lower())
                parts = {x.lower() for c in cut for x in (c[1], c[3])}
                rows += [(3, i, w, None, 0) for w in set(ws) - vouched - parts if doubtful(w)]
            yield pd.DataFrame(rows, columns=["kind", "id", "a", "b", "n"])
            if counts := _counts(["\n".join(gone).lower()]):
                yield pd.DataFrame({"kind": 2, "id": 0, "a": list(counts), "b": None, "n": [-n for n in counts.values()]})

    return run


def _vocabulary(counts: DataFrame) -> DataFrame:
    """The words that may correct others."""
    return counts.filter((F.col("n") >= LEAST_SEEN) & F.col("word").rlike(r"^[\p{L}]{3,}$"))


def _one_slip(a: str, b: str) -> Column:
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) >= 0)


def _keyed(words: DataFrame, held, shifts: tuple[int, ...]) -> DataFrame:
    """word, n, form (its skeleton), g: a row for each of its keys."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        order = held.value
        rows = [(w, n, s, g) for w, n in zip(b.word, b.n) for s in [skeleton(w)] for g in gram_keys(s, order, shifts)]
        return pd.DataFrame(rows, columns=["word", "n", "form", "g"])

    return in_batches(words.select("word", "n"), run, "word string, n long, form string, g string")


def corrections(scan: DataFrame, counts: DataFrame, held, order) -> DataFrame:
    """word, better, p: the accepted corrections, from the inverted join of doubtful and frequent words by the q-grams of their skeletons."""
    asked = scan.filter("kind in (3, 4)").select(F.col("a").alias("word")).distinct().join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    asked = asked.filter((F.length("word") >= 3) & F.col("word").rlike(r"[\p{L}]"))
    mine = _keyed(asked, order, (0,)).withColumnsRenamed({"word": "w", "form": "fw"})
    lists = _keyed(_vocabulary(counts), order, (-1, 0, 1)).withColumnsRenamed({"n": "nc", "form": "fc"})
    times = F.when(F.col("n") > FEW, TIMES_MORE).otherwise(TIMES)
    met = mine.join(lists, "g").filter((F.abs(F.length("fw") - F.length("fc")) <= 1) & (F.col("nc") >= times * F.col("n")) & (F.abs(F.length("w") - F.length("word")) <= 3) & (F.col("w") != F.col("word")))
    met = met.filter(_one_slip("fw", "fc")).select("w", "word", "n", "nc").dropDuplicates()

    def run(b: pd.DataFrame) -> pd.DataFrame:
        keep, xs = [], []
        for i, (w, c, nw, nc) in enumerate(zip(b.w, b.word, b.n, b.nc)):
            if lcs_ratio(w, c) >= 0.5:
                keep.append(i)
                xs.append(features(w, c, nc / max(1, nw)))
        m = held.value.rank
        p = m.score(np.array(xs)) if xs and m else np.zeros(len(xs))
        return pd.DataFrame({"w": b.w.iloc[keep], "word": b.word.iloc[keep], "nc": b.nc.iloc[keep], "p": p})

    scored = in_batches(met, run, "w string, word string, nc long, p double").filter(F.col("p") >= LIKELY)
    best = scored.groupBy("w").agg(F.max(F.struct(F.round("p", 1).alias("r"), "nc", "word", "p")).alias("x"))
    return best.select(F.col("w").alias("word"), F.col("x.word").alias("better"), F.col("x.p").alias("p"))


def _known(forms: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """The broken words with the counts n0 to n3 of the joined word, of the compound, of the left and the right part."""
    keys = F.array(F.struct(F.lit(0).alias("f"), F.concat("left", "right").alias("word")), F.struct(F.lit(1).alias("f"), F.concat_ws("-", "left", "right").alias("word")), F.struct(F.lit(2).alias("f"), F.col("left").alias("word")), F.struct(F.lit(3).alias("f"), F.col("right").alias("word")))
    known = forms.select(*by, F.explode(keys).alias("x")).select(*by, "x.*").join(counts.hint("merge"), "word", "left")
    n = [F.coalesce(F.sum(F.when(F.col("f") == f, F.col("n"))), F.lit(0)).alias(f"n{f}") for f in range(4)]
    return known.groupBy(*by).agg(*n)


def joins(scan: DataFrame, counts: DataFrame, fixes: DataFrame, held) -> DataFrame:
    """id, left, right, joined (boolean) of the broken words. One that has a correction as a whole is joined, too."""
    pair = scan.filter("kind = 1").select("id", F.split_part("a", F.lit("\n"), F.lit(1)).alias("left"), F.split_part("a", F.lit("\n"), F.lit(2)).alias("right"), F.col("b").alias("mark"))
    forms = pair.select("left", "right", "mark").distinct()
    known = _known(forms, counts, ["left", "right", "mark"])

    def run(b: pd.DataFrame) -> pd.DataFrame:
        m = held.value.joins
        if m:
            x = [join_features(*row[:3], row[3:]) for row in zip(b.left, b.right, b["mark"], b.n0, b.n1, b.n2, b.n3)]
            joined = m.score(np.array(x)) >= 0.5
        else:  # the texts have no compounds to learn from
            joined = (b.n0 > b.n1) | ((b.n1 == 0) & ~((b.n2 >= LEAST_SEEN) & (b.n3 >= LEAST_SEEN)))
        return pd.DataFrame({"left": b.left, "right": b.right, "mark": b["mark"], "joined": joined})

    decided = in_batches(known, run, "left string, right string, mark string, joined boolean")
    wrong = fixes.select(F.col("word").alias("whole"), F.lit(True).alias("wrong"))
    decided = decided.withColumn("whole", F.concat("left", "right")).join(wrong, "whole", "left")
    return pair.join(decided, ["left", "right", "mark"]).select("id", "left", "right", (F.col("joined") | F.coalesce("wrong", F.lit(False))).alias("joined"))


_LEARNED = f"kind int, a string, n long, {PACKED}"


def _chunks(texts: list[tuple[str, int]]) -> Iterator[list[tuple[str, int]]]:
    """The texts in parts of about AT_ONCE characters."""
    out, size = [], 0
    for x in texts:
        out.append(x)
        size += len(x[0])
        if size >= AT_ONCE:
            yield out
            out, size = [], 0
    if out:
        yield out


def _learn(texts: DataFrame, least: int, times: int) -> DataFrame:
    """One pass over all texts: the counts of their words (kind 2), and packed rows of headers (0) and page numbers (1) of `times` pages made up from each text with `fit` of `least` or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts, parts, rows = _counts([t.lower() for t in b.text]), ([], []), (([], []), ([], []))
            for own in _chunks([(t, int(pick)) for t, pick, fit in zip(b.text, b.pick, b.fit) if fit >= least]):
                turns = [(t, rnd, pick) for t, pick in own for rnd in [random.Random(pick)] for _ in range(times)]
                for (_, _, pick), added in zip(turns, examples_all([x[:2] for x in turns], *rows)):
                    for part, n in zip(parts, added):
                        part += [pick] * n
            if counts:
                yield pd.DataFrame({"kind": 2, "a": list(counts), "n": list(counts.values()), "part": None, "y": None, "x": None})
            out = [(k, None, 0, *packed(part, ys, xs)) for k, (part, (xs, ys)) in enumerate(zip(parts, rows)) if ys]
            if out:
                yield pd.DataFrame(out, columns=["kind", "a", "n", "part", "y", "x"])

    return texts.select("text", "pick", "fit").mapInPandas(run, _LEARNED)


def _order(vocab: DataFrame) -> dict[str, int]:
    """How often the q-grams of skeletons stand in the vocabulary."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        forms = Counter(g for w in b.word for s in [f"^{skeleton(w)}$"] for q in (2, 3) for g in {s[i : i + q] for i in range(len(s) - q + 1)})
        return pd.DataFrame({"g": list(forms), "n": list(forms.values())})

    grams = in_batches(vocab.select("word"), run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return {r.g: r.n for r in grams.orderBy(F.desc("n"), "g").limit(GRAMS).collect()}


def _vouched(vocab: DataFrame, texts: int) -> set[str]:
    """The words that are not doubted. They are so frequent that a text has no more than its length / VOUCHED of them, however many texts there are."""
    seen = {r.word: r.n for r in vocab.filter(F.col("n") >= VOUCHED * texts).select("word", "n").collect()}
    top: dict[str, int] = {}
    for w, n in seen.items():
        k = skeleton(w)
        top[k] = max(n, top.get(k, 0))
    return {w for w, n in seen.items() if top[skeleton(w)] <= RIVAL * n}


def _fit(docs: DataFrame):
    """The models, of all texts, and the order of the q-grams, both broadcast, and the counts of the words of all texts."""
    sc = docs.sparkSession.sparkContext
    clean = ~F.col("text").contains("\f") & (F.length("text") > 400)
    long = F.col("text").rlike("(?:^|\n)[^\n]{111}")  # not wrapped: no scans among them, with furniture of their own
    texts = docs.filter(F.length("text") > 0).select("text", F.xxhash64("text").alias("pick"), F.when(clean & long, 2).when(clean, 1).otherwise(0).alias("fit"))
    n = {r.fit: r["count"] for r in texts.groupBy("fit").count().collect()}
    least = 2 if n.get(2, 0) >= PLAIN else 1
    own = sum(v for k, v in n.items() if k >= least)
    learned = stored(_learn(texts, least, min(3, max(1, PAGES // max(1, own)))), "learned")
    counts = stored(learned.filter("kind = 2").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n")), "words")
    vocab = _vocabulary(counts)
    order = _order(vocab)
    held = sc.broadcast(order)
    lines = Lines.of(*(fit_rows(learned.filter(F.col("kind") == k), 90, 4) for k in (0, 1)))
    return sc.broadcast(Fitted(lines, _vouched(vocab, sum(n.values())), _ranking(counts, held), _joining(counts))), held, counts


def _found(docs: DataFrame, kept: bool = False):
    held, order, words = _fit(docs)
    scan = stored(docs.mapInPandas(_scan(held, kept), _SCHEMA), "pages")
    furniture = scan.filter("kind = 2").select(F.col("a").alias("word"), "n")  # counted below zero
    counts = stored(words.unionByName(furniture).groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "counts")
    fixes = stored(corrections(scan, counts, held, order), "corrections")
    return held, scan, counts, fixes


def _docs(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))


def noise(docs: DataFrame, key: str = "id", text: str = "text_content") -> DataFrame:
    """key, noise: one row for each kind (hyphen, misread, header, pagenum) in each document."""
    held, scan, counts, fixes = _found(_docs(docs, key, text))
    lines = scan.filter("kind = 0").select("id", F.col("a").alias("noise"))
    broken = joins(scan, counts, fixes, held).filter("joined").select("id", F.lit("hyphen").alias("noise"))
    wrong = scan.filter("kind in (3, 4)").select("id", F.col("a").alias("word")).join(fixes, "word", "left_semi").select("id", F.lit("misread").alias("noise"))
    return lines.unionByName(broken).unionByName(wrong).distinct().withColumnRenamed("id", key)


def repaired(docs: DataFrame, key: str = "id", text: str = "text_content") -> DataFrame:
    """key, text: each text in continuous paragraphs, without furniture, with broken words joined and misread words replaced."""
    df = _docs(docs, key, text).groupBy("id").agg(F.min("text").alias("text"))
    held, scan, counts, fixes = _found(df, True)
    lines = scan.filter("kind = 5").select("id", F.col("a").alias("kinds"))
    words = scan.filter("kind in (3, 4)").select("id", F.col("a").alias("word")).join(fixes, "word").groupBy("id").agg(F.collect_set(F.concat_ws("\n", "word", "better")).alias("fixes"))
    keep = joins(scan, counts, fixes, held).filter("not joined").groupBy("id").agg(F.collect_set(F.concat_ws("\n", "left", "right")).alias("compounds"))
    full = df.join(lines, "id", "left").join(words, "id", "left").join(keep, "id", "left")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        m, out = held.value, list(b.text)
        for i, (t, kinds, f, c) in enumerate(zip(b.text, b.kinds, b.fixes, b.compounds)):
            if not isinstance(t, str) or not any(x.isalpha() for x in t):
                continue
            page = split_lines(t)
            if isinstance(kinds, str):
                page.kinds = [_KINDS[k] for k in kinds]
            else:  # a row without an id meets no other table
                page = m.lines.read(t)
            out[i] = mend(out[i], m.lines, dict(x.split("\n") for x in f) if f is not None else {}, set(c) if c is not None else set(), page)
        return pd.DataFrame({"id": b.id, "text": out})

    return in_batches(full, run, "id long, text string").withColumnRenamed("id", key)


def mend(text: str, lines: Lines, fixes: dict[str, str], compounds: set[str], page: Page | None = None) -> str:
    """The repaired text: furniture out, lines joined within paragraphs, words mended. page: its lines, if they were read before."""
    page = page or lines.read(text)
    kept = [(l, k, b) for l, k, b in zip(page.lines, page.kinds, page.breaks) if k in ("text", "blank")]
    width = max([len(l.rstrip()) for l, k, _ in kept if k == "text"], default=0)
    paragraphs: list[str] = []
    now, last, gap, feed = "", "", False, False
    for line, kind, brk in kept:
        feed = feed or brk
        if kind == "blank":
            gap = True
            continue
        s = line.strip()
        first = s.split()[0] if s.split() else ""
        left, at = _broken_end(now)
        r = _LETTERS.match(s)
        m = bool(left)
        goes_on = bool(now) and (bool(m and r) or now.rstrip(")]\"”»’'")[-1:] not in tuple(".!?:;…")) and (s[:1].islower() or not gap or feed)
        wrapped = bool(last) and len(last.rstrip()) + 1 + len(first) > 0.92 * width and width >= 40
        if now and ((not gap and (wrapped or (m and r))) or (gap and feed and goes_on) or (gap and goes_on and s[:1].islower())):
            if m and r:
                pair = f"{left.lower()}\n{r[0].lower()}"
                now = (now[:at] + "-" + s) if pair in compounds else (now[:at] + s)
            else:
                now += " " + s
        else:
            if now:
                paragraphs.append((now, gap_before))
            now, gap_before = s, gap
        last, gap, feed = line, False, False
    if now:
        paragraphs.append((now, gap_before))
    out = ""
    for p, g in paragraphs:
        out += ("\n\n" if g else "\n") * bool(out) + p
    if fixes:
        out = _TOKEN.sub(lambda x: _cased(x[0], fixes.get(x[0].lower())), out)
    return out


def _broken_end(s: str) -> tuple[str, int]:
    """The letters before a mark that breaks a word at the end of s, and where the mark is; '' if there is none. Looked for from the end, as s may be long."""
    k = len(s)
    while k and s[k - 1] in " \t":
        k -= 1
    if not k or s[k - 1] not in HYPHENS:
        return "", k
    j = k - 1
    while j and s[j - 1].isalpha():
        j -= 1
    return s[j : k - 1], k - 1


def _cased(word: str, better: str | None) -> str:
    if better is None:
        return word
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return better.upper()
    return better.capitalize() if letters and letters[0].isupper() or (not word[0].isalpha() and word[1:2].isupper()) else better
