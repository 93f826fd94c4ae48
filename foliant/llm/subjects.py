"""Subject areas of documents, by class-association rules.

Sentences of the running text are transactions of words; those of labelled documents count for their subject. Parallel frequent-pattern growth (growth.py)
finds the frequent sets of at most LONGEST words with their counts in each subject, the rules "words => subject" are those of enough support and confidence, and a
rule is redundant if a part of its words gives the subject nearly as surely. Each sentence goes to the subject with the most evidence among
its matching rules (slightly raised by what the document type has been seen with); a document's areas are those that hold at least the calibrated
share of its running text.

Evidence is calibrated out of fold: documents fall into two folds, counts are kept for each, and the log odds of a rule are what rules of such log odds
in one fold come to in the other. The threshold is the best one for the labelled documents, each scored with the rules of the fold it is not in.

The labelled sample is small and many words do not occur in it: in ROUNDS further rounds, documents that the rules give to
one subject beyond doubt serve as labelled ones too. Samples are bounded (FIT_LABELLED labelled documents, FIT_MORE others of at most FIT_CHARS characters, by the hash of
their id); all documents are scored. The threshold has the best F1 within CALIBRATION.

Defined results: null, empty texts and texts without sentences or matching rules have no area; labels of unknown documents or null subjects are ignored; without labels nothing is found;
rows of one id count once (the first text); ties of evidence go to the smaller subject.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bounded, in_batches
from foliant.llm.growth import frequent_sets
from foliant.session import stored

FIT_LABELLED, FIT_MORE, FIT_CHARS, ROUNDS = 8000, 3000, 20_000, 2
SUPPORT, CONFIDENCE, GAIN, LONGEST, BINS = 3, 0.75, 0.08, 2, 12
#: A rule whose calibrated log odds are under this (less than two right for one wrong) is dropped.
LEAST_EVIDENCE = math.log(2)
#: A word stands in the transactions if it is seen so often and this share of it is in one subject.
WORD_SEEN, WORD_SHARE = 3, 0.6
CALIBRATION = (0.2, 0.34)
#: A document that serves as labelled: this share of its text in one subject and at most that in any other.
SURE, OTHER = 0.55, 0.1

_WORD = re.compile(r"[^\W\d_]{3,}")
_BULLET = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)]|[a-z]\))\s")
_SPLIT = re.compile(r"(?<=[.!?;:])[\"”»)\]]*\s+(?=[^a-zà-ÿ])")
_ENDS = re.compile(r"[.!?;][\"”»)\]’']*$")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-­‐¬][ \t]*\r?\n\s*(?=[^\W\d_])")
WINDOW = 20


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of the running text; salutations, titles, lists and closings have no sentence end and stay out.
    A text without sentence ends is cut into windows."""
    if "\n" in text:
        text = _BROKEN.sub("", text)
    lines = text.replace("\r", "").replace("\f", "\n\n").split("\n")
    width = max(map(len, lines))
    wrapped = width < 100
    blocks, now = [], []
    for line in lines:
        s = line.strip()
        if not s or _BULLET.match(line):
            if now:
                blocks.append(" ".join(now))
            now = []
            continue
        now.append(s)
        if not wrapped or len(s) < 0.6 * width:
            blocks.append(" ".join(now))
            now = []
    if now:
        blocks.append(" ".join(now))
    out = []
    for b in blocks:
        for s in _SPLIT.split(b):
            if _ENDS.search(s) and s.count(" ") >= 4:
                out.append([w.lower() for w in _WORD.findall(s)])
    if not out:
        ws = [w.lower() for b in blocks for w in _WORD.findall(b)]
        if len(ws) >= 2 * WINDOW:
            out = [ws[i : i + WINDOW] for i in range(0, len(ws), WINDOW)]
    return out


class Rules:
    """Rules by their first word, with the evidence for their subject; what document types have been seen with."""

    def __init__(self, rules: list[tuple[tuple[str, ...], int, float]], types: dict[tuple[int, int], float]):
        self.single = {a[0]: (c, e) for a, c, e in rules if len(a) == 1}
        self.double: dict[str, list[tuple[str, int, float]]] = {}
        for a, c, e in rules:
            if len(a) == 2:
                self.double.setdefault(a[0], []).append((a[1], c, e))
        self.types = types

    def shares(self, text: str | None, kind: int | None) -> tuple[dict[int, float], int]:
        """Of each subject the share of the running text that goes to it; and the words of the running text."""
        if not isinstance(text, str):
            return {}, 0
        total, got = 0, Counter()
        single, double = self.single, self.double
        for ws in sentences(text):
            total += len(ws)
            evidence: Counter = Counter()
            seen = set(ws)
            for w in seen:
                if w in single:
                    c, e = single[w]
                    evidence[c] += e
                if w in double:
                    for other, c, e in double[w]:
                        if other in seen:
                            evidence[c] += e
            if evidence:
                c = min(evidence, key=lambda c: (-evidence[c] * (1 + 0.2 * self.types.get((kind, c), 0.0)), c))
                got[c] += len(ws)
        return ({c: n / total for c, n in got.items()} if total else {}), total


def fold(text: str) -> Column:
    """The fold of a document; copies fall into one."""
    return F.pmod(F.xxhash64(text, F.lit(5)), F.lit(2)).cast("int")


def _transactions(docs: DataFrame, subjects: list[int]) -> DataFrame:
    """class (two for each subject, one for each fold), words: the sentences of documents with one subject."""
    at = {c: i for i, c in enumerate(subjects)}

    def run(b: pd.DataFrame) -> pd.DataFrame:
        rows = [(2 * at[c] + f, sorted(set(ws))) for t, c, f in zip(b.text, b.subject, b.fold) for ws in sentences(t)]
        return pd.DataFrame(rows, columns=["class", "words"])

    return in_batches(docs.select("text", "subject", fold("text").alias("fold")), run, "class int, words array<string>")


def _odds(n: np.ndarray, c: int) -> float:
    return math.log((n[c] + 0.5) / (n.sum() - n[c] + 0.5))


def chosen(sets: list[tuple[tuple[str, ...], np.ndarray]]) -> list[tuple[tuple[str, ...], int, float]]:
    """(words, subject's place, log odds) of the rules that sets (words, counts by subject) make: of enough support and confidence and not redundant."""
    found: dict[tuple[str, ...], tuple[int, float, float]] = {}
    for a, n in sets:
        c = int(n.argmax())
        if n[c] >= SUPPORT and n[c] >= CONFIDENCE * n.sum():
            found[a] = (c, n[c] / n.sum(), _odds(n, c))
    out = []
    for a, (c, conf, odds) in sorted(found.items()):
        parts = [found[(w,)] for w in a if len(a) > 1 and (w,) in found]
        if all(conf > p[1] + GAIN for p in parts if p[0] == c):
            out.append((a, c, odds))
    return out


def calibration(sets: list[tuple[tuple[str, ...], np.ndarray]]) -> dict[int, tuple[list[float], list[float]]]:
    """By the number of words of a rule: log odds of rules in one fold, and what these come to in the other, as a curve that never falls. sets: (words, counts by
    subject and fold). A word that the other fold does not have says nothing."""
    seen: dict[int, list[tuple[float, float, float]]] = {}
    by_words = {a: n.reshape(-1, 2) for a, n in sets}
    for f in (0, 1):
        for a, c, odds in chosen([(a, n[:, f]) for a, n in by_words.items()]):
            other = by_words[a][:, 1 - f]
            if other.sum():
                seen.setdefault(len(a), []).append((odds, float(other[c]), float(other.sum())))
    out = {}
    for size, rows in seen.items():
        bins = min(BINS, len(rows) // 4)
        if bins < 2:
            continue
        xs, ys = [], []
        for part in np.array_split(np.array(sorted(rows)), bins):
            xs.append(float(part[:, 0].mean()))
            ys.append(math.log((part[:, 1].sum() + 0.5) / (part[:, 2].sum() - part[:, 1].sum() + 0.5)))
        out[size] = xs, np.maximum.accumulate(ys).tolist()
    return out


def mine(labelled: DataFrame, types: dict, subjects: list[int]) -> tuple[Rules, Rules, Rules]:
    """Rules from documents (text, subject) with one subject each: from all of them, and from each fold."""
    tx = stored(_transactions(labelled, subjects), "transactions")
    n = F.count(F.lit(1))
    words = tx.select(F.floor(F.col("class") / 2).alias("subject"), F.explode("words").alias("w")).groupBy("w", "subject").agg(n.alias("n"))
    words = words.groupBy("w").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter((F.col("n") >= WORD_SEEN) & (F.col("most") >= WORD_SHARE * F.col("n"))).select("w", "n")
    kept = tx.withColumn("t", F.monotonically_increasing_id()).select("t", "class", F.explode("words").alias("w")).join(words, "w")
    kept = kept.groupBy("t", "class").agg(F.transform(F.sort_array(F.collect_set(F.struct((-F.col("n")).alias("n"), "w"))), lambda x: x["w"]).alias("items"))
    kept = stored(kept.groupBy("items", "class").agg(n.alias("n")), "items")

    def by_subject(x: np.ndarray) -> np.ndarray:
        return x.reshape(-1, 2).sum(1)

    def good(x: np.ndarray) -> bool:
        return by_subject(x).max() >= SUPPORT

    def keep(x: np.ndarray) -> bool:
        return any(m.max() >= SUPPORT and m.max() >= CONFIDENCE * m.sum() for m in (by_subject(x), x[0::2], x[1::2]))

    sets = [(tuple(r["items"]), np.array(r["counts"])) for r in frequent_sets(kept, 2 * len(subjects), LONGEST, good, keep).collect()]
    curves = calibration(sets)

    def rules(part: list[tuple[tuple[str, ...], np.ndarray]]) -> Rules:
        weighed = [(a, subjects[c], _mapped(odds, curves.get(len(a)))) for a, c, odds in chosen(part)]
        return Rules([r for r in weighed if r[2] >= LEAST_EVIDENCE], types)

    return rules([(a, by_subject(x)) for a, x in sets]), rules([(a, x[0::2]) for a, x in sets]), rules([(a, x[1::2]) for a, x in sets])


def _mapped(odds: float, curve: tuple[list[float], list[float]] | None) -> float:
    """The calibrated evidence; beyond the curve it goes on as it is, without one (too few rules to say) it is the log odds."""
    if curve is None:
        return odds
    xs, ys = curve
    return ys[-1] + (odds - xs[-1]) if odds >= xs[-1] else float(np.interp(odds, xs, ys))


def _scores(docs: DataFrame, held) -> DataFrame:
    """key, subject, share, words: of each document the subjects of any of its sentences. held: rules for all, or a list with those for each fold."""
    folds = "fold" in docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = held.value
        for b in batches:
            rows = []
            for k, t, kind, f in zip(b.key, b.text, b.type, b.fold if folds else b.key):
                own = rules[f] if folds else rules
                shares, total = own.shares(t, None if pd.isna(kind) else int(kind))
                rows += [(k, c, s, total) for c, s in shares.items()]
            yield pd.DataFrame(rows, columns=["key", "subject", "share", "words"])

    return docs.mapInPandas(run, "key long, subject int, share double, words int")


def fit(df: DataFrame, labels: DataFrame):
    """The broadcast rules and the calibrated threshold. df: key, text, type; labels: key, subject."""
    sc = df.sparkSession.sparkContext
    labels = labels.filter("key is not null and subject is not null").distinct().groupBy("key").agg(F.collect_set("subject").alias("subjects"))
    short = df.filter((F.length("text") > 0) & (F.length("text") <= FIT_CHARS))
    sample = stored(short.join(bounded(labels, "key", FIT_LABELLED), "key"), "labelled")
    pairs = sample.select("type", F.explode("subjects").alias("c")).groupBy("type", "c").count().collect()
    subjects = sorted({r.c for r in pairs})
    of_type, of_subject, total = Counter(), Counter(), 0
    for r in pairs:
        if r.type is not None:
            of_type[r.type] += r["count"]
            of_subject[r.c] += r["count"]
            total += r["count"]
    types = {(int(r.type), r.c): max(-1.0, min(1.0, math.log((r["count"] + 1) * total / ((of_type[r.type] + 8) * of_subject[r.c])))) for r in pairs if r.type is not None}
    one = sample.filter(F.size("subjects") == 1).select("text", F.col("subjects")[0].alias("subject"))
    rules = mine(one, types, subjects)
    more = stored(bounded(df, "key", FIT_MORE).filter((F.length("text") > 0) & (F.length("text") <= FIT_CHARS)).join(labels, "key", "left_anti"), "more") if rules[0].single else None
    for _ in range(ROUNDS if more is not None else 0):
        held = sc.broadcast(rules[0])
        best = F.max(F.struct("share", "subject"))
        sure = _scores(more.select("key", "text", "type"), held).groupBy("key").agg(best.alias("x"), F.sum("share").alias("all")).filter((F.col("x.share") >= SURE) & (F.col("all") - F.col("x.share") <= OTHER))
        rules = mine(one.unionByName(more.join(sure.select("key", F.col("x.subject").alias("subject")), "key").select("text", "subject")), types, subjects)
    truth = {r.key: set(r.subjects) for r in sample.select("key", "subjects").collect()}
    apart = sc.broadcast([rules[2], rules[1]])  # a document of fold 0 meets the rules of fold 1
    scored = [(r.key, r.subject, r.share) for r in _scores(sample.select("key", "text", "type", fold("text").alias("fold")), apart).select("key", "subject", "share").collect()]
    return sc.broadcast(rules[0]), calibrated(scored, truth)


def calibrated(scored: list[tuple[int, int, float]], truth: dict[int, set[int]]) -> float:
    """The threshold of the best F1 on the labelled sample, the middle of the best range."""
    lo, hi = CALIBRATION
    steps = [lo + (hi - lo) * i / 32 for i in range(33)]
    want = sum(map(len, truth.values()))
    f = []
    for t in steps:
        hits = sum(s >= t and c in truth[k] for k, c, s in scored)
        said = sum(s >= t for _, _, s in scored)
        f.append(2 * hits / max(1, said + want))
    top = [t for t, x in zip(steps, f) if x >= max(f) - 1e-9]
    return top[len(top) // 2]


def areas(docs: DataFrame, labels: DataFrame, key: str = "id", text: str = "text_content", kind: str = "document_type_id") -> DataFrame:
    """key, subject_id, share (of the running text), words (of the running text): the areas of each document."""
    df = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.col(kind).cast("long").alias("type"))
    held, least = fit(df, labels.select(F.col(key).cast("long").alias("key"), F.col("subject_id").cast("int").alias("subject")))
    out = _scores(df, held).filter(F.col("share") >= least)
    return out.groupBy("key", "subject").agg(F.max("share").alias("share"), F.max("words").alias("words")).select(F.col("key").alias(key), F.col("subject").alias("subject_id"), F.round("share", 4).alias("share"), "words")


def composition(docs: DataFrame, labels: DataFrame, key: str = "id", text: str = "text_content", kind: str = "document_type_id") -> DataFrame:
    """subject_id, documents, words, document_share: the archive's composition."""
    a = areas(docs, labels, key, text, kind)
    total = docs.select(F.count_distinct(key).alias("total"))
    out = a.groupBy("subject_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum(F.col("share") * F.col("words"))).cast("long").alias("words"))
    return out.join(F.broadcast(total), F.lit(True)).select("subject_id", "documents", "words", F.round(F.col("documents") / F.greatest("total", F.lit(1)), 6).alias("document_share"))
