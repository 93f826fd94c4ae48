"""Recall and precision of the operators on planted cases."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.llm import canon, glyphs, langid, leak, names, ocr, truncated

SYLLABLES = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]


def vocabulary(rnd, n, least=2, most=4):
    out = set()
    while len(out) < n:
        out.add("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(least, most))) + rnd.choice(["", "n", "s", "r", "l"]))
    return sorted(out)


def prose(rnd, words, sentences):
    """Sentences over a vocabulary in which words are frequent in the manner of a language, and some words end sentences."""
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for _ in range(sentences):
        ws = rnd.choices(words, weights, k=rnd.randint(6, 14)) + [words[-rnd.randint(1, 12)]]
        out.append(" ".join(ws).capitalize() + ".")
    return out


def slip(rnd, w):
    i = rnd.randrange(len(w))
    return rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("aeiourst") + w[i:], w[:i] + rnd.choice("bcdfg") + w[i + 1 :]])


def share(found, true):
    return len(found & true) / max(1, len(true)), len(found & true) / max(1, len(found))


def test_leaks():
    rnd = random.Random(1)
    words = vocabulary(rnd, 600)
    items = [(i, " ".join(rnd.choices(words, k=60))) for i in range(40)]
    docs, true = [], set()
    for d in range(400):
        item, text = rnd.choice(items)
        k, size = rnd.randint(0, 35), rnd.choice([8, 12, 15, 20, 22, 25])
        ws = text.split()[k : k + size]
        kind = rnd.random()
        if kind < 0.5 and len(ws) >= 20:
            j = rnd.randint(3, len(ws) - 4)
            ws[j : j + 1] = rnd.choice([[slip(rnd, ws[j])], [rnd.choice(words)], [ws[j], ws[j]], []])
        elif kind > 0.9:
            rnd.shuffle(ws)
        if kind <= 0.9 and size >= 20 and len(text.split()[k : k + size]) >= 20:
            true.add((item, d))
        docs.append(" ".join([*rnd.choices(words, k=30), *ws, *rnd.choices(words, k=30)]))
    them = leak.Items(items)
    found = {(f[0], d) for d, t in enumerate(docs) for f in them.find(t)}
    recall, precision = share(found, true)
    assert recall > 0.97 and precision > 0.97


def test_canonical_names():
    rnd = random.Random(2)
    words = vocabulary(rnd, 120, 3, 4)
    entries = [(i + 1, " ".join(rnd.sample(words[:80], rnd.randint(2, 3)))) for i in range(60)]
    asked, true = [], []
    for _ in range(500):
        i, name = rnd.choice(entries)
        ws = name.split()
        kind = rnd.randrange(6)
        if kind == 0:
            asked.append(" ".join(rnd.sample(words[80:], 2)))
            true.append(0)
            continue
        if kind == 1:
            k = rnd.randrange(len(ws))
            ws[k] = slip(rnd, ws[k])
        elif kind == 2:
            rnd.shuffle(ws)
        asked.append({3: name.upper(), 4: "_".join(ws), 5: f"tag: {name}"}.get(kind, " ".join(ws)))
        true.append(i)
    got = [e for _, e in canon.Canon(entries).best(asked)]
    right = sum(g == t for g, t in zip(got, true))
    assert right > 0.97 * len(true)


def test_name_variants(spark):
    rnd = random.Random(3)
    families, given = [w.capitalize() for w in vocabulary(rnd, 60, 4, 4)], [w.capitalize() for w in vocabulary(rnd, 40, 2, 3)]
    rows, entity = [], {}
    for e in range(120):
        family, first = families[e % 60], given[(e * 7) % 40]
        forms = [f"{first} {family}", f"{family}, {first}", f"Dr. {first} {family}", f"{first.upper()} {family.upper()}", f"{first} {slip(rnd, family.lower()).capitalize()}"]
        for f in rnd.sample(forms, 3):
            entity[len(rows)] = e
            rows.append((len(rows), f, None))
    got = {(r.id_a, r.id_b) for r in names.same_pairs(spark.createDataFrame(rows, "id long, name string, name_native string")).collect()}
    true = {(a, b) for a in entity for b in entity if a < b and entity[a] == entity[b]}
    recall, precision = share(got, true)
    assert recall > 0.95 and precision > 0.95


def test_cut_texts(spark):
    rnd = random.Random(4)
    words = vocabulary(rnd, 400)
    rows, true = [], set()
    for i in range(600):
        text = " ".join(prose(rnd, words, rnd.randint(4, 9)))
        if rnd.random() < 0.3:
            k = rnd.randrange(len(text) // 3, len(text) - 2)
            if text[:k].rstrip()[-1] != ".":  # not at the end of a sentence
                text = text[:k]
                true.add(i)
        rows.append((i, text, f"s{i % 4}"))
    got = {r.doc_id for r in truncated.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("cut").collect()}
    recall, precision = share(got, true)
    assert recall > 0.95 and precision > 0.95


def test_scan_noise(spark):
    rnd = random.Random(5)
    words = vocabulary(rnd, 500, 2, 4)
    rows, true = [], set()
    for i in range(500):
        sentences = prose(rnd, words, 40)
        if i < 260:  # clean texts, not wrapped
            rows.append((i, "\n\n".join(" ".join(sentences[k : k + 8]) for k in range(0, 40, 8))))
            continue
        ws, kinds = " ".join(sentences).split(), {k for k in ("hyphen", "misread", "header", "pagenum") if rnd.random() < 0.4}
        if "misread" in kinds:
            done = 0
            for k in rnd.sample(range(len(ws)), len(ws)):
                w = ws[k]
                if w.isalpha() and w.islower() and len(w) > 4 and words.index(w) < 150 and (m := glyphs.misread(w, rnd)) and m not in words:
                    ws[k] = m
                    done += 1
                if done == 6:
                    break
        lines, now, broke = [], "", False
        for w in ws:
            room = 70 - len(now) - 2
            if len(now) + len(w) + 1 <= 70:
                now = f"{now} {w}".strip()
            elif "hyphen" in kinds and w.isalpha() and len(w) > 5 and 2 <= room <= len(w) - 2:
                lines.append(f"{now} {w[:room]}-")
                now, broke = w[room:], True
            else:
                lines.append(now)
                now = w
        lines.append(now)
        if not broke:
            kinds.discard("hyphen")
        head = " ".join(rnd.sample(words, rnd.randint(2, 6))).title()
        pages = [lines[k : k + 14] for k in range(0, len(lines), 14)]
        first = rnd.randint(1, 90)
        text = rnd.choice(["\f", "\n"]).join("\n".join([*([head] if "header" in kinds else []), *p, *([f"- {first + n} -"] if "pagenum" in kinds else [])]) for n, p in enumerate(pages))
        rows.append((i, text))
        true |= {(i, k) for k in kinds}
    got = {(r.id, r.noise) for r in ocr.noise(spark.createDataFrame(rows, "id long, text_content string")).collect()}
    for kind in ("hyphen", "misread", "header", "pagenum"):
        recall, precision = share({x for x in got if x[1] == kind}, {x for x in true if x[1] == kind})
        assert recall > 0.9 and precision > 0.85, (kind, recall, precision)


@pytest.mark.parametrize("seed", [6, 7])
def test_languages(spark, seed):
    rnd = random.Random(seed)
    function = {l: langid.FUNCTION_WORDS[l].split() for l in ("eng", "deu", "fra", "spa")}
    own = {l: vocabulary(random.Random(i), 200) for i, l in enumerate(function)}

    def paragraph(l):
        return " ".join(rnd.choice(function[l] if rnd.random() < 0.5 else own[l]) for _ in range(rnd.randint(20, 40))) + "."

    rows, true = [], set()
    for i in range(300):
        main = rnd.choice(list(function))
        ls = [main] * rnd.randint(3, 6)
        if rnd.random() < 0.3:
            ls[rnd.randint(1, len(ls) - 1)] = rnd.choice([l for l in function if l != main])
        label = main if rnd.random() < 0.7 else rnd.choice(["", "xx", next(l for l in function if l != main)])
        rows.append((i, "\n\n".join(map(paragraph, ls)), label))
        if label != main:
            true.add((i, 0, main))
        if len(set(ls)) > 1:
            true |= {(i, n + 1, l) for n, l in enumerate(ls)}
    df = spark.createDataFrame(rows, "id long, text_content string, language string")
    got = {(r.id, r.segment, r.language) for r in langid.mislabelled(df).filter(F.col("language") != "und").collect()}
    recall, precision = share(got, true)
    assert recall > 0.97 and precision > 0.97
