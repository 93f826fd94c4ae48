"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.llm import boost, canon, langid, leak, mix, names, ocr, split, subjects, truncated
from foliant.session import stored

ENG = "The committee of the archive has found that the letters were not in the office. We have asked for a copy of the report, and it will be there in two weeks. "
DEU = "Der Ausschuss hat festgestellt, dass die Briefe nicht in der Geschäftsstelle sind. Wir haben um eine Kopie des Berichts gebeten, und sie wird in zwei Wochen da sein. "
LONG = ENG * 700  # over 100,000 characters
CLASH = "key string, text string, kind string, words string, n string, entity string, source string, w string, x string"


def frame(spark, rows, ddl):
    """Rows with further columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, ddl)
    for c in CLASH.split(", "):
        name = c.split()[0]
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, ENG, "eng", "text/plain", 2), (1, ENG, "eng", "text/plain", 2), (2, None, None, None, None), (3, "", "", "", 1), (4, "  \n \n", "x", "x", 1), (5, LONG, "deu", "text/plain", 3), (6, ENG + "\n\n" + DEU, "de", None, 1), (7, "12", "en", "a", 1), (8, "💶 \ud83d".encode("utf-8", "ignore").decode() + " é", "fr", "b", 1), (9, DEU, None, "text/plain", None)]
    return frame(spark, rows, "id long, text_content string, language string, original_type string, document_type_id long")


def empty(df):
    return df.limit(0)


def test_languages(docs):
    got = {(r.id, r.segment): r.language for r in langid.languages(docs).collect()}
    assert got[1, 0] == "eng" and got[5, 0] == "eng" and got[9, 0] == "deu"
    assert got[2, 0] == got[3, 0] == got[4, 0] == got[7, 0] == "und"
    assert (got[6, 1], got[6, 2]) == ("eng", "deu") and (1, 1) not in got
    bad = {(r.id, r.segment): r.language for r in langid.mislabelled(docs).collect()}
    assert bad[5, 0] == "eng" and bad[9, 0] == "deu" and (1, 0) not in bad and (2, 0) not in bad
    assert langid.languages(empty(docs)).count() == 0


def test_language_models_come_from_all_texts(spark):
    rare = " ".join(f"gamodu{x} zeritok{x}" for x in "abcdef")  # words of one text in 2,500, by which another one is known
    rows = [(i, ENG) for i in range(2500)] + [(3000, "\n\n".join([DEU + rare] * 5)), (3001, rare), (3002, LONG + "karuvel " * 9), (3003, "karuvel karuvel karuvel karuvel")]
    got = {r.id: r.language for r in langid.languages(spark.createDataFrame(rows, "id long, text_content string")).filter("id >= 3000 and segment = 0").collect()}
    assert got == {3000: "deu", 3001: "deu", 3002: "eng", 3003: "eng"}


def test_fit_in_batches(spark):
    texts = [ENG, DEU, None, "", ENG + "\n\n" + DEU] * 3
    one, all_ = langid.Model.fit(texts), langid.fit_all(spark.createDataFrame([(t,) for t in texts], "text string"))
    rows = lambda m: {w: m.e[i].tolist() for w, i in m.words.items()}
    assert rows(one) == rows(all_)


def test_scripts(spark):
    df = spark.createDataFrame([(1, "Привет, как дела у вас сегодня"), (2, "これは日本語の文章です"), (3, "Καλημέρα σας"), (4, "这是中文")], "id long, text_content string")
    assert {r.id: r.language for r in langid.languages(df).collect()} == {1: "rus", 2: "jpn", 3: "ell", 4: "zho"}


def test_canon(spark):
    vocab = frame(spark, [(1, "board minutes"), (2, "soil science"), (3, "soil science"), (None, "x"), (5, None)], "entry_id long, name string")
    tags = frame(spark, [(1, "Board-Minutes"), (1, "Board-Minutes"), (2, None), (3, ""), (4, "???"), (5, "soil scence"), (6, "x" * 100_000), (7, "minutes, board")], "id long, name string")
    got = {r.id: (r.entry_id, r.distance) for r in canon.map_values(tags, vocab).collect()}
    assert got == {1: (1, 0), 2: (0, None), 3: (0, None), 4: (0, None), 5: (2, 1), 6: (0, None), 7: (1, 0)}
    sharded = {r.id: r.entry_id for r in canon.map_values(tags, vocab, broadcast_entries=0, shard_entries=1).collect()}
    assert sharded == {k: v[0] for k, v in got.items()}
    assert {r.entry_id for r in canon.map_values(tags, empty(vocab)).collect()} == {0}
    assert canon.map_values(empty(tags), vocab).count() == 0


def test_names(spark):
    rows = [(1, "Margaret Gambodubek", None), (2, "GAMBODUBEK, Maggie", ""), (2, "GAMBODUBEK, Maggie", ""), (3, None, None), (4, "", "x"), (5, "???", None), (6, "a" * 50_000, None), (7, "Gambodubek Textiles S.A.", None), (8, "Textiles Gambodubek", None), (9, "M. Gambodubek", None)]
    df = frame(spark, rows, "id long, name string, name_native string")
    assert {(r.id_a, r.id_b) for r in names.same_pairs(df).collect()} == {(1, 2), (1, 9), (2, 9), (7, 8)}
    assert names.entities(df).count() == 9
    assert names.same_pairs(empty(df)).count() == 0


def test_names_send_no_table_to_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(names, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    df = spark.createDataFrame([(1, "Margaret Gambodubek", None), (2, "GAMBODUBEK, Maggie", ""), (3, "M. Gambodubek", None)], "id long, name string, name_native string")
    out = names.same_pairs(df)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 3 and any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)


def test_split(spark, docs):
    limits = spark.createDataFrame([("text/plain", 100, 10), ("*", 50, None), ("bad", 0, 5)], "original_type string, max_chars int, overlap_chars int")
    rows = split.split(docs, limits).collect()
    assert all(r.end - r.start <= (100 if r.id in (1, 5, 9) else 50) for r in rows)
    assert {r.id for r in rows} == set(range(1, 10))
    assert split.split(docs, empty(limits)).filter("pieces > 1").count() == 0
    assert split.split(empty(docs), limits).count() == 0


def test_noise_models_come_from_all_texts(spark):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(3, 5))) for _ in range(80)})
    rows = [(i, "".join(rnd.choice(words) + (" " if k % 12 else ".\n\n") for k in range(4000))) for i in range(1, 5)]  # none of 20,000 characters or fewer
    assert min(len(t) for _, t in rows) > 20_000
    odd = next(w for w in words if "l" in w)
    rows[2] = (3, rows[2][1] + odd.replace("l", "1", 1) + " " + words[0] + ".")
    df = spark.createDataFrame(rows, "id long, text_content string")
    assert {(r.id, r.noise) for r in ocr.noise(df).collect()} == {(3, "misread")}
    once = spark.range(3000).select(F.concat(F.lit("Once more "), F.col("id") % 7, F.lit(" well-known")).alias("text"), F.col("id").alias("pick"), F.lit(0).alias("fit"))
    n = {r.a: r.n for r in ocr._learn(once, 1, 1).filter("kind = 2").groupBy("a").agg(F.sum("n").alias("n")).collect()}
    assert n["once"] == n["well-known"] == n["known"] == 3000


def test_trees_of_all_rows(spark, monkeypatch):
    """With chunks of rows, at hand or summed in the tasks, the trees are the same, and a rare case in one text in a hundred counts."""
    monkeypatch.setattr(boost, "ROWS", 500)
    rnd = np.random.default_rng(1)
    x = rnd.random((2400, 3)).round(2)
    x[:, 2] = np.arange(2400) % 100 == 7
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)) | (x[:, 2] > 0)).astype(int)
    table = spark.createDataFrame(pd.DataFrame([boost.packed(list(range(i, i + 100)), y[i : i + 100].tolist(), x[i : i + 100].tolist()) for i in range(0, 2400, 100)], columns=["part", "y", "x"]), boost.PACKED)
    held, apart = boost.fit_rows(table, 8, 3), boost.fit_rows(table, 8, 3, at_hand=0)
    assert np.allclose(held.score(x), apart.score(x)) and ((held.score(x) > 0.5) == y).mean() > 0.95
    assert boost.fit_rows(table.limit(0), 8, 3) is None
    assert [len(c) for c in (held.forest, apart.forest)] == [8, 8]


def test_noise(docs):
    assert ocr.noise(docs).count() >= 0
    assert ocr.noise(empty(docs)).count() == 0
    got = {r.id: r.text for r in ocr.repaired(docs).collect()}
    assert got[2] is None and got[3] == "" and got[7] == "12" and len(got) == 9


def test_areas(spark, docs):
    labels = spark.createDataFrame([(1, 4), (1, 4), (9, None), (None, 3), (999, 1)], "id long, subject_id int")
    assert subjects.areas(docs, labels).count() >= 0
    assert subjects.areas(docs, empty(labels)).count() == 0
    assert subjects.areas(empty(docs), labels).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, ENG, "a"), (1, ENG, "a"), (2, None, "a"), (3, "", None), (4, " \n", "b"), (5, LONG, "a"), (6, ENG + "The letters of the", None), (7, ENG + "See (page 4", "b"), (8, ENG.replace(" ", "\n", 20), "zz")]
    return frame(spark, rows, "doc_id long, text string, source string").drop("w")


def test_leaks(spark, corpus):
    item = " ".join(ENG.split()[3:26])
    items = frame(spark, [(1, item), (1, item), (2, None), (3, ""), (4, "short"), (5, item.upper() + "!"), (6, " ".join(reversed(item.split())))], "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in leak.leaks(corpus, items).collect()}
    assert got == {(i, d) for i in (1, 5) for d in (1, 5, 6, 7, 8)}
    assert leak.leaks(corpus, empty(items)).count() == 0
    assert leak.leaks(empty(corpus), items).count() == 0


def test_mixture(spark, corpus):
    targets = frame(spark, [("a", 0.7, 1), ("zz", 0.2, 3), ("none", 0.1, 2), (None, 0.5, 1), ("b", None, 2)], "source string, weight double, max_repeats int")
    m = mix.mixture(corpus, targets)
    assert {r.source for r in m.select("source").distinct().collect()} <= {"a", "zz"}
    assert m.groupBy("doc_id", "turn", "first").count().filter("count > 1").count() == 0
    assert mix.mixture(corpus, empty(targets)).count() == 0
    assert mix.mixture(empty(corpus), targets).count() == 0
    assert {r.source for r in mix.shares(m, targets).collect()} == {"a", "zz", "none", None, "b"}


def test_truncated(corpus):
    got = {r.doc_id: r.cut for r in truncated.truncated(corpus).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: False, 6: True, 7: True, 8: False}
    assert truncated.truncated(empty(corpus)).count() == 0
    assert {r.source: r.documents for r in truncated.rates(corpus).collect()}[None] == 2
