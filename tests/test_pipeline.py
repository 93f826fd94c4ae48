"""Links, gates and the other steps of the pipeline."""

from datetime import datetime

from pyspark.sql import functions as F

from foliant.operators import pipeline as P


def test_steps(spark):
    now = F.to_timestamp(F.lit("2024-01-02"))
    t = datetime(2024, 1, 1)
    tag = spark.createDataFrame([(1, "a", t), (2, "b", t)], "id long, name string, created_at timestamp")
    dt = spark.createDataFrame([(10, 1), (10, 2), (11, 1)], "document_id long, tag_id long")
    want = spark.createDataFrame([(10, ["b", "new", "new"]), (12, [])], "document_id long, tags array<string>")
    tags, links = P.relink_tags(tag, dt, want, now)
    assert {(r.id, r.name) for r in tags.collect()} == {(1, "a"), (2, "b"), (3, "new")}
    assert {tuple(r) for r in links.collect()} == {(10, 2), (10, 3), (11, 1)}
    m = spark.createDataFrame([(1, "b", 0.9), (1, "a", 0.5)], "q long, t string, similarity double")
    assert {r.id: r.tags for r in P.suggestions(spark.createDataFrame([(1,), (2,)], "id long"), m, tag).collect()} == {1: ["b", "a"], 2: ["a", "b"]}
    batch = spark.createDataFrame([("x", "s", "queued", t), ("y", "s", "queued", None), ("z", "s", "failed", t)], "id string, source string, status string, created_at timestamp")
    owner = spark.createDataFrame([("q", datetime(2024, 1, 1, 23, 59, 55))], "batch_id string, last_heartbeat timestamp")
    assert [r.id for r in P.admit(batch, owner, now, 2).collect()] == ["x"]
    files = spark.createDataFrame([("/a/errors/u-x.pdf",), ("/a/errors/duplicated/u-y.pdf",), ("/a/x.pdf",)], "path string")
    assert {(r.name, r.reason) for r in P.errored(files).collect()} == {("u-x.pdf", "failed"), ("u-y.pdf", "duplicate")}
    assert P.downscale(bytes(range(12)), 2, 2, 1, 1) == bytes([0, 1, 2])
    docs = spark.createDataFrame([(1, "one two three four"), (2, "one")], "id long, text string")
    assert [r.id for r in P.second_look(docs, "id", "text", 2, lambda p: '{"type": "letter", "title": "t"}', "letter").collect()] == [1]


def test_trash_catalog_zip_and_orphans(spark, tmp_path):
    import io
    import zipfile

    from foliant.operators import backup, state
    from foliant.sources import files

    t = datetime(2024, 1, 2)
    folders = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 1)), ("c", datetime(2024, 1, 1, 23, 58))], "document_id string, modified_at timestamp")
    docs = spark.createDataFrame([("a", t), ("b", None)], "document_id string, deleted_at timestamp")
    assert [r.document_id for r in state.purgeable(folders, docs, F.lit(t)).collect()] == ["b"]
    catalog = spark.createDataFrame([("p", "m", 1), ("p", "m-large", 2), ("q", "m", 3)], "provider string, model string, limit int")
    assert P.model_of(catalog, "P", "m-large-2024").first().limit == 2 and P.model_of(catalog, "x", "m").count() == 0
    rows = spark.createDataFrame([(1, "a.pdf", bytearray(b"x")), (1, "a.pdf", bytearray(b"y")), (2, "b", bytearray(b"z")), (2, None, None)], "g int, name string, content binary")
    got = {r.g: zipfile.ZipFile(io.BytesIO(r.archive)).namelist() for r in files.zipped(rows, "g").collect()}
    assert got == {1: ["a.pdf", "a (2).pdf"], 2: ["b"]}
    for _ in range(2):
        (tmp_path / "x.pdf").write_text("1")
        P.move_orphan(str(tmp_path / "x.pdf"), str(tmp_path / "q"))
    assert sorted(p.name for p in (tmp_path / "q").iterdir()) == ["x-1.pdf", "x.pdf"]
    assert tuple(backup.totals(spark.createDataFrame([("a", 3), ("b", 4)], "path string, length long")).first()) == (2, 7)


def test_many_names(spark):
    names = spark.range(20_500).select(F.concat(F.lit("n"), F.col("id")).alias("name"))
    m = spark.createDataFrame([(1, "n7", 0.9), (1, "n5", 0.5)], "q long, t string, similarity double")
    docs = spark.createDataFrame([(1,), (2,)], "id long")
    assert {r.id: len(r.tags) for r in P.suggestions(docs, m, names).collect()} == {1: 2, 2: 20_500}
    assert {r.id: r.tags for r in P.suggested(docs, m, names.union(names)).collect()} == {1: 2, 2: 20_500}


def test_suggested_names(spark, tmp_path):
    from foliant.plans import registry

    docs = [(1, "tea tea tax", None), (2, None, None), (3, "orchestra", None), (4, "tea", datetime(2024, 1, 1))]
    spark.createDataFrame(docs, "id long, title string, deleted_at timestamp").write.parquet(str(tmp_path / "archive_document.parquet"))
    spark.createDataFrame([(1, "tea"), (2, "tax"), (3, "tea")], "id long, name string").write.parquet(str(tmp_path / "tag.parquet"))
    got = registry.queries()["tags_suggested"](spark, str(tmp_path)).collect()
    assert {r.id: r.tags for r in got} == {1: ["tea", "tax"], 2: ["tax", "tea"], 3: ["tax", "tea"]} and len(got) == 3
