"""The core's functions on small cases."""

from datetime import datetime
from io import BytesIO
from zipfile import ZipFile

import pytest
from pyspark.sql import functions as F

from foliant.functions import fts
from foliant.functions import text as T
from foliant.operators import backup, enrich, ingest, search, state, textrank
from foliant.operators.orphans import Reference, orphan_report, orphans
from foliant.sources import files, logs


def one(spark, expr, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return df.select(expr.alias("v")).first().v


@pytest.mark.parametrize("text, n, want", [("   ", 10, "Unknown"), ("Hello World This Is A Test", 12, "Hello World"), ("日本語のテキスト", 5, "日本語のテ"), ("short", 10, "short")])
def test_truncate(spark, text, n, want):
    assert one(spark, T.truncate(F.col("c0"), n), text) == want


@pytest.mark.parametrize("text, want", [("", 0), ("hello", 2), ("日本語のテキスト文字列", 17), ("hello world 你好", 6)])
def test_estimate_tokens(spark, text, want):
    assert one(spark, T.estimate_tokens(F.col("c0")), text) == want


@pytest.mark.parametrize("text, want", [("José García", "jose garcia"), ("O'Brien", "obrien"), ("αβγ", ""), ("author123", "author"), ("a—b", "a b"), ("  A   B ", "a b")])
def test_normalize(spark, text, want):
    assert T.normalize_name(text) == want
    assert one(spark, T.normalize_for_db("c0"), text) == want


def test_text_functions(spark):
    assert one(spark, T.head_tail_words(F.col("c0"), 2, 2), "a b c d e") == "a b\n\n[...]\n\nd e"
    assert one(spark, T.head_tail_words(F.col("c0"), 9, 2), "a b") == "a b"
    assert one(spark, T.strip_tags(F.col("c0")), "a <b>c</b> < d") == "a c < d"
    assert one(spark, T.sanitize_snippet(F.col("c0")), "<b>x</b><i>") == "<b>x</b>&lt;i&gt;"
    assert one(spark, T.normalize_tags(F.col("c0")), ["A-b", "a b", "É!", "9"]) == ["a b", "e"]
    assert one(spark, T.truncate_bytes(4)(F.col("c0")), "éé€") == "éé"
    assert one(spark, T.split_sentences(F.col("c0")), "One. Two! Three") == ["One.", "Two!", "Three"]


def test_filter_tags(spark):
    def f(tags, people=(), known=(), title="", types=()):
        df = spark.createDataFrame([(list(tags), list(people), list(known), title, list(types))], "t array<string>, p array<string>, k array<string>, h string, y array<string>")
        return df.select(enrich.filter_tags(*[F.col(c) for c in "tpkhy"]).alias("v")).first().v

    assert f(["a b c d", "", "john smith", "tax"], people=["john doe"]) == ["tax"]
    assert f(["john doe"], known=["john doe smith"]) == [] and f(["young"], known=["andrew young"]) == ["young"]
    assert f(["annual report", "tax"], types=["report"]) == ["tax"] and f(["big tax", "tax"], title="tax letter") == ["big tax"]
    assert f(list("abcdefg")) == list("abcde")


def test_query_language():
    f = search.parse_query('tag:"computer science" author:Ann lang:deu size:>2kb created:2020..2021-05 missing:tags foo:bar free text', {"author"})
    assert f.tags == ("computer science",) and f.people == (("Ann", "author"),) and f.size == (2048, None) and f.created == ("2020", "2021-05") and f.untagged and f.query == "foo:bar free text"
    assert search.parse_query("size:5").size == (5, 5) and search.parse_query("created:2020").created == ("2020", None)
    assert search.parse_query(search.format_query(f), {"author"}) == f
    assert search.clamp_limit(0) == 50 and search.clamp_limit(1000) == 100 and search.coerce("x", 7) == 7 and search.coerce("99", 7, 1, 10) == 7


def test_fts(spark):
    assert one(spark, fts.matches(F.col("c0"), "Q1 report"), "the report of q1") and not one(spark, fts.matches(F.col("c0"), "Q1 report"), "the reports of q1")
    assert not one(spark, fts.matches(F.col("c0"), " "), "x")
    assert fts.headline("a b c budget d", {"budget"}, 64, 2) == "<b>budget</b> d" or "<b>budget</b>" in fts.headline("a b c budget d", {"budget"}, 64, 2)


def test_textrank():
    text = " ".join(f"Sentence {i} speaks of topic{i % 7} and item{i}." for i in range(400))
    out = textrank.reduce_text(text, 300, 50)
    assert out.startswith("Sentence 0 ") and 300 <= len(out.replace("[...]", "").split()) < 420
    assert textrank.reduce_text(text, 0) == text and textrank.reduce_text("a b", 5) == "a b"
    assert textrank.target_words(10_000, -4) == 2500 and textrank.target_words(100, -4) == 2000
    assert textrank.chunked("A b. C d.".split(), 2) == [(["A", "b."], 1), (["b.", "C", "d."], 0)]


def test_state(spark):
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    ddl = "id long, task_id string, task_type string, status string, batch_id string, payload string, result string, dedup_key string, created_at timestamp, started_at timestamp, completed_at timestamp, error string, attempts int"
    t0 = datetime(2024, 1, 1)
    row = lambda i, kind, st, payload=None, att=0, key=None: (i, f"t{i}", kind, st, "b", payload, None, key, t0, t0, None, None, att)
    task = spark.createDataFrame([row(1, "consume", "failed", '{"on_completed": "t2"}'), row(2, "enrich", "waiting", '{"waiting_for": "t1"}'), row(3, "consume", "processing", att=3), row(4, "consume", "processing", att=1), row(5, "consume", "pending", key="k")], ddl)
    status = lambda df: {r.id: r.status for r in df.collect()}
    assert status(state.discard_waiting(task))[2] == "discarded"
    assert status(state.restore_discarded(state.retry(state.discard_waiting(task), F.lit(True))))[2] == "waiting"
    got = {r.id: (r.status, r.attempts, r.error) for r in state.reclaim_stale(task, now).collect()}
    assert got[3] == ("failed", 3, "Max retries exceeded (3)") and got[4] == ("pending", 2, None)
    assert state.next_pending(task, "consume").first().id == 5 and state.next_pending(task, gate_closed=True).count() == 0
    claimed = state.claim(task, 5, now)
    assert status(claimed)[5] == "processing" and state.affected(task, state.claim(claimed, 5, now)).count() == state.affected(task, claimed).count()
    new = spark.createDataFrame([row(0, "consume", "pending", key="k"), row(0, "consume", "pending", key="new")], ddl).withColumn("task_id", F.concat("task_id", "dedup_key"))
    assert {r.dedup_key for r in state.enqueue(task, new).filter("id > 5").collect()} == {"new"}
    owner = spark.createDataFrame([("b", "x", 1, t0, t0)], "batch_id string, owner_id string, pid long, acquired_at timestamp, last_heartbeat timestamp")
    assert state.acquire_owner(owner, "b", "me", 2, now).first().owner_id == "me" and state.acquire_owner(state.heartbeat(owner, "x", now), "b", "me", 2, now).first().owner_id == "x"
    tags = spark.createDataFrame([(1, "a", t0)], "id long, name string, created_at timestamp")
    out, codes = state.create_named(tags, ["a", "b", "b", " "], now)
    assert [r.code for r in codes.collect()] == ["Conflict", "Created", "Conflict", "Invalid"] and {(r.id, r.name) for r in out.collect()} == {(1, "a"), (2, "b")}
    out, codes = state.delete_named(out, [1, 2, 9], spark.createDataFrame([(2,)], "x long"))
    assert [r.code for r in codes.collect()] == ["Deleted", "Conflict", "NotFound"] and out.count() == 1


def test_orphans(spark):
    t = lambda d: datetime(2024, 1, d)
    u = "0a1b2c3d-0000-1111-2222-333344445555"
    parents = spark.createDataFrame([(u, t(2)), (u, t(9)), (None, t(1))], "id string, created_at timestamp")
    kids = spark.createDataFrame([(1, u.upper(), t(3)), (2, "{" + u + "}", t(1)), (2, "{" + u + "}", t(1)), (3, "urn:uuid:" + u, None), (4, None, t(1)), (5, " ", t(1)), (6, "0", t(1)), (7, u.replace("-", ""), t(3))], "id long, batch_id string, at timestamp").withColumns({"key": F.lit("x"), "child": F.lit("y"), "salt": F.lit("z")})
    ref = Reference("task", kids, "id", "batch_id", "at", parents, "id", "created_at", "uuid")
    assert {(r.row_id, r.kind) for r in orphans([ref]).collect()} == {(2, "late"), (6, "missing")}
    nums = spark.createDataFrame([(1, 5, t(1)), (2, 0, t(1)), (3, -7, t(1)), (4, 99, None), (5, 10, t(1)), (6, None, t(1))], "id long, fk long, at timestamp")
    up = spark.createDataFrame([(10, None), (4, t(1))], "id long, created_at timestamp")
    r2 = Reference("x", nums, "id", "fk", "at", up, "id", "created_at")
    assert {(r.row_id, r.kind) for r in orphans([r2]).collect()} == {(1, "deleted"), (2, "missing"), (3, "missing"), (4, "missing")}
    assert orphans([Reference("x", nums.limit(0), "id", "fk", "at", up, "id", "created_at")]).count() == 0
    assert orphans([Reference("x", nums, "id", "fk", "at", up.limit(0), "id", "created_at")]).count() == 5
    assert {r.month for r in orphan_report([r2]).collect()} == {"2024-01", None}


def test_skewed_orphans(spark):
    kids = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("fk"), F.lit(None).cast("timestamp").alias("at"))
    up = spark.range(0, 30_000, 2).select("id", F.lit(None).cast("timestamp").alias("created_at"))
    want = sum(1 for i in range(30_000) if (7 if i % 3 == 0 else i) % 2)
    assert orphans([Reference("x", kids, "id", "fk", "at", up, "id", "created_at")]).count() == want


def _zip(name, xml):
    b = BytesIO()
    with ZipFile(b, "w") as z:
        z.writestr(name, xml)
    return b.getvalue()


def test_office_text():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    assert files.office_text(_zip("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:t>One</w:t><w:t> two</w:t></w:p><w:p><w:t>Three</w:t></w:p></w:document>')) == "One two\nThree"
    t = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    assert files.office_text(_zip("content.xml", f'<d xmlns:t="{t}"><t:h>Head</t:h><t:p>Body</t:p></d>')) == "Head\nBody"
    assert files.office_text(b"junk") is None


def test_inbox_stream(spark, tmp_path):
    from foliant.streaming import inbox

    src = tmp_path / "in"
    src.mkdir()
    docx = _zip("word/document.xml", '<w:document xmlns:w="x"><w:p><w:t>Hello there</w:t></w:p></w:document>')
    (src / "a.docx").write_bytes(docx)
    (src / "b.txt").write_text("no supported type")
    paths = [str(tmp_path / x) for x in ("out", "rej", "cp")]
    inbox.start(spark, str(src), *paths).awaitTermination(60)
    (src / "c.docx").write_bytes(docx)
    inbox.start(spark, str(src), *paths).awaitTermination(60)
    assert [(r.text, r.words) for r in spark.read.parquet(paths[0]).collect()] == [("Hello there", 2)]
    assert sorted(r.reason for r in spark.read.parquet(paths[1]).collect()) == ["duplicate", "unsupported"]


def test_logs(spark):
    df = spark.createDataFrame([("f", 0, "cont"), ("f", 1, "2024-01-01 a"), ("f", 2, " x"), ("f", 3, "2024-01-02 b")], "file string, pos int, line string")
    assert {r.text for r in logs.tail(df, 500).collect()} == {"2024-01-01 a\n x", "2024-01-02 b"}
    assert (logs.clamp(0), logs.clamp(1), logs.clamp(9999)) == (500, 100, 5000)


def test_backup(spark, tmp_path):
    df = spark.createDataFrame([(1, "/old/a/old/b")], "id long, storage_path string")
    backup.export({"document": df}, str(tmp_path / "b"), datetime(2024, 1, 1))
    assert backup.restore(spark, str(tmp_path / "b"), "/old", "/new")["document"].first().storage_path == "/new/a/old/b"
    assert backup.expired(["a", "c", "b"], 2) == ["a"]
    assert backup.next_time(datetime(2024, 1, 1, 12), 1, "03:00") == datetime(2024, 1, 2, 3) and backup.next_time(datetime(2024, 1, 1, 12), 0.25, "03:00") == datetime(2024, 1, 1, 15)
    assert backup.minutes("24:00", True) == 1440
    with pytest.raises(ValueError):
        backup.minutes("25:00")
    assert backup.in_windows(datetime(2024, 1, 1, 9), []) and not backup.in_windows(datetime(2024, 1, 1, 9), [("10:00", "24:00")])


def test_people(spark):
    now = F.to_timestamp(F.lit("2024-01-01"))
    people = spark.createDataFrame([(1, "José García", None, "jose garcia", None)], "id long, name string, name_native string, normalized_name string, created_at timestamp")
    found = spark.createDataFrame([(9, "Jose Garcia", "Χοσέ", "author"), (9, "Ann Lee", None, None), (8, "Ann  Lee", None, "sender")], "document_id long, name string, native string, role string")
    out, links = enrich.upsert_people(people, found, now)
    assert {(r.id, r.name_native) for r in out.collect()} == {(1, "Χοσέ"), (2, None)}
    assert {(r.document_id, r.people_id, r.role) for r in links.collect()} == {(9, 1, "author"), (9, 2, "unknown"), (8, 2, "sender")}
    assert ingest.rewrite_prefix is not None and enrich.retry_target(1000, 50, 100) == 450 and enrich.retry_target(100, 10, 100) is None


def test_reference_times_and_formats(spark):
    at = lambda *x: datetime(2026, 7, *x)
    for after, days, hhmm, want in [
        (at(28, 0, 57, 7), 1, "01:30", at(29, 1, 30)), (at(28, 1, 30, 35), 1, "01:30", at(29, 1, 30)), (at(27, 1, 30), 2, "02:00", at(29, 2)), (at(28, 6), 0.5, "08:00", at(28, 8)),
        (at(28, 22), 0.5, "08:00", at(29, 8)), (at(28, 10), 0, "02:00", at(29, 2)), (at(28), 1, "", at(29, 2)), (at(28), 0.25, "20:00", at(28, 20)), (at(28), 1, "25:99", at(29, 2)),
    ]:
        assert backup.next_time(after, days, hhmm) == want
    assert backup.due(at(29, 3), at(28, 1), 1, "02:00") and not backup.due(at(29, 1), at(28, 1), 1, "02:00") and not backup.due(at(30), at(28), 1, "", active=1) and backup.due(at(1), None, 1, "")
    sizes = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1536, 1 << 20, 5 << 30, 3 << 40)], "n long")
    assert [r[0] for r in sizes.select(T.format_bytes(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "1.0 MiB", "5.0 GiB", "3072.0 GiB"]
    assert [r[0] for r in sizes.select(T.format_size(F.col("n"))).collect()][-3:] == ["1.0 MB", "5.0 GB", "3.0 TB"]
    spans = spark.createDataFrame([(n,) for n in (450, 14250, 59_999, 60_000, 90_500, 3_599_600, 3_661_000)], "n long")
    assert [r[0] for r in spans.select(T.human_duration(F.col("n"))).collect()] == ["0.5s", "14.2s", "60.0s", "1m 0s", "1m 31s", "60m 0s", "1h 1m 1s"]
    assert T.quote_identifier('a"b') == '"a""b"' and T.quote_literal("it's") == "'it''s'" and T.quote_literal(None) == "NULL" and T.quote_literal("a\\b") == " E'a\\\\b'"
    assert one(spark, T.highlight(F.col("c0")), "a <b>x</b>") == "a \x1b[1;33mx\x1b[0m"


def test_provider_errors(spark):
    rows = [("Payment Required", 402, "openai", "credit"), ("rate limited", 429, "anthropic", "credit"), ('{"error":"Arrearage"}', 400, "qwen", "credit"), ('{"error":"Arrearage"}', 400, "openai", "other"), ("bad request", 400, "qwen", "other"), ("x", 500, "openai", "other")]
    limit = "maximum context length is {} tokens but you requested {}{} tokens"
    rows += [(limit.format(200000, "", 250000), 400, "openai", "tokens"), (limit.format(100, "about ", 150), 400, "x", "tokens"), (limit.format(0, "", 100), 400, "x", "other"), (limit.format(100, "", 0), 400, "x", "other")]
    df = spark.createDataFrame(rows, "body string, status int, provider string, want string")
    got = df.select("want", enrich.error_class(F.col("body"), F.col("status"), F.col("provider")).alias("got"), enrich.token_limit(F.col("body")).alias("n")).collect()
    assert all(r.want == r.got for r in got) and [tuple(r.n) for r in got if r.n] == [(200000, 250000), (100, 150)]
    assert all(enrich._answer_error(b, s, p)[0] == w for b, s, p, w in rows)


def test_analysis_errors(spark):
    def model(prompt):
        text = prompt.rsplit("\n\n", 1)[-1]
        if "poor" in text:
            raise enrich.ModelError("Payment Required", 402)
        if "blank" in text:
            return "{}"
        if len(text.split()) > 300:
            raise enrich.ModelError("maximum context length is 500 tokens but you requested 1000 tokens", 400)
        return '{"title": "t"}'

    long = ". ".join(f"Sentence {i} tells of the harbour and the meadow" for i in range(60)) + "."
    df = spark.createDataFrame([(1, "fine"), (2, "poor"), (3, "blank"), (4, long), (5, None)], "id long, text string")
    got = {r.id: (r.title, r.attempts, r.error) for r in enrich.analyze(df, "id", "text", model).collect()}
    assert got == {1: ("t", 1, None), 2: (None, 1, "credit"), 3: (None, 2, "empty"), 4: ("t", 2, None), 5: ("t", 1, None)}
    batch = spark.createDataFrame([("b1", "processing"), ("b2", "processing")], "id string, status string")
    task = spark.createDataFrame([("t1", "b1"), ("t2", "b2")], "task_id string, batch_id string")
    answers = spark.createDataFrame([("t1", "credit"), ("t2", None)], "task_id string, error string")
    assert {tuple(r) for r in state.pause_batches(batch, task, answers).collect()} == {("b1", "paused"), ("b2", "processing")}


def test_people_in_other_scripts(spark):
    now = F.to_timestamp(F.lit("2024-01-01"))
    people = spark.createDataFrame([], "id long, name string, name_native string, normalized_name string, created_at timestamp")
    found = spark.createDataFrame([(1, "Γιώργος Δήμου", None, "author"), (2, "王", "", "witness"), (3, "Giorgos Dimou", "", "boss")], "document_id long, name string, native string, role string")
    out, links = enrich.upsert_people(people, found, now)
    assert {(r.name, r.name_native) for r in out.collect()} == {("Giorgos Dimoy", "Γιώργος Δήμου"), ("u738b", "王"), ("Giorgos Dimou", None)}
    assert {r.document_id for r in links.collect()} == {1, 2, 3} and {r.role for r in links.collect()} == {"author", "witness", "unknown"}


def test_numbered(spark):
    df = spark.createDataFrame([(f"n{i:03}",) for i in range(500)], "name string").repartition(7)
    got = {r.name: r.id for r in state.numbered(df, ["name"], spark.createDataFrame([(41,)], "id long")).collect()}
    assert got == {f"n{i:03}": 42 + i for i in range(500)}


def test_inbox_keeps_all_files(spark, tmp_path):
    import io
    import zipfile

    from foliant.streaming import inbox

    def docx(text):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr(zipfile.ZipInfo("word/document.xml"), f"<w:document xmlns:w='x'><w:p><w:t>{text}</w:t></w:p></w:document>")
        return b.getvalue()

    box, args = tmp_path / "in", [str(tmp_path / x) for x in ("docs", "rejects", "check")]
    box.mkdir()
    for name, content in {"a.docx": docx("one"), "b.docx": docx("one"), "c.docx": docx("two"), "d.txt": b"plain"}.items():
        (box / name).write_bytes(content)
    noon = datetime(2024, 1, 1, 12)
    assert inbox.poll(spark, str(box), *args, noon, windows=[("13:00", "14:00")]) == "outside its windows" and not (tmp_path / "docs").exists()
    assert inbox.closed(noon, queued=2, live=2) and inbox.closed(noon, locked=True) and inbox.closed(noon, enabled=False)
    assert inbox.poll(spark, str(box), *args, noon) == ""
    (box / "e.docx").write_bytes(docx("two"))
    (box / "f.docx").write_bytes(docx("three"))
    assert inbox.poll(spark, str(box), *args, noon) == ""
    docs, rejects = spark.read.parquet(args[0]), spark.read.parquet(args[1])
    assert sorted(r.text for r in docs.collect()) == ["one", "three", "two"]
    assert sorted(r.reason for r in rejects.collect()) == ["duplicate", "duplicate", "unsupported"]
    assert docs.count() + rejects.count() == 6


def test_pdf(spark):
    import zlib

    from foliant.sources import files

    page = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello \\(all\\)) Tj 0 -14 Td [(W) -10 (orld) -300 (again)] TJ T* <4f6b> Tj ET")
    pdf = b"%PDF-1.4\n1 0 obj <</Type /Pages /Count 1>> endobj\n2 0 obj <</Type /Page>> endobj\n3 0 obj <</Length 9 /Filter /FlateDecode>>\nstream\n" + page + b"\nendstream endobj\n%%EOF"
    assert files.pdf_text(pdf) == "Hello (all)\nWorld again\nOk" and files.page_count(pdf) == 1
    assert files.pdf_text(b"%PDF-1.4 nothing") is None and files.pdf_text(b"x") is None and files.page_count(b"x") is None
    df = spark.createDataFrame([(bytearray(pdf), "application/pdf"), (None, None)], "content binary, mime string")
    assert [(r.text, r.page_count) for r in files.with_pages(files.extract(df)).collect()] == [("Hello (all)\nWorld again\nOk", 1), (None, None)]


def test_archive_of_a_backup(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id long, name string")
    backup.export({"tag": df}, str(tmp_path / "b"), datetime(2024, 1, 1))
    sha = backup.archive(str(tmp_path / "b"), str(tmp_path / "b.tar.gz"))
    assert len(sha) == 64 and backup.unpack(str(tmp_path / "b.tar.gz"), str(tmp_path / "c")) == []
    assert backup.restore(spark, str(tmp_path / "c"))["tag"].count() == 1


def test_log_tail(spark, tmp_path):
    p = tmp_path / "a.log"
    p.write_text("".join(f"2024-01-01 entry {i}\n" for i in range(1000)))
    got = logs.last_lines(spark, [str(p)], 100).collect()
    assert [r.line for r in got][-1] == "2024-01-01 entry 999" and 3 <= len(got) <= 5 and all(r.line.startswith("2024") for r in got)


def test_settings(tmp_path, monkeypatch):
    from foliant.settings import Watched, load

    p = tmp_path / "s.json"
    p.write_text('{"polling": false, "windows": [["01:00", "02:00"]], "nonsense": 1}')
    w = Watched(str(p))
    assert not w.current().polling and w.current().windows == (("01:00", "02:00"),)
    p.write_text('{"backup_days": 0.5}')
    assert w.current().polling and w.current().backup_days == 0.5
    monkeypatch.setenv("FOLIANT_TRASH_DAYS", "9")
    assert load(str(p)).trash_days == 9
    monkeypatch.setenv("FOLIANT_TRASH_DAYS", "x")
    with pytest.raises(ValueError):
        load(str(p))


def test_saved_filters():
    f = search.Filter(query="a b", tags=("x",), people=(("Ann", "author"),), size=(1, None), created=(None, "2024"), limit=7)
    assert search.from_record(search.to_record(f)) == f


def test_orphans_with_validity_and_hot_keys(spark):
    t = lambda d: datetime(2024, 1, d)
    kids = spark.createDataFrame([(1, 7, t(5)), (2, 7, t(1)), (3, 8, t(9)), (4, 8, t(4)), (5, 99, t(5))] + [(100 + i, 7, t(5)) for i in range(3000)], "id long, fk long, at timestamp")
    up = spark.createDataFrame([(7, t(2), None), (8, t(1), t(6))], "id long, created_at timestamp, gone timestamp")
    ref = Reference("x", kids, "id", "fk", "at", up, "id", "created_at", parent_until="gone")
    for parts in (1000, 10, 2):
        assert {(r.row_id, r.kind) for r in orphans([ref], parts, 1).collect()} == {(2, "late"), (3, "deleted"), (5, "missing")}


def test_rename(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    for row_id, name, code in ((1, "c", "Updated"), (1, "a", "Noop"), (1, "b", "Conflict"), (9, "z", "NotFound"), (1, " ", "Invalid")):
        out, result = state.rename(df, row_id, name)
        assert result.first().code == code and out.filter("id = 1").first().name == ("c" if code == "Updated" else "a")


def test_overlap_and_graph_by_hand():
    import numpy as np

    sets = [{"a", "b"}, {"b", "c"}, {"d"}, set()]
    sim = textrank.overlap(sets)
    want = np.array([[len(x & y) / len(x | y) if x | y else 0.0 for y in sets] for x in sets])
    assert np.allclose(sim, want)
    links = sim.copy()
    np.fill_diagonal(links, 1.0)
    give = links / links.sum(1, keepdims=True)
    np.fill_diagonal(give, 0.0)
    s = np.full(4, 0.25)
    for _ in range(textrank.STEPS):
        new = 0.15 / 4 + 0.85 * (s @ give)
        if np.abs(new - s).sum() < 1e-4:
            break
        s = new
    assert np.allclose(textrank.graph_scores(sim), s / s.sum())


def test_similar_in_blocks(spark):
    import random

    from foliant.operators import matching

    rnd = random.Random(3)
    vec = lambda n: [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(n)]
    q = spark.createDataFrame([(i, vec(4)) for i in range(12)] + [(99, None)], "q long, v array<double>")
    t = spark.createDataFrame([(f"t{i:02}", vec(4)) for i in range(30)] + [("odd", vec(3)), ("none", None)], "t string, v array<double>")
    whole = {tuple(r) for r in matching.similar(q, t, 1.0, 3).collect()}
    assert whole == {tuple(r) for r in matching.similar(q, t, 1.0, 3, held=5).collect()} and all(x[1] != "odd" for x in whole)


def test_index_as_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The red fox and the red hen"), (2, "A fox. " + "word " * 120 + "red"), (3, None), (4, "red"), (5, "redder foxes")], "id long, text string")
    text = fts.index_text(F.lit(None).cast("string"), F.col("text"))
    fts.write_index(docs, str(tmp_path / "i"), "id", text)
    index = fts.read_index(spark, str(tmp_path / "i"))
    for q in ("red", "Red FOX", "fox red the", "nothing", "", "?!"):
        want = {(r.id, r.rank) for r in docs.filter(fts.matches(text, q)).select("id", fts.rank(text, q).alias("rank")).collect()}
        assert {(r.id, r.rank) for r in fts.hits(index, q).collect()} == want
    assert "PartitionFilters: [bucket" in fts.hits(index, "red fox")._jdf.queryExecution().toString()


def test_http_model():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            ask = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            poor = "poor" in ask["messages"][0]["content"]
            self.send_response(402 if poor else 200)
            self.end_headers()
            self.wfile.write(b"Payment Required" if poor else json.dumps({"choices": [{"message": {"content": ask["model"] + self.headers["Authorization"]}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        model = enrich.http_model(f"http://127.0.0.1:{server.server_port}/", "m", "k", timeout=10)
        assert model("hello") == "mBearer k"
        with pytest.raises(enrich.ModelError) as x:
            model("poor")
        assert (x.value.status, x.value.body) == (402, "Payment Required")
        with pytest.raises(enrich.ModelError):
            enrich.http_model("http://127.0.0.1:1/", "m", timeout=1)("x")
    finally:
        server.shutdown()


def test_parameters_and_rows_as_json(spark):
    assert [search.coerce(v, 25, 1, 100) for v in ("7", "0", "101", "x", None)] == [7, 25, 25, 25, 25] and [search.clamp_limit(n) for n in (0, 7, 999)] == [50, 7, 100]
    from foliant.operators import catalog

    assert [r.value for r in catalog.as_json(spark.createDataFrame([(1, None, "ä")], "id int, x string, name string")).collect()] == ['{"id":1,"name":"ä"}']


def test_windows_by_tokens_and_thresholds(spark):
    from foliant.operators import matching

    count = lambda ws: [len(w) for w in ws]
    got = matching.token_windows("aa bb cc dddddddddddd ee ff", 6, count, 0.34)
    assert got == ["aa bb cc", "dddddddddddd", "ee ff"] and matching.token_windows("aa bb cc dd ee", 6, count, 0.34) == ["aa bb cc", "cc dd ee"]
    assert matching.token_windows("", 5, count) == [""]
    assert matching.thresholds("BGE-M3-onnx") == (0.40, 0.80) and matching.thresholds("other") == (0.30, 0.75)
    df = spark.createDataFrame([(1, "a b c d"), (2, None)], "id long, text string")
    assert [len(r.embedding) for r in matching.encode(df, "text", matching.hashed_encoder(8), size=2, count=count).collect()] == [8, 8]


def test_layout_and_types(spark, tmp_path):
    at = F.to_timestamp(F.lit("2024-03-04 05:06:07"))
    assert one(spark, ingest.storage_path("/s", F.col("c0"), F.lit(".pdf"), at), "u") == "/s/processed/2024/03/04/05/u.pdf"
    df = spark.createDataFrame([(1, datetime(2024, 3, 4, 5)), (2, datetime(2024, 3, 4, 6))], "id long, created_at timestamp")
    ingest.write_partitioned(df, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).filter("hour = 6").first().id == 2 and (tmp_path / "d" / "year=2024" / "month=3" / "day=4" / "hour=5").is_dir()
    assert [one(spark, files.mime_of(F.col("c0")), p) for p in ("a.PDF", "b.tif", "c.jpeg", "d.xyz")] == ["application/pdf", "image/tiff", "image/jpeg", "application/octet-stream"]
    assert one(spark, files.sniff(F.col("c0")), bytearray(b"%PDF-1.7")) == "application/pdf" and one(spark, files.extension_of(F.col("c0")), "image/png") == ".png"


def test_snippets_by_hand():
    text = "one two three needle four five six needle seven"
    assert fts.headline(text, {"needle"}, 3, 2) == "<b>needle</b> four"
    assert fts.headline(text, {"needle"}, 6, 2) == "<b>needle</b> four five six <b>needle</b>"
    assert fts.headline(text, {"absent"}, 6, 2) == "one two" and fts.headline("", {"x"}, 6, 2) == "" and fts.headline("!?", {"x"}, 6, 2) == ""
    assert fts.headline("Needle, again.", {"needle"}, 6, 2) == "<b>Needle</b>, again"


def test_reduction_by_hand():
    """Three chunks of one sentence: the first is always kept; of the others the one that shares no words with it is the more telling."""
    text = "The red fox ran home today. The red fox ran home again. Quite other matters came up then."
    chunks = textrank.chunked(text.split(), 6)
    assert [" ".join(ws) for ws, _ in chunks][0] == "The red fox ran home today." and [o for _, o in chunks][-1] == 0
    assert textrank.reduce_text(text, 0) == text and textrank.reduce_text(text, 100) == text
    short = textrank.reduce_text(text, 7, 6)
    assert short.startswith("The red fox ran home today.") and len(short.split()) < len(text.split()) + 1
    assert (textrank.target_words(9000, -3), textrank.target_words(100, -3), textrank.target_words(9000, 4000)) == (3000, 2000, 4000)
